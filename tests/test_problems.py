"""The general problems on small fixtures: nulls, ties, repeats, empty tables and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import arrivals, changefeed, hierarchy, references
from tessera.session import published, scratch_path

OPS = "delivery_id long, op_id string, op_sequence long, created_at string, op_type string, object_id string, payload struct<field_name:string,block_id:string,observed_add_ids:array<string>>, cell string"


def op(n, kind, obj, seq=1, field=None, block=None, adds=None, at="2019-03-01T00:00:00.000Z"):
    return (n, f"op{n:03d}", seq, at, kind, obj, (field, block, adds), "extra")


def current(spark, rows, state=None):
    return sorted((r.object_id, r.op_id) for r in changefeed.current_social_ops(spark, spark.createDataFrame(rows, OPS), state).collect())


def test_change_feed(spark):
    rows = [
        op(1, "profile.field.set", "a", 1, "name"), op(2, "profile.field.set", "a", 2, "name"), op(3, "profile.field.set", "a", 2, None),
        op(4, "post.block.set", "p", 5, block="x"), op(5, "post.block.delete", "p", 5, block="x"), op(6, "post.block.delete", "p", 1, block="y"), op(7, "post.block.set", "p", 2, block="y"),
        op(8, "edge.add", "e"), op(9, "edge.add", "e"), op(10, "edge.remove", "other", adds=["op008", None, "op008"]), op(11, "edge.remove", "e", adds=None),
        op(12, "profile.field.set", "gone", field="name"), op(13, "object.tombstone", "gone", 0), op(14, None, "a"), op(15, "profile.field.set", "n", None, "f"), op(16, "profile.field.set", "n", 0, "f", at=None),
    ]
    want = [("a", "op002"), ("a", "op003"), ("e", "op009"), ("n", "op016"), ("p", "op007")]
    assert current(spark, rows) == want
    random.Random(1).shuffle(rows)
    assert current(spark, rows * 3) == want  # any order, any number of deliveries


def test_change_feed_in_parts_and_again(spark):
    rows = [op(i, "profile.field.set", "a", i % 7, "name") for i in range(40)] + [op(90, "edge.remove", "a", adds=["op091"])]
    state = scratch_path(spark, "test-state")
    current(spark, rows, state)
    current(spark, rows[:10], state)
    assert current(spark, [op(91, "edge.add", "a")], state) == [("a", "op034")]  # a removal that came before its add
    assert published(spark, state).count() == 2


def test_change_feed_empty(spark):
    assert current(spark, []) == []


def test_arrivals(spark):
    rows = [("k1", 5, 1), ("k1", 3, 90), ("k1", 9, None), ("k2", 1, 1), (None, 2, 1), (None, 4, 1), ("", 6, 1), ("", 7, 200), ("k3", None, 1)] + [("hot", 100 + i, i % 100) for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, n long, b long").withColumn("h", F.lit(1)).repartition(5)
    got = sorted(r.arrival for r in arrivals.repeated_arrivals(df, "id", "n", "b").collect())
    assert got == sorted([5, 9, 7] + [100 + i for i in range(1, 3000)])
    assert arrivals.repeated_arrivals(df.limit(0), "id", "n", "b").count() == 0


def brute(parents):
    def above(n, seen=()):
        if n in seen:
            return {"!"}
        return {n}.union(*[above(p, (*seen, n)) for p in parents[n]]) if parents[n] else {n}

    def depth(n):
        return max((depth(p) + 1 for p in parents[n]), default=0)

    out = []
    for n in parents:
        a = above(n)
        out.append((n, "cycle", -1) if "!" in a else (n, min(x for x in a if not parents[x]), depth(n)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("fits", [2, 100000])
def test_hierarchy(spark, seed, fits):
    rng = random.Random(seed)
    ids = [f"n{i:03d}" for i in range(60)]
    parents = {n: sorted(set(rng.sample(ids[max(0, i - 12) : i], min(i, rng.choice([0, 1, 1, 1, 2, 3]) if i else 0)))) if i else [] for i, n in enumerate(ids)}
    if seed:
        parents[ids[20]] = [ids[25]]
        parents[ids[25]] = [ids[20]]
        parents[ids[40]] = [ids[40]]
    rows = [(n, [*p, None, "unknown"], rng.randrange(4), 1) for n, p in parents.items()] + [(ids[3], None, 0, 1), (None, ["n001"], 0, 1)]
    df = spark.createDataFrame(rows, "node_id string, parents array<string>, nth long, a int")
    got = hierarchy.resolve(df, ["nth"], with_path=True, nodes_per_fragment=8, fits=fits).collect()
    assert sorted((r.node_id, r.root_id, r.node_depth) for r in got) == brute(parents)
    for r in got:
        if r.node_depth < 0:
            assert r.path is None
        else:
            assert r.path[-1] == r.node_id and len(r.path) == r.node_depth + 1 and all(a in parents[b] for a, b in zip(r.path, r.path[1:]))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("fits", [2, 100000])
def test_descendants_of_nodes_with_several_parents(spark, seed, fits):
    rng = random.Random(seed + 10)
    ids = [f"n{i:03d}" for i in range(90)]
    parents = {n: sorted(set(rng.sample(ids[max(0, i - 15) : i], min(i, rng.choice([0, 1, 2, 2, 3]))))) for i, n in enumerate(ids)}
    if seed:
        parents[ids[20]], parents[ids[25]], parents[ids[70]] = [ids[25]], [ids[20]], [ids[70]]

    def above(n, seen=()):
        return {"!"} if n in seen else set(parents[n]).union(*(above(p, (*seen, n)) for p in parents[n]))

    def longest(n):  # upwards, of several the smallest
        return [n, *min((longest(p) for p in parents[n]), key=lambda x: (-len(x), x))] if parents[n] else [n]

    ancestors = {n: above(n) for n in ids}
    placed = [n for n in ids if "!" not in ancestors[n]]
    df = spark.createDataFrame([(n, [*p, None, "unknown"], rng.randrange(9), 1) for n, p in parents.items()] + [(None, ["n001"], 0, 1), (ids[4], None, 0, 1)], "node_id string, parents array<string>, nth long, descendant int")
    got = sorted((r.node_id, r.descendant) for r in hierarchy.all_descendants(df, ["nth"], nodes_per_fragment=8, fits=fits).collect())
    assert got == sorted((a, n) for n in placed for a in ancestors[n])
    paths = hierarchy.resolve(df, ["nth"], with_path=True, nodes_per_fragment=8, fits=fits).filter("path is not null")
    assert len(got) > hierarchy.descendants(paths).count()
    assert {r.node_id: r.path for r in paths.collect()} == {n: longest(n)[::-1] for n in placed}
    assert hierarchy.all_descendants(df.limit(0), ["nth"]).count() == 0


def test_long_chain_and_descendants(spark):
    n = 300
    df = spark.createDataFrame([(f"{i:04d}", [f"{i - 1:04d}"] if i else [], i) for i in range(n)], "node_id string, parents array<string>, nth long")
    got = hierarchy.resolve(df, ["nth"], with_path=True, nodes_per_fragment=20, fits=3)
    assert got.agg(F.max("node_depth")).first()[0] == n - 1
    assert hierarchy.descendants(got).count() == n * (n - 1) // 2
    assert hierarchy.resolve(df.limit(0), ["nth"]).count() == 0


def test_references(spark):
    refs = spark.createDataFrame([("t", "p", "a", "x", 1), ("t", "p", "a", "y", 1), ("t", "p", "b", "z", 1), ("t", "p", "b", "ok", 5), ("t", "p", "c", None, 1), ("t", "p", None, "x", 1), ("t", "p", "d", "y", None)], "src_table string, parent_table string, from_key string, to_key string, from_batch long")
    parents = spark.createDataFrame([("p", "y", 9, False), ("p", "z", 9, True), ("p", "ok", 5, False), ("q", "x", 1, False)], "parent_table string, key string, batch long, deleted boolean")
    bad = references.reference_states(refs, parents)
    assert sorted((r.from_key, r.to_key, r.ref_state) for r in bad.collect()) == [("a", "x", "missing"), ("a", "y", "late"), ("b", "z", "deleted")]
    assert sorted(tuple(r) for r in references.count_by_period(bad, 10).collect()) == [("t", 0, "deleted", 1), ("t", 0, "late", 1), ("t", 0, "missing", 1)]
    assert references.reference_states(refs.limit(0), parents).count() == 0


@pytest.mark.parametrize("shape", ["tree", "chain", "dag"])
def test_hierarchy_of_badly_laid_out_nodes(spark, shape, monkeypatch):
    """Random ids and no place to sort by: the quotient graph does not fit one task and is laid out by its links, or solved by rounds."""
    import random

    from tessera.operators import hierarchy

    rng = random.Random(shape)
    n = 500 if shape != "chain" else 120
    names = [f"{rng.getrandbits(60):015x}" for _ in range(n)]
    up = {names[i]: ([] if i == 0 else [names[i - 1]] if shape == "chain" else [names[rng.randrange(max(0, i - 100), i)] for _ in range(1 + (shape == "dag") * rng.randrange(3))]) for i in range(n)}
    up[names[n // 2]].append(names[n // 2])  # a ring, and what hangs from it
    depth, root = {}, {}
    for v in names:
        ps = set(up[v])
        lost = v in ps or any(depth[p] < 0 for p in ps)
        depth[v] = -1 if lost else max((depth[p] + 1 for p in ps), default=0)
        root[v] = "cycle" if lost else min((root[p] for p in ps), default=v)
    df = spark.createDataFrame(list(up.items()), "node_id string, parents array<string>")
    got = {r.node_id: (r.root_id, r.node_depth) for r in hierarchy.resolve(df, nodes_per_fragment=50, fits=120).collect()}
    assert got == {v: (root[v], depth[v]) for v in names}
    if shape == "chain":
        paths = {r.node_id: r.path for r in hierarchy.resolve(df, with_path=True, nodes_per_fragment=40, fits=80).collect()}
        assert paths == {v: (names[: i + 1] if depth[v] >= 0 else None) for i, v in enumerate(names)}


def test_arrivals_in_many_loads(spark):
    """Every load sees the store only; late rows turn a kept arrival into a repeat; only matching buckets are read."""
    rng = random.Random(12)
    rows = [(i, f"id{rng.randrange(300)}" if rng.random() < 0.9 else "hot", rng.randrange(120)) for i in range(900)] + [(1000 + i, None, 5) for i in range(5)] + [(2000 + i, f"id{i}", None) for i in range(20)]
    df = spark.createDataFrame([(a, k, b, "x") for a, k, b in rows], "arrival long, id string, batch long, h string")
    first = {}
    for a, k, _ in rows:
        if k is not None:
            first[k] = min(a, first.get(k, a))
    want = sorted(a for a, k, _ in rows if k is not None and a != first[k])
    store, got = scratch_path(spark, "test-arrivals"), []
    order = [x for x in range(6)]
    rng.shuffle(order)
    for n in order:
        part = df.filter((F.coalesce(F.col("batch"), F.lit(0)) / 20).cast("int") == n)
        got += [r[0] for r in arrivals.Arrivals(spark, store, 20).add(part, "id", "arrival", "batch").collect()]
    assert sorted(got) == want
    assert arrivals.Arrivals(spark, store, 20).add(df.limit(0), "id", "arrival", "batch").count() == 0

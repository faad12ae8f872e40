"""The llm operators against brute force: nulls, ties, repeats, hot groups, empty tables, clashing names."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import oracle, rows_of
from pyspark.sql import functions as F

from tessera.llm import capping, history, mixing, neardup, packing, queries, repetition, tokens
from tessera.session import scratch_path


def edited(rng, data, edits):
    out = bytearray(data)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.randrange(256)
        elif kind == 1:
            out[at:at] = rng.randbytes(rng.randrange(1, 12))
        else:
            del out[at : at + rng.randrange(1, 12)]
    return bytes(out)


def families(seed, hot=0):
    rng = random.Random(seed)
    words = [rng.randbytes(7) for _ in range(40)]
    docs = []
    for _ in range(40):
        base = rng.randbytes(rng.choice([60, 200, 500])) if rng.random() < 0.6 else b"".join(rng.choice(words) for _ in range(60))
        docs += [base] + [edited(rng, base, rng.randrange(1, 7)) for _ in range(rng.randrange(4))]
    base = rng.randbytes(400)
    docs += [edited(rng, base, 2) for _ in range(hot)]
    return [(f"k{i:04d}", d) for i, d in enumerate(docs)]


def true_pairs(docs, threshold=0.7):
    sets = [(k, {d[i : i + 8] for i in range(len(d) - 7)}) for k, d in docs if d is not None]
    out = set()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            both = len(x & y)
            if both and a != b and both / len(x | y) >= threshold:
                out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("seed, hot", [(1, 0), (2, 60)])
def test_near_pairs(spark, seed, hot):
    docs = families(seed, hot)
    rows = [*docs, *docs[:20], ("null", None), (None, b"x" * 50), ("short1", b"abc"), ("short2", b"abc"), ("empty", b""), ("same", docs[0][1])]
    df = spark.createDataFrame([(k, d, 1, 2.0) for k, d in rows], "k string, c binary, id int, d double")
    got = {(r.key_a, r.key_b) for r in neardup.near_pairs(df, "k", "c").collect()}
    assert got == true_pairs([*docs, ("same", docs[0][1])])
    assert neardup.near_pairs(df.limit(0), "k", "c").count() == 0


def test_near_pairs_in_many_bands_and_passes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_BAND_BYTES", 5_000)
    docs = families(5, hot=30)
    df = spark.createDataFrame(docs, "k string, c binary")
    bands = neardup._bands(df.select(F.col("c").alias("content")))
    passes = neardup._passes(bands, 0.7, 0.1)
    assert len(bands) > 4 and len(passes) > 1 and [b for p in passes for b in p] == list(range(len(bands)))
    got = {(r.key_a, r.key_b) for r in neardup.near_pairs(df, "k", "c").collect()}
    assert got == true_pairs(docs)


def test_more_bands_propose_no_more_unlike_pairs():
    rng = random.Random(6)
    shared = [rng.randbytes(8) for _ in range(60)]
    docs = [rng.randbytes(rng.randrange(150, 400)) + b"".join(rng.sample(shared, 3)) for _ in range(300)]  # any two share a run or so
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(docs, pa.binary())], names=["id", "content"])
    order, none = np.arange(neardup._COUNTERS, dtype=np.uint64), np.zeros(0, np.int64)
    for bands in (np.array([0]), np.arange(0, 400, 10)):
        posted = list(neardup._postings(order, 0.7, 0.1, bands, range(len(bands)), (none, none))([batch]))
        assert sum(b.num_rows for b in neardup._meet(0.7, 0.1, bands)(posted)) < 30


def test_blocks_keep_their_columns():
    ids, label, size = np.array([5, 9, 2**40]), np.array([-7, 2, 2**31 - 1]), np.array([0, 70_000, 3])
    count, token = np.array([1, 0, 300]), np.arange(301, dtype=np.uint32) * np.uint32(9_000_001)
    block = neardup.packed(ids, label, size, count, token)
    got = neardup.read_blocks(pa.array([block, block], pa.binary()))
    want = (np.tile(ids, 2), np.tile(label, 2), np.tile(size, 2), np.repeat(np.arange(6), np.tile(count, 2)), np.tile(token >> np.uint32(1), 2), np.tile(token & np.uint32(1), 2) > 0)
    assert all((x == y).all() for x, y in zip(got, want))
    assert not any(len(x) for x in neardup.read_blocks(pa.array([], pa.binary())))


def test_groups(spark):
    pairs = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("hub", f"x{i:02d}") for i in range(50)] + [("p", "q"), ("p", "q")]
    got = {r.key: r.group_key for r in neardup.groups(spark.createDataFrame(pairs, "key_a string, key_b string")).collect()}
    assert got == {**{f"n{i:03d}": "n000" for i in range(41)}, "hub": "hub", **{f"x{i:02d}": "hub" for i in range(50)}, "p": "p", "q": "p"}


@pytest.mark.parametrize("most", [1, 4])
def test_capping(spark, most):
    rng = random.Random(most)
    rows = [("hot", rng.choice([None, 0, 5, 5, 5, 1000, -3, 2**31 - 1]), f"id{rng.choice(['', 'é', 'zz'])}{i}") for i in range(700)]
    rows += [(f"g{i % 90}", rng.randrange(3), f"id{i}") for i in range(300)] + [(None, 1, "free1"), (None, 1, "free2"), ("", 1, "e1")]
    df = spark.createDataFrame(rows, "g string, key int, row string")
    got = {(r.g, r.row) for r in capping.over_limit(df, F.col("g"), capping.preference_key(F.col("key"), F.col("row")), most=most).collect()}
    by = defaultdict(list)
    for g, s, i in rows:
        if g is not None:
            by[g].append((1 if s is None else 0, -(s or 0), i.encode(), i))
    assert got == {(g, x[-1]) for g, v in by.items() for x in sorted(v)[most:]}
    assert capping.over_limit(df.limit(0), F.col("g"), capping.preference_key(F.col("key"), F.col("row")), most=most).count() == 0


def test_capping_share_and_equal_keys(spark):
    df = spark.createDataFrame([("a", 1, f"{i:02d}") for i in range(8)] + [("b", 1, "x"), ("b", 1, "x")], "g string, s int, i string")
    key = capping.preference_key(F.col("s"), F.col("i"))
    assert sorted(r.i for r in capping.over_limit(df, F.col("g"), key, share=0.3).collect()) == ["03", "04", "05", "06", "07"]
    assert "b" not in {r.g for r in capping.over_limit(df, F.col("g"), key, most=1).collect()}
    with pytest.raises(ValueError):
        capping.over_limit(df, F.col("g"), key)


def known(batches, pairs):
    first, held = {}, {}
    for b, d, c in batches:
        first[d] = min(b, first.get(d, b))
        if c is not None:
            held[d] = min(b, held.get(d, b))
    near = defaultdict(set)
    for x, y in pairs:
        near[x].add(y)
        near[y].add(x)
    return {(b, d) for b, d, c in batches if first[d] < b or (c is not None and any(held.get(e, b) < b for e in near[d]))}


def test_history(spark):
    docs = families(3, hot=60)
    rng = random.Random(4)
    rows = [(rng.randrange(6), k, d) for k, d in docs] + [(rng.randrange(6), k, d) for k, d in rng.sample(docs, 30)] + [(2, "tiny", b"ab"), (4, "tiny", b"ab")]
    mentions = [(rng.randrange(6), k) for k, _ in rng.sample(docs, 20)] + [(1, "elsewhere"), (5, "elsewhere"), (3, None), (None, "k0000")]
    content = spark.createDataFrame(rows, "batch long, digest string, content binary")
    named = spark.createDataFrame(mentions, "batch long, digest string")
    want = known([*rows, *((b, d, None) for b, d in mentions if b is not None and d is not None)], true_pairs(docs))
    path = scratch_path(spark, "test-history")
    got = set()
    for low, high in ((0, 1), (2, 3), (4, 5)):  # a new object each time: the store is all that is kept
        store = history.History(spark, path)
        got |= {(r.batch, r.digest) for r in store.add(content.filter(F.col("batch").between(low, high)), named.filter(F.col("batch").between(low, high))).collect()}
    assert got == want
    assert history.History(spark, path).add(content.limit(0), named.limit(0)).count() == 0


def test_history_finds_every_near_pair_of_short_and_patched_contents(spark):
    rng = random.Random(8)
    docs = []
    for k, n in enumerate([8, 12, 16, 20, 23, 24, 26, 28, 30, 32, 34, 35, 40, 50] * 8):
        base = rng.randbytes(n)
        docs += [(f"a{k:03d}", base), (f"b{k:03d}", base + rng.randbytes(1)), (f"c{k:03d}", rng.randbytes(1) + base)]
    for k in range(30):  # an edit in every 46 bytes, and halves that many others have too
        base = rng.randbytes(46 * rng.randrange(2, 12))
        docs += [(f"d{k:03d}", base), (f"e{k:03d}", b"".join(base[i : i + 45] + bytes([base[i + 45] ^ 1]) for i in range(0, len(base), 46)))]
    common = rng.randbytes(300)
    docs += [(f"f{k:03d}", common + rng.randbytes(rng.choice([60, 100, 300]))) for k in range(40)]
    pairs = true_pairs(docs)
    rows = [(rng.randrange(6), k, d) for k, d in docs]
    content, none = spark.createDataFrame(rows, "batch long, digest string, content binary"), spark.createDataFrame([], "batch long, digest string")
    path, got = scratch_path(spark, "test-history"), set()
    for low, high in ((0, 2), (3, 4), (5, 5)):
        got |= {(r.batch, r.digest) for r in history.History(spark, path).add(content.filter(F.col("batch").between(low, high)), none).collect()}
    assert got == known(rows, pairs) and len(pairs) > 300


def test_history_of_many_loads_merges_and_recalls_every_edited_copy(spark, monkeypatch):
    """Contents of 54 to 500 bytes with evenly spread one-byte changes, over 12 loads, merged on the way; few holders proposed first."""
    monkeypatch.setattr(history, "_SEGMENTS", 5)
    monkeypatch.setattr(history, "_MOST", 2)
    rng = random.Random(9)
    docs, rows = [], []
    for k, n in enumerate([54, 58, 62, 66, 70, 80, 100, 150, 300, 500] * 6):
        base = rng.randbytes(n)
        step = n // (1 + n // 90) + 1
        copy = bytes(c ^ 1 if i % step == step // 2 else c for i, c in enumerate(base))
        docs += [(f"x{k:03d}", base), (f"y{k:03d}", copy)]
        rows += [(k % 6, f"x{k:03d}", base), (6 + k % 6, f"y{k:03d}", copy)]
    family = rng.randbytes(200)
    for k in range(24):
        docs.append((f"z{k:02d}", edited(rng, family, 1)))
        rows.append((k % 12, *docs[-1]))
    rows.append((3, "lost", None))  # first stored without its content
    rows.append((7, "lost", docs[0][1] + b"!"))
    pairs = true_pairs([*docs, ("lost", docs[0][1] + b"!")])
    none, path, got = spark.createDataFrame([], "batch long, digest string"), scratch_path(spark, "test-history"), set()
    content = spark.createDataFrame(rows, "batch long, digest string, content binary")
    for b in range(12):
        store = history.History(spark, path)
        got |= {(r.batch, r.digest) for r in store.add(content.filter(F.col("batch") == b), none).collect()}
    assert len(store.segments) < 5
    want = known([r for r in rows if r[1] != "lost"], pairs)
    assert {x for x in got if x[1] != "lost"} == want and len(want) > 70


def proposed(docs, bands):
    """The pairs that the fingerprints of some contents, each of a batch of its own, propose, and in how many rows."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs, pa.binary()), pa.array(range(len(docs))), pa.array([True] * len(docs))], names=["id", "content", "batch", "asks"])
    counts = next(history._run_counts([batch])).column("counts")[0].as_py()
    blocks = history._postings(neardup.rarer_first(np.frombuffer(counts, np.int64)), 0.7)([batch])
    spread = list(history._spread(bands, range(len(bands)), 0.7)(blocks))
    rows = [pa.RecordBatch.from_arrays([b.column("part"), pa.array([0] * b.num_rows), b.column("block")], names=["part", "kind", "block"]) for b in spread]
    out = [r for b in history._lookup(0.7, bands, False, 400)(rows) for r in b.to_pylist()]
    return {(r["b"], r["a"]) for r in out}, len(out)


def test_contents_of_few_words_propose_few_unlike_pairs():
    rng = random.Random(7)
    words = [rng.randbytes(rng.randrange(5, 12)) for _ in range(40)]
    docs = [b"".join(rng.choice(words) for _ in range(rng.randrange(15, 60))) for _ in range(400)]
    docs += [edited(rng, d, 1) for d in docs[:40]]
    pairs = {(int(a), int(b)) for a, b in true_pairs([(f"{i:03d}", d) for i, d in enumerate(docs)])}
    for bands in (np.array([0]), np.arange(0, 500, 20)):
        found, rows = proposed(docs, bands)
        assert pairs <= found and len(pairs) >= 40 and rows < 10_000


def test_history_in_many_bands_and_passes(spark, monkeypatch):
    monkeypatch.setattr(history, "_BAND_BYTES", 5_000)
    docs = families(5, hot=20)
    rng = random.Random(6)
    rows = [(rng.randrange(4), k, d) for k, d in docs]
    content, none = spark.createDataFrame(rows, "batch long, digest string, content binary"), spark.createDataFrame([], "batch long, digest string")
    path, got = scratch_path(spark, "test-history"), set()
    for low, high in ((0, 1), (2, 3)):
        store = history.History(spark, path)
        got |= {(r.batch, r.digest) for r in store.add(content.filter(F.col("batch").between(low, high)), none).collect()}
    passes = history._passes(store.bands, 0.7)
    assert len(store.bands) > 4 and len(passes) > 1 and [b for p in passes for b in p] == list(range(len(store.bands)))
    assert got == known(rows, true_pairs(docs))


@pytest.mark.parametrize("t", [0.05, 0.3, 0.7, 0.95])
def test_reach_covers_every_partner(t):
    for n in [*range(1, 60), 480]:
        posted = int(history._posted(np.array([n]), t)[0])
        for m in range(max(1, int(np.ceil(t * n - 1e-9))), min(int(n / t + 1e-9), 3_000) + 1):
            both = int(np.ceil(t / (1 + t) * (n + m) - 1e-9))
            last = min(n - 1, n - both + int(history._further(t) * min(n, m)))  # of the places that count
            assert last < posted and history._reach(np.array([n]), np.array([last]), t)[0] >= m


@pytest.mark.parametrize("capacity", [1, 7, 64, 256])
def test_packing(spark, capacity):
    rng = random.Random(capacity)
    rows = [(i, rng.choice([0, 1, 5, 60, 61, rng.randrange(400)])) for i in range(500)] + [(1000, 10 * capacity), (1001, None)] + [(2000 + i, 3) for i in range(400)]
    placed = packing.packed(spark.createDataFrame(rows, "id long, n_tokens long"), capacity).collect()
    fill, pieces = Counter(), defaultdict(list)
    for r in placed:
        fill[r.container] += r.n_tokens
        pieces[r.id].append((r.piece, r.start, r.n_tokens))
    assert max(fill.values()) <= capacity and set(fill) == set(range(len(fill)))
    for i, n in rows:
        parts = sorted(pieces.get(i, []))
        assert sum(p[2] for p in parts) == (n or 0)
        assert len(parts) == -(-(n or 0) // capacity) and all(p == (k, k * capacity, p[2]) for k, p in enumerate(parts))
    least = -(-sum(n or 0 for _, n in rows) // capacity)
    assert len(fill) <= least * 1.05 + 2
    assert packing.packed(spark.createDataFrame([], "id long, n_tokens long"), capacity).count() == 0


class Dense:
    def __init__(self, a):
        self.a, self.cols = a, a.shape[1]
        self.row, self.col = (x.ravel() for x in np.indices(a.shape))
        self.value = a.ravel()

    def times(self, x):
        return self.a @ x

    def back(self, r):
        return self.a.T @ r


def test_least_squares_is_near_the_constrained_optimum():
    rng = np.random.default_rng(1)
    a = rng.random((20, 8))
    x = np.maximum(0, rng.normal(size=8))
    assert np.allclose(packing.least_squares(Dense(a), a @ x, tolerance=1e-7), x, atol=1e-3)
    h = rng.normal(size=20)  # no exact solution: the gradient is zero where x is positive, and not negative elsewhere
    got = packing.least_squares(Dense(a), h, tolerance=1e-7)
    g = a.T @ (a @ got - h)
    assert np.abs(g[got > 1e-9]).max(initial=0) < 1e-4 and g.min() > -1e-4


@pytest.mark.parametrize("capacity", [256, 1024, 4096])
def test_fit_places_most_items(capacity):
    rng = np.random.default_rng(capacity)
    n = np.minimum(capacity, rng.lognormal(4.6, 1.0, 20_000).astype(int) + 1)
    counts = {int(k): int(c) for k, c in zip(*np.unique(n, return_counts=True))}
    plan, placed, norm = packing.planned(counts, capacity)
    used = Counter()
    for pattern, times in plan:
        assert sum(k * c for k, c in pattern.items()) <= capacity and times > 0
        for k, c in pattern.items():
            used[k] += c * times
    assert used == counts and norm < 0.05 and placed > 0.8 * len(n)
    assert sum(t for _, t in plan) <= 1.02 * n.sum() / capacity + 1


def test_knapsack_equals_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        counts = {rng.randrange(1, 30): rng.randrange(4) for _ in range(5)}
        budget = rng.randrange(120)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = mixing.knapsack(counts, budget)
        assert all(0 <= k <= counts[n] for n, k in got.items())
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= budget)


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["big"] * 6 + ["small", None, "other"]), rng.choice([0, 3, rng.randrange(1, 200)])) for i in range(3000)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2)], "source_name string, target_share double, max_repeats int")
    lengths = spark.createDataFrame(rows, "id long, source string, n_tokens long")
    drawn = mixing.mixed(lengths, targets)
    at = {i: (s, n) for i, s, n in rows}
    uses = {"big": 1, "small": 3}
    seen = Counter()
    for r in drawn.collect():
        assert at[r.id] == (r.source_name, r.n_tokens) and r.n_tokens > 0 and 1 <= r.uses <= uses[r.source_name]
        seen[r.id] += 1
    assert max(seen.values()) == 1
    got = {r.source_name: r for r in mixing.report(drawn, targets).collect()}
    assert got["absent"].tokens == 0 and abs(got["big"].reached_share - 2 / 3) < 1e-3 and abs(got["small"].reached_share - 1 / 3) < 1e-3
    assert rows_of(mixing.mixed(lengths.repartition(7), targets)) == rows_of(drawn)  # the seed decides, not the layout
    assert mixing.mixed(lengths.limit(0), targets).count() == 0
    short = {r.source_name: r.tokens for r in mixing.report(mixing.mixed(lengths, targets, total=10**9), targets).collect()}
    assert short["small"] == 3 * sum(n for _, s, n in rows if s == "small")


def test_token_lengths(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "a" * 50_000)], "doc_id long, text string")
    got = {r.id: r.n_tokens for r in tokens.token_lengths(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 1000


def share(text):
    import regex

    w = regex.findall(r"\p{L}+", (text or "").lower())
    runs = [tuple(w[i : i + 6]) for i in range(len(w) - 5)]
    return len(runs), (1 - len(set(runs)) / len(runs)) if runs else 0.0


def test_repetition(spark):
    rng = random.Random(3)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    texts = [None, "", "one", " ".join(words[:6]), "Été été. " * 40, "x1y2z3 " * 30] + [" ".join(rng.choice(words) for _ in range(80)) for _ in range(20)] + [" ".join(words[:20]) * 3, (" ".join(words) + " ") * 300]
    df = spark.createDataFrame([(i, t, None if i % 3 else "k", "s") for i, t in enumerate(texts)], "doc_id long, text string, kind string, stratum string")
    got = {r.doc_id: (r._runs, round(r._share, 9)) for r in repetition.measured(df, "text").collect()}
    assert got == {i: (n, round(s, 9)) for i, t in enumerate(texts) for n, s in [share(t)]}
    want = {i for i, t in enumerate(texts) if share(t)[0] >= 12 and share(t)[1] >= 0.3}
    assert {r.doc_id for r in repetition.repeating(df, "doc_id", "text", "kind").collect()} == want and want
    assert repetition.repeating(df.limit(0), "doc_id", "text", "kind").count() == 0


def test_cutoffs_come_from_all_documents(spark):
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    rows = [(None if i % 7 == 0 else i // 2, " ".join(words[:30]) if i % 10 else " ".join(words[:10]) * 4, "k") for i in range(6_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = repetition.cutoffs_for(repetition.scored_for(df, "doc_id", "text", "kind"), "doc_id", "kind").first()
    assert (got.clean, got.repeated, got.caught, got.rejected, got.certified) == (5_400, 600, 600, 0, True)


def test_certified_cutoffs(spark):
    from math import comb

    for k, n, p in ((0, 50, 0.05), (3, 40, 0.1), (7, 7, 0.2)):
        assert abs(repetition.binomial_at_most(k, n, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12
    rows = [("a", 0.05, True)] * 1980 + [("a", 0.12, True)] * 20 + [("a", 0.9, False)] * 50 + [("a", 0.25, False)] * 5 + [("b", 0.1, True)] * 20 + [(None, None, None), (None, None, True)]
    got = {r.stratum: r for r in repetition.certified_cutoffs(spark.createDataFrame(rows, "stratum string, score double, clean boolean"), (0.1, 0.2, 0.3), risk=0.01).collect()}
    assert got["a"].cutoff == 0.2 and got["a"].certified and got["a"].rejected == 0 and got["a"].caught == 55  # 20 of 2000 at 0.1 is no proof of under one in a hundred
    assert not got["b"].certified and got["b"].cutoff == repetition.LIMIT and not got[""].certified


def test_labels_decide_what_repeats(spark):
    """Editors who bear half the text repeated let such documents pass; those who bear none have them rejected."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(6)) for _ in range(500)]

    def text(again):
        w = [rng.choice(words) for _ in range(60)]
        return " ".join(w + w[: int(60 * again)])

    shares = [0.0] * 900 + [0.25] * 60 + [0.5] * 60 + [0.9] * 60
    rows = [(i, text(a), "k") for i, a in enumerate(shares)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    found = {}
    for name, bears in (("none", 0.1), ("half", 0.6)):
        labels = spark.createDataFrame([(i, a < bears) for i, a in enumerate(shares)], "doc_id long, clean boolean")
        found[name] = {r.doc_id for r in repetition.repeating(df, "doc_id", "text", "kind", labels).collect()}
    assert found["none"] == {i for i, a in enumerate(shares) if a > 0}
    assert found["half"] == {i for i, a in enumerate(shares) if a > 0.8}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, data, name):
    got = rows_of(queries.QUERIES[name](spark, data))
    if name in queries.SQL:
        assert got == oracle(queries.SQL[name], data)
    else:
        assert got

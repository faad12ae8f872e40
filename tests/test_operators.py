"""Operators without SQL: the store, the ranking, streams, snapshots; and results under other partitionings."""

import random
from pathlib import Path

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tessera.operators import addressed, chunking, ranking, sketches, store
from tessera.plans import core_problems, reference
from tessera.streaming import jobs


def blobs(spark):
    rng = random.Random(5)
    base = rng.randbytes(6000)
    rows = [("a", 0, base), ("b", 1, base[:3000] + b"edit" + base[3000:]), ("c", 2, base), ("d", 3, rng.randbytes(4000)), ("e", 4, b""), ("f", 5, None)]
    return spark.createDataFrame(rows, "blob_id string, seq long, content binary")


def test_store_round_trip(spark):
    p = store.StoreParams(sizes=chunking.ChunkSizes(64, 256, 1024))
    records, manifest = store.ingest(blobs(spark), p)
    back = {r.blob_id: bytes(r.content) for r in addressed.reassembled(manifest, store.resolved(records, p), "blob_id").collect()}
    assert back == {r.blob_id: bytes(r.content) for r in blobs(spark).collect() if r.content}
    rows = records.collect()
    assert any(r.kind == "delta" for r in rows)
    at = {r.digest: r for r in rows}
    for r in rows:
        assert r.stored_bytes <= r.standalone_baseline_bytes and r.chain_depth <= p.depth
        if r.kind == "delta":
            assert at[r.reference_digest].seq < r.seq and at[r.reference_digest].chain_depth == r.chain_depth - 1
    s = store.stats(records, manifest).first()
    assert s.exact_hits == s.chunk_refs - s.chunks > 0 and s.deltas + s.standalone == s.chunks
    assert sum(r.chunks for r in store.depth_histogram(records, p.depth).collect()) == s.chunks


def test_store_without_deltas(spark):
    records, _ = store.ingest(blobs(spark), store.StoreParams(sizes=chunking.ChunkSizes(64, 256, 1024), depth=0))
    assert {r.kind for r in records.collect()} == {"standalone"}


def test_jaccard_and_search(spark):
    rng = random.Random(2)
    base = rng.randbytes(4000)
    rows = [(0, 0, base), (1, 1, base[:2000] + b"x" + base[2000:]), (2, 2, rng.randbytes(4000)), (3, 3, b"")]
    s = sketches.sketched(spark.createDataFrame(rows, "id long, seq long, content binary"), "content")
    found = sketches.search(s, s).collect()
    assert sorted((r.probe, r.match) for r in found) == [(0, 1), (1, 0)] and all(r.jaccard > 0.9 for r in found)
    assert [(r.probe, r.match) for r in sketches.search(s, s, earlier_only=True).collect()] == [(1, 0)]
    cases = [([], [], 1.0), ([], [1], 0.0), ([1, 2, 3], [2, 3, 4], 2 / 3), ([1, 2], [1, 2, 3, 4], 1.0)]
    df = spark.createDataFrame(cases, "a array<long>, b array<long>, want double")
    assert all(abs(r.j - r.want) < 1e-12 for r in df.select(sketches.jaccard(F.col("a"), F.col("b")).alias("j"), "want").collect())


def test_ranking_equals_picking_from_the_whole_list(spark):
    rng = random.Random(9)
    rows = [(f"o{i:03d}", rng.choice(["a"] * 8 + ["b", "c", None]), rng.randrange(40)) for i in range(150)]
    p = ranking.RankParams(as_of="2019-04-15T00:00:00.000Z", consecutive=2, limit=60)
    got = [(r.object_id, r.author_id) for r in ranking.ranked(spark.createDataFrame(rows, "object_id string, author_id string, score long"), p).orderBy("rank").collect()]
    left, out = sorted(rows, key=lambda r: (-r[2], r[0])), []
    while left and len(out) < p.limit:
        run = out[-2:]
        stop = len(run) == 2 and run[0][1] == run[1][1]
        i = next((i for i, r in enumerate(left) if r[1] != run[0][1]), 0) if stop else 0
        out.append(left.pop(i))
    assert got == [(a, b) for a, b, _ in out]


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p7_found", "cdc_dedup_stats", "crdt_blocks"])
def test_results_do_not_depend_on_partitions(spark, data, name):
    f = {**core_problems.QUERIES, **reference.QUERIES}[name]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = rows_of(f(spark, data))
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert rows_of(f(spark, data)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_streams(spark, data, tmp_path):
    ops = spark.read.parquet(f"{data}/social_ops.parquet")
    ops.repartition(3).write.parquet(str(tmp_path / "ops"))
    stream = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ops"))
    jobs.apply_stream(stream, f"file://{tmp_path}/state", f"{tmp_path}/cp").awaitTermination()
    from tessera.operators.changefeed import current
    from tessera.session import published

    assert rows_of(current(published(spark, f"file://{tmp_path}/state")).select("object_id", "op_id")) == rows_of(core_problems.p1_found(spark, data))


def test_frame_stream(spark, tmp_path):
    spark.createDataFrame([("s", 0), ("s", 1), ("s", 3), ("t", 1)], "session string, n long").coalesce(1).write.parquet(str(tmp_path / "frames"))
    frames = spark.readStream.schema("session string, n long").parquet(str(tmp_path / "frames"))
    q = jobs.frame_faults(frames, "session", "n").writeStream.format("memory").queryName("faults").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("faults").collect()) == [("s", 2, 3), ("t", 0, 1)]


def test_all_matches_of_a_large_group(spark):
    rng = random.Random(5)
    base = rng.randbytes(600)
    texts = [base] * 150 + [base[:k] + b"#" + base[k:] for k in range(0, 600)] + [rng.randbytes(300) for _ in range(20)] + [b"", b"", None, b"abc", b"abc"]
    s = sketches.sketched(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, seq long, content binary"), "content")
    probes = s.filter("id % 20 = 0 or id > 760")
    got = {(r.probe, r.match): r.jaccard for r in sketches.all_matches(probes, s).collect()}
    p = sketches.SketchParams()
    lists = {i: sketches.features(t, p).tolist() for i, t in enumerate(texts) if t}
    keys = {i: {int(k) for _, _, k in zip(*sketches.keys_of(np.array(x, np.uint32), np.zeros(len(x), np.int64), p))} for i, x in lists.items()}

    def estimate(a, b):
        k = min(len(a), len(b))
        return len(set(sorted(set(a) | set(b))[:k]) & set(a) & set(b)) / k

    want = {(a, b): estimate(lists[a], lists[b]) for a in lists if a % 20 == 0 or a > 760 for b in lists if a != b and keys[a] & keys[b]}
    want = {k: j for k, j in want.items() if j >= 0.25}
    assert got.keys() == want.keys() and all(abs(got[k] - j) < 1e-9 for k, j in want.items())
    assert sum(a == 0 for a, _ in got) > 512 and sketches.search(probes, s).filter("probe = 0").count() == 4
    assert sketches.all_matches(probes.limit(0), s).count() == 0


def test_store_counters_and_chain_faults(spark):
    records, manifest = store.ingest(blobs(spark), store.StoreParams(sizes=chunking.ChunkSizes(64, 256, 1024)))
    s, rows = store.stats(records, manifest).first(), records.collect()
    assert s.similarity_queries == s.index_size == len(rows) and s.candidates_examined == sum(r.candidates for r in rows) and s.verification_fallbacks == 0
    assert s.delta_bytes_saved == sum(r.standalone_baseline_bytes - r.stored_bytes for r in rows) and s.stored_bytes_with_manifest == s.stored_bytes + 32 * s.chunk_refs
    chain = [("a", "standalone", None), ("b", "delta", "a"), ("c", "delta", "b"), ("d", "delta", "c"), ("e", "delta", "x"), ("f", "delta", None), ("g", "delta", "h"), ("h", "delta", "g"), ("i", "delta", "i"), ("j", "standalone", "x")]
    got = {r.digest: r.fault for r in store.chain_faults(spark.createDataFrame(chain, "digest string, kind string, reference_digest string"), 2).collect()}
    assert got == {"d": "too_deep", "e": "missing_reference", "f": "missing_reference", "g": "cycle", "h": "cycle", "i": "cycle"}
    assert [r.digest for r in store.listed(records).orderBy("pos").collect()] == [r.digest for r in sorted(rows, key=lambda r: (r.seq, r.digest))]


def test_bounded_search_equals_the_whole_one(spark, monkeypatch):
    rng = random.Random(12)
    texts = [b" ".join(rng.choice([b"harbour ledger", b"hollow choir", b"amber relay", b"northern kiln at dawn"]) for _ in range(rng.randint(0, 6))) for _ in range(120)]
    # few strata with one feature each: many share a key, the bound on candidates binds, and estimates tie
    p, q = sketches.SketchParams(size=8, gram=4, bands=8, rows=1), sketches.SearchParams(limit=5, least=0.1, candidates=9)
    rows = [(i, rng.randrange(60), t) for i, t in enumerate(texts)]
    s = sketches.sketched(spark.createDataFrame(rows, "id long, seq long, content binary"), "content", p).localCheckpoint()
    want = {(r.probe, r.match, r.place): r.jaccard for r in sketches.search(s, s, p, q, earlier_only=True).collect()}
    packed = spark.createDataFrame([(i, seq, sketches.features(t, p).tobytes()) for i, seq, t in rows], "id long, seq long, features binary")
    for bytes_a_pass in (1 << 30, 1):  # one pass, a pass a band
        monkeypatch.setattr(sketches, "_PASS", bytes_a_pass)
        assert {(r.probe, r.match, r.place): r.jaccard for r in sketches.earlier_matches(packed, p, q).collect()} == want


def test_store_leaves_and_holds_little_on_disk(spark, monkeypatch):
    rng = random.Random(13)
    base = rng.randbytes(3000)
    content = [(str(i), i, b"".join(base[k : k + 100] if rng.random() < 0.5 else rng.randbytes(100) for k in range(0, 3000, 100))) for i in range(150)]
    held, most, write, drop = {}, [0], store.materialize, store.discard

    def materialize(df, name):
        out = write(df, name)
        held[out.scratch] = sum(f.stat().st_size for f in Path(out.scratch.removeprefix("file:")).rglob("*.parquet"))
        most[0] = max(most[0], sum(held.values()))
        return out

    def discard(*frames):
        drop(*frames)
        for f in frames:
            held.pop(getattr(f, "scratch", None), None)

    for module in (store, sketches):
        monkeypatch.setattr(module, "materialize", materialize)
        monkeypatch.setattr(module, "discard", discard, raising=False)
    records, _ = store.ingest(spark.createDataFrame(content, "blob_id string, seq long, content binary"), store.StoreParams(sizes=chunking.ChunkSizes(64, 256, 1024)))
    assert records.filter("kind = 'delta'").count() > 50
    whole = sum(len(c) for _, _, c in content)
    assert sum(held.values()) < 1.6 * whole and most[0] < 3.5 * whole, (held, most, whole)

"""Bottom-k sketches of byte windows, their Jaccard estimate, and the banded search over them.

A sketch is the k smallest distinct window features, ascending. Features and band keys are computed in NumPy
batches; estimate, filter and order of the search are built-in expressions and equi-joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.u32 import np_mix32, words
from tessera.session import discard, materialize

# Seeds of the window table, of the strata and of the band keys.
TABLE_SEED, STRATUM_SALT, BAND_SEED = 0x574B5344, 0x574B5354, 0x574B4244
TABLE = words(TABLE_SEED, 256)


@dataclass(frozen=True)
class SketchParams:
    """Sketch length, window bytes, bands and rows a band."""

    size: int = 64
    gram: int = 16
    bands: int = 16
    rows: int = 4

    def __post_init__(self):
        for name, value, most in (("size", self.size, 4096), ("gram", self.gram, 32), ("bands", self.bands, 1024), ("rows", self.rows, 64)):
            if not isinstance(value, int) or not 1 <= value <= most:
                raise ValueError(f"{name} must be from 1 to {most}")
        if self.bands * self.rows > self.size:
            raise ValueError("bands times rows must not exceed the sketch size")


@dataclass(frozen=True)
class SearchParams:
    """Matches kept, smallest estimate, and most candidates scored."""

    limit: int = 4
    least: float = 0.25
    candidates: int = 512


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    n %= 32
    return x if not n else (x << np.uint32(n)) | (x >> np.uint32(32 - n))


def window_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """The cyclic hash of every window, from windows of doubled length."""
    whole, length = None, 0
    power, width = TABLE[data], 1
    while gram:
        if gram & 1:
            if whole is None:
                whole, length = power, width
            else:  # the stretch so far, then this one
                n = len(power) - length
                whole = _rotl(whole[:n], width) ^ power[length : length + n] if n > 0 else whole[:0]
                length += width
        gram >>= 1
        if gram:
            n = max(0, len(power) - width)
            power = _rotl(power[:n], width) ^ power[width : width + n]
            width *= 2
    return whole


def features(value: bytes, p: SketchParams) -> np.ndarray:
    """The sketch: empty for no bytes, one feature of the whole where shorter than a window."""
    if not value:
        return np.zeros(0, np.uint32)
    data = np.frombuffer(value, np.uint8)
    return np.unique(np_mix32(window_hashes(data, min(p.gram, len(data)))))[: p.size]


def batch_features(values: list[bytes], p: SketchParams) -> tuple[np.ndarray, np.ndarray]:
    """features() of all values one after another, and how many each has."""
    size = np.array([len(v) for v in values], np.int64)
    data = np.frombuffer(b"".join(values), np.uint8)
    long = size >= p.gram
    hashes = np_mix32(window_hashes(data, p.gram)) if len(data) >= p.gram else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(values)), size)[: len(hashes)]
    within = np.arange(len(hashes)) < np.cumsum(size)[owner] - p.gram + 1  # no window over two values
    words_ = owner[within].astype(np.uint64) << np.uint64(32) | hashes[within]
    few = [np.uint64(i) << np.uint64(32) | features(values[i], p).astype(np.uint64) for i in np.flatnonzero(~long & (size > 0)).tolist()]
    words_ = np.sort(np.concatenate([words_, *few]))
    words_ = words_[np.append(True, words_[1:] != words_[:-1])] if len(words_) else words_
    owner = (words_ >> np.uint64(32)).astype(np.int64)
    many = np.bincount(owner, minlength=len(values))
    nth = np.arange(len(words_)) - np.repeat(np.cumsum(many) - many, many)
    return words_[nth < p.size].astype(np.uint32), np.minimum(many, p.size)


def sketched(df: DataFrame, content_col: str, p: SketchParams = SketchParams()) -> DataFrame:
    """``df`` with ``features`` ARRAY<BIGINT> in place of the BINARY ``content_col``; null gives an empty sketch."""
    kept = [c for c in df.columns if c != content_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [features(v, p).astype(np.int64) for v in batch.column(content_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.list_(pa.int64()))], names=[*kept, "features"])

    types = dict(df.dtypes)
    return df.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), "features array<bigint>"]))


def jaccard(a: Column, b: Column) -> Column:
    """The estimate from two sketches: of the k smallest of the union, the share in both; k is the shorter length."""
    k = F.least(F.size(a), F.size(b))
    lowest = F.slice(F.array_sort(F.array_union(a, b)), 1, F.greatest(k, F.lit(1)))
    both = F.size(F.array_intersect(lowest, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(k == 0, 0.0).otherwise(both / F.greatest(k, F.lit(1)))


def exact_jaccard(a: Column, b: Column) -> Column:
    """Exact resemblance of two arrays of distinct values; two empty ones have 1."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(either, F.lit(1)))


def keys_of(lists: np.ndarray, owner: np.ndarray, p: SketchParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, band, key) of features given flat with their owners, features ascending within an owner."""
    band = np_mix32(lists ^ np.uint32(STRATUM_SALT)) % np.uint32(p.bands)
    sorts = np.sort((owner.astype(np.uint64) * np.uint64(p.bands) + band) << np.uint64(32) | lists)  # one word: owner, band, feature
    lists, owner, band = sorts.astype(np.uint32), (sorts >> np.uint64(32)) // np.uint64(p.bands), ((sorts >> np.uint64(32)) % np.uint64(p.bands)).astype(np.uint32)
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (band[1:] != band[:-1]))) if len(lists) else np.zeros(0, np.int64)
    arity = np.minimum(np.diff(np.append(first, len(lists))), p.rows)
    key = np_mix32(np_mix32(np.uint32(BAND_SEED) ^ band[first]) ^ arity.astype(np.uint32))
    for r in range(p.rows):
        has = arity > r
        key[has] = np_mix32(key[has] ^ lists[first[has] + r])
    return owner[first].astype(np.int64), band[first].astype(np.int32), key.astype(np.int64)


def band_keys(sketches: DataFrame, p: SketchParams = SketchParams(), id_cols: tuple[str, ...] = ("id",)) -> DataFrame:
    """(id columns, band, band_key): one key per stratum that has features, from its ``rows`` smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features").fill_null([])
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            who, band, key = keys_of(flat, owner, p)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(who)) for c in id_cols), pa.array(band), pa.array(key)], names=[*id_cols, "band", "band_key"])

    types = dict(sketches.dtypes)
    return sketches.select(*id_cols, "features").mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in id_cols), "band int", "band_key bigint"]))


def search(probes: DataFrame, index: DataFrame, p: SketchParams = SketchParams(), q: SearchParams = SearchParams(), earlier_only: bool = False) -> DataFrame:
    """(probe, match, jaccard, place): each probe's best matches in the index.

    Both sides: id, seq (order of arrival), features. Candidates share a band key and are not the probe
    itself; the first ``candidates`` by band and arrival are scored; those of at least ``least`` are ordered by
    estimate and id and the first ``limit`` returned; all_matches() has no such bounds. ``earlier_only`` takes candidates that arrived before the probe.
    """
    a = band_keys(probes, p, ("id", "seq")).select(F.col("id").alias("probe"), F.col("seq").alias("probe_seq"), "band", "band_key")
    b = band_keys(index, p, ("id", "seq")).select(F.col("id").alias("match"), F.col("seq").alias("match_seq"), "band_key")
    met = a.join(b, "band_key").filter("probe <> match")
    if earlier_only:
        met = met.filter("match_seq < probe_seq")
    first = met.groupBy("probe", "match").agg(F.min(F.struct("band", "match_seq")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("probe").orderBy("first", "match"))
    kept = first.withColumn("nth", nth).filter(F.col("nth") <= q.candidates)
    scored = kept.join(probes.select(F.col("id").alias("probe"), F.col("features").alias("fa")), "probe").join(index.select(F.col("id").alias("match"), F.col("features").alias("fb")), "match").select("probe", "match", jaccard(F.col("fa"), F.col("fb")).alias("jaccard")).filter(F.col("jaccard") >= q.least)
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("jaccard"), "match"))
    return scored.withColumn("place", place).filter(F.col("place") <= q.limit)


def all_matches(probes: DataFrame, index: DataFrame, p: SketchParams = SketchParams(), least: float = 0.25) -> DataFrame:
    """(probe, match, jaccard): every pair of a probe and another row of the index that share a band key and have an estimate of at least ``least``.

    Both sides: id, features. Nothing is capped: rows of equal features are searched and scored once, by their smallest id,
    and every candidate is scored; then all rows of the two groups pair up. Equal rows have estimate 1; empty sketches have no matches.
    """
    sides = probes.select("id", "features", F.lit(True).alias("asks")).unionByName(index.select("id", "features", F.lit(False).alias("asks"))).filter(F.size("features") > 0)
    groups = materialize(sides.groupBy("features").agg(F.min("id").alias("group"), F.max("asks").alias("asks"), F.max(~F.col("asks")).alias("held")), "sketch_groups")
    members = materialize(sides.join(groups.select("features", "group"), "features").select("id", "group", "asks").distinct(), "sketch_members")
    keys = band_keys(groups.select(F.col("group").alias("id"), "features"), p)
    keys = materialize(keys.join(groups.select(F.col("group").alias("id"), "asks", "held"), "id").select("id", "band_key", "asks", "held"), "sketch_keys")
    met = keys.filter("asks").select(F.col("id").alias("ga"), "band_key").join(keys.filter("held").select(F.col("id").alias("gb"), "band_key"), "band_key").select("ga", "gb").distinct()
    scored = met.join(groups.select(F.col("group").alias("ga"), F.col("features").alias("fa")), "ga").join(groups.select(F.col("group").alias("gb"), F.col("features").alias("fb")), "gb").select("ga", "gb", jaccard(F.col("fa"), F.col("fb")).alias("jaccard")).filter(F.col("jaccard") >= least)
    asking, held = members.filter("asks").select(F.col("group").alias("ga"), F.col("id").alias("probe")), members.filter(~F.col("asks")).select(F.col("group").alias("gb"), F.col("id").alias("match"))
    return scored.join(asking, "ga").join(held, "gb").filter("probe <> match").select("probe", "match", "jaccard")


#: Bytes of postings that one pass of earlier_matches() is meant to shuffle; there are at most as many passes as bands.
_PASS = 96 << 20
#: Pairs that are scored at once.
_AT_ONCE = 1 << 15
_MET = "probe bigint, band int, found int, hits array<struct<nth:int,match:bigint,jaccard:double>>"


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of packed sketches one after another, and how many each has."""
    lists = lists.cast(pa.large_binary()) if not pa.types.is_large_binary(lists.type) else lists
    at = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1]
    data = lists.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.uint32) if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint32), np.diff(at) // 4


def _estimates(fa: np.ndarray, na: np.ndarray, fb: np.ndarray, nb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, estimates) of those pairs of padded sketches that have at least ``least``."""
    both = np.concatenate([fa, fb], axis=1)
    both.sort(axis=1)
    k, at = np.maximum(np.minimum(na, nb), 1), np.arange(1, both.shape[1])
    same = both[:, 1:] == both[:, :-1]
    short = np.flatnonzero(na + nb < both.shape[1])
    same[short] &= at < (na + nb)[short, None]  # the rest is padding
    rows = np.flatnonzero(same.sum(axis=1) / k >= least)
    same, k = same[rows], k[rows]
    place = at - 1 - (np.cumsum(same, axis=1) - same)  # in the union, ascending
    estimate = (same & (place < k[:, None])).sum(axis=1) / k
    good = estimate >= least
    return rows[good], estimate[good]


def _met(p: SketchParams, q: SearchParams):
    """Of postings ordered by key, arrival and id: what each asking posting newly meets among the earliest of its key, and the hits of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            fresh = np.ones(len(t), bool)
            if held is not None:
                fresh = np.append(np.zeros(len(held), bool), fresh)
                t = pa.concat_tables([held, t]).combine_chunks()
            key, seq, who, band = (t.column(c).to_numpy() for c in ("band_key", "seq", "id", "band"))
            n = len(t)
            lists, size = _flat(t.column("features").combine_chunks())
            owner = np.repeat(np.arange(n), size)
            feats = np.full((n, p.size), 0xFFFFFFFF, np.uint32)
            feats[owner, np.arange(len(lists)) - np.repeat(np.cumsum(size) - size, size)] = lists
            o, b, k = keys_of(lists, owner, p)
            keys, there = np.zeros((n, p.bands), np.uint32), np.zeros((n, p.bands), bool)
            keys[o, b], there[o, b] = k.astype(np.uint32), True
            mixed = np.array([min(x) if x else p.bands for x in t.column("mixed").to_pylist()])
            new_key = np.append(True, key[1:] != key[:-1])
            new_seq = new_key | np.append(True, seq[1:] != seq[:-1])
            index = new_seq | np.append(True, who[1:] != who[:-1])  # a row whose two bands have one key is held once
            before = np.append(0, np.cumsum(index))
            group = np.maximum.accumulate(np.where(new_key, np.arange(n), 0))
            tie = np.maximum.accumulate(np.where(new_seq, np.arange(n), 0))
            kept = np.flatnonzero(index)
            asking = np.flatnonzero(fresh & (band >= 0))
            many = np.minimum(before[tie[asking]] - before[group[asking]], q.candidates)
            asking, many = asking[many > 0], many[many > 0]
            last = group[-1] + np.flatnonzero(index[group[-1] :])[: q.candidates]
            held = t.take(pa.array(last))
            out: list[tuple] = []
            begin = 0
            ends = np.cumsum(many)
            while begin < len(asking):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _AT_ONCE, "right")))
                a, m = asking[begin:end], many[begin:end]
                nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                i = np.repeat(np.arange(len(a)), m)
                probe, match = a[i], kept[before[group[a]][i] + nth]
                low = int(band[a].max())
                seen = ((keys[probe, :low] == keys[match, :low]) & there[probe, :low] & there[match, :low] & (np.arange(low) < band[probe][:, None])).any(axis=1)
                odd = np.flatnonzero((mixed[probe] < band[probe]) & ~seen)  # an earlier band's key may be another band's key of the match
                for x in range(0, len(odd), 1024):
                    pr, ma = probe[odd[x : x + 1024]], match[odd[x : x + 1024]]
                    asked = there[pr] & (np.arange(p.bands) < band[pr][:, None])
                    seen[odd[x : x + 1024]] = ((keys[pr][:, :, None] == keys[ma][:, None, :]) & asked[:, :, None] & there[ma][:, None, :]).any(axis=(1, 2))
                i, probe, match = i[~seen], probe[~seen], match[~seen]
                first = np.searchsorted(i, np.arange(len(a) + 1))
                nth = np.arange(len(i)) - first[i]
                found = np.bincount(i, minlength=len(a))
                rows, estimate = _estimates(feats[probe], size[probe], feats[match], size[match], q.least)
                hits: dict[int, list] = {}
                for x, g, e in zip(i[rows].tolist(), zip(nth[rows].tolist(), who[match[rows]].tolist()), estimate.tolist()):
                    hits.setdefault(x, []).append({"nth": g[0], "match": g[1], "jaccard": e})
                out += [(w, bb, f, hits.get(x)) for x, (w, bb, f) in enumerate(zip(who[a].tolist(), band[a].tolist(), found.tolist())) if f]
                begin = end
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("nth", pa.int32()), ("match", pa.int64()), ("jaccard", pa.float64())])))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=["probe", "band", "found", "hits"])

    return run


def _listed(ids: np.ndarray, bitmaps: dict[int, bytes]) -> np.ndarray:
    """Which ids are set in bitmaps by bucket, numbered as Spark's bitmap functions do."""
    bucket, bit = np.where(ids > 0, 1 + (ids - 1) // 32768, ids // 32768), np.where(ids > 0, (ids - 1) % 32768, -ids % 32768)
    out = np.zeros(len(ids), bool)
    for x in np.unique(bucket).tolist():
        if x in bitmaps:
            own = bucket == x
            out[own] = np.frombuffer(bitmaps[x], np.uint8)[bit[own] // 8] >> (bit[own] % 8) & 1
    return out


def earlier_matches(s: DataFrame, p: SketchParams = SketchParams(), q: SearchParams = SearchParams()) -> DataFrame:
    """(probe, match, jaccard, place): what search(s, s, p, q, earlier_only=True) gives, on disk of a bounded share of ``s``.

    ``s``: id BIGINT, one row each and in the order that breaks ties, seq BIGINT, features BINARY (ascending, four bytes each). Sketches
    travel to the keys that they share and are scored there, in passes over ascending bands; a probe that has all its candidates asks no more. As
    candidates count by band and arrival, only the ``candidates`` earliest of a key can ever be one. Keys that occur in several bands go to every pass.
    """
    empty = "probe bigint, match bigint, jaccard double"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, size = _flat(batch.column("features"))
            o, b, k = keys_of(lists, np.repeat(np.arange(len(size)), size), p)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(o)), pa.array(b.astype(np.int16)), pa.array(k.astype(np.uint32).view(np.int32))], names=["id", "band", "band_key"])

    one = Window.partitionBy("band_key")
    shared = s.select("id", "features").mapInArrow(keyed, "id bigint, band smallint, band_key int").withColumns({"n": F.count("*").over(one), "mixed": F.min("band").over(one) < F.max("band").over(one)}).filter("n > 1")
    shared = shared.groupBy("id").agg(F.collect_list(F.col("band").cast("int")).alias("shared"), F.collect_list(F.when(F.col("mixed"), F.col("band").cast("int"))).alias("mixed"))
    shared = materialize(s.select("id", "seq", "features").join(shared, "id"), "shared_keys")
    postings = shared.agg(F.sum(F.size("shared"))).first()[0] or 0
    passes = max(1, min(p.bands, -(-postings * (4 * p.size + 48) // _PASS)))
    best = s.sparkSession.createDataFrame([], empty)
    taken, full = None, {}
    for n in range(passes):
        low, high = n * p.bands // passes, (n + 1) * p.bands // passes

        def posted(batches: Iterator[pa.RecordBatch], low=low, high=high, full=s.sparkSession.sparkContext.broadcast(full)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists, size = _flat(batch.column("features"))
                o, b, k = keys_of(lists, np.repeat(np.arange(len(size)), size), p)
                wanted, every = np.zeros((2, len(size), p.bands), bool)
                for to, name in ((wanted, "shared"), (every, "mixed")):
                    c = batch.column(name)
                    to[np.repeat(np.arange(len(size)), c.value_lengths().to_numpy(zero_copy_only=False)), c.flatten().to_numpy(zero_copy_only=False)] = True
                asks = (b >= low) & (b < high) & ~_listed(batch.column("id").to_numpy(), full.value)[o]
                go = (wanted[o, b] & (b >= low) & (b < high)) | every[o, b]
                rows = pa.array(o[go])
                yield pa.RecordBatch.from_arrays([pa.array(k[go]), *(batch.column(c).take(rows) for c in ("seq", "id")), pa.array(np.where(asks[go], b[go], -1).astype(np.int32)), *(batch.column(c).take(rows) for c in ("mixed", "features"))], names=["band_key", "seq", "id", "band", "mixed", "features"])

        posts = shared.mapInArrow(posted, "band_key bigint, seq bigint, id bigint, band int, mixed array<int>, features binary")
        met = materialize(posts.repartition("band_key").sortWithinPartitions("band_key", "seq", "id").mapInArrow(_met(p, q), _MET), "met")
        had = met.join(taken.select(F.col("id").alias("probe"), "taken"), "probe", "left").withColumn("taken", F.coalesce("taken", F.lit(0))) if taken else met.withColumn("taken", F.lit(0))
        earlier = F.coalesce(F.sum("found").over(Window.partitionBy("probe").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hits = had.withColumn("before", F.col("taken") + earlier).filter("size(hits) > 0").select("probe", "before", F.explode("hits").alias("h")).filter(F.col("before") + F.col("h.nth") < q.candidates).select("probe", "h.match", "h.jaccard")
        place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("jaccard"), "match"))
        better = materialize(best.select("probe", "match", "jaccard").unionByName(hits).withColumn("place", place).filter(F.col("place") <= q.limit), "matches")
        counted = taken
        if n + 1 < passes:
            now = met.select(F.col("probe").alias("id"), F.col("found").cast("long").alias("taken"))
            taken = materialize((now.unionByName(counted) if counted else now).groupBy("id").agg(F.sum("taken").alias("taken")), "taken")
            bits = taken.filter(F.col("taken") >= q.candidates).groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
            full = {r.bucket: bytes(r.bits) for r in bits.toLocalIterator()}  # a bit for each chunk at most
        discard(best, met, *filter(None, [counted]))
        best = better
    discard(shared)
    return best

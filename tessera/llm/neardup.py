"""Near-duplicate byte contents by an exact metric-space join under the Jaccard distance.

A content is the set of its distinct runs of ``WIDTH`` bytes; the distance 1 - |A and B| / |A or B| is a metric.
Contents that agree in a mark (four min-hashes) choose the one of smallest id as a *pivot*. Every other content
learns its distance to all pivots near it and belongs to the Voronoi region of the nearest, if that lies within
a third of the threshold; so two contents of one region are near each other by the triangle inequality alone. A region's
window is its radius plus the threshold: whatever lies in it is replicated into the region, as only that can be near
one of the region's own contents. Of a region's own and a replicated content the triangle inequality settles most
pairs from the distances to the pivot, and the rest are measured; a pair that two regions see counts in the one of
smaller pivot. Contents of no region are joined with each other recursively, with other marks, until every one is a
pivot.

A content that shares its mark with none is a pivot of radius 0: its window is the threshold, and what lies in it is
a result at once. Unrelated contents are all at distance near 1, so a few sampled pivots would have windows that
replicate everything everywhere; which pivots are near a content is therefore found exactly with prefix postings
(rarest runs first): if two sets of n and m runs share t / (1 + t) (n + m), they share some of the first n - t n + 1
and m - t m + 1.

Skew: equal contents of one key are one row before anything else. Of a family of near-copies only pivots are held, so
the others meet a few of them and not each other. Postings travel as blocks of one batch and target, and the reducer
counts the runs that two contents share, a bounded number of collisions at a time, and hands on what it finds at once.
A target is a class of runs by hash and a band of sizes: a pivot is held in the band of its size, and a content asks in the
bands of the sizes it can be near. A larger input has more bands of the same bytes and not more classes, so a task holds as
much and a class still counts enough of a pair's runs to tell. What is posted grows with the bands a content asks in; the
bands are therefore joined in passes, and one pass's postings travel at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import discard, materialize

WIDTH = 8
#: Counters of the frequency table, a fixed size whatever the data.
_COUNTERS = 1 << 18
_COUNTER_SHIFT = np.uint64(46)
#: Classes of runs by hash: a pair within the distance shares at least its mean in one of them. Few, whatever the input, so that this mean is over one run.
_CLASSES = 12
#: Bytes of contents in one band of sizes, and run collisions counted at once; both bound a task's memory, whatever the input.
_BAND_BYTES, _AT_ONCE = 64 << 20, 1_000_000
#: Bands that a content asks in, in the mean, up to which all bands are joined at once; beyond, in so many times more passes.
_ASKED_AT_ONCE = 2
#: Share of a content's runs that are posted beyond the fewest; more only proposes fewer pairs to measure.
_FURTHER = 0.1
#: Levels of the recursion; at the last every content is a pivot.
_LEVELS = 3
#: Contents that share a mark, up to which their roles go to the tasks with the code (16 bytes each); beyond, by a join.
_ROLES_SENT = 1_000_000
#: Roles: a member looks for its region, a single pivot has none but itself, a pivot of several has a region.
_MEMBER, _SINGLE, _SHARED = 0, 1, 2
_EPS = 1e-9


def all_runs(content) -> np.ndarray:
    """Every 8-byte run in its place; each is one 64-bit number, so equality is exact."""
    n = len(content) - WIDTH + 1
    return np.ndarray(n, "<u8", content, strides=(1,)).copy() if n > 0 else np.zeros(0, np.uint64)


def runs_of(content) -> np.ndarray:
    """The distinct 8-byte runs, sorted."""
    x = all_runs(content)
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def bytes_of(column: pa.Array) -> list[memoryview | None]:
    """The binaries of a column without a copy; None where null."""
    return [memoryview(x.as_buffer()) if x.is_valid else None for x in column]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit avalanche of every element."""
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def _signatures(level: int, counted: bool):
    """(id, mark) of each content, a mark being four min-hashes; last, with ``counted``, the partition's counters."""
    names = ["id", "mark", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_COUNTERS, np.int64)
        for batch in batches:
            runs = [runs_of(c) for c in bytes_of(batch.column("content"))]
            size = np.array([len(x) for x in runs], np.int64)
            mark, some = np.zeros(len(runs), np.uint64), size > 0
            if some.any():
                h = mixed(np.concatenate(runs))
                if counted:
                    counts += np.bincount((h >> _COUNTER_SHIFT).astype(np.int64), minlength=_COUNTERS)
                begin = (np.cumsum(size) - size)[some]
                for i in range(4 * level, 4 * level + 4):
                    mark[some] = mixed(mark[some] ^ np.minimum.reduceat(h * np.uint64(2 * i + 3) ^ (h >> np.uint64(2 * i + 9)), begin))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(mark.view(np.int64), mask=~some), pa.nulls(len(runs), pa.binary())], names=names)
        if counted:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([counts.tobytes()])], names=names)

    return run


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_COUNTERS, np.int64)
    for batch in batches:
        for c in batch.column("counts"):
            total += np.frombuffer(c.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["counts"])


def summed_counters(counts: DataFrame) -> np.ndarray:
    """Adds up the partitions' counters in two steps; the sum has a fixed size."""
    steps = counts.repartition(8).mapInArrow(_sum_counts, "counts binary").coalesce(1).mapInArrow(_sum_counts, "counts binary")
    return np.frombuffer(steps.first()[0], np.int64)


def measured(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with ``d``, the distance of their contents (id, content)."""
    one = pairs.join(contents.select(F.col("id").alias("a"), F.col("content").alias("content_a")), "a")
    two = one.join(contents.select(F.col("id").alias("b"), F.col("content").alias("content_b")), "b")
    kept = [c for c in pairs.columns if c not in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[int, np.ndarray] = {}

            def of(i, content):
                if (got := sets.get(i)) is None:
                    got = sets[i] = runs_of(content)
                return got

            d = [1.0 - similarity(of(a, x), of(b, y)) for a, x, b, y in zip(batch.column("a").to_pylist(), bytes_of(batch.column("content_a")), batch.column("b").to_pylist(), bytes_of(batch.column("content_b")))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(batch.column(c) for c in kept), pa.array(d, pa.float64())], names=["a", "b", *kept, "d"])

    types = dict(pairs.dtypes)
    return two.mapInArrow(run, ", ".join(["a long", "b long", *(f"{c} {types[c]}" for c in kept), "d double"]))


def rarer_first(counters: np.ndarray) -> np.ndarray:
    """The rank of each counter."""
    order = np.empty(_COUNTERS, np.uint64)
    order[np.argsort(counters, kind="stable")] = np.arange(_COUNTERS, dtype=np.uint64)
    return order


def first_runs(size: np.ndarray, t: np.ndarray | float, least: int = 0) -> np.ndarray:
    """How many of its first runs a content of ``size`` posts: those that no partner of similarity t and ``least`` runs or more can all lack, and some more, so that it must share several."""
    both = np.maximum(t * size, t / (1 + t) * (size + least))
    return np.clip(size - np.ceil(both - _EPS).astype(np.int64) + 1 + np.ceil(_FURTHER * size).astype(np.int64), 0, size)


def first_runs_of_smaller(size: np.ndarray, t: float) -> np.ndarray:
    """The same where only partners of at least its size ask for it."""
    return first_runs(size, 2 * t / (1 + t))


def ranks_of(content, order: np.ndarray) -> np.ndarray:
    """The runs' places in the common order, unsorted: their counter's rank, then the hash's other 46 bits."""
    h = mixed(runs_of(content))
    return (order[(h >> _COUNTER_SHIFT).astype(np.int64)] << _COUNTER_SHIFT) | (h & np.uint64((1 << 46) - 1))


def blocks_of(parts: int, ids: np.ndarray, label: np.ndarray, size: np.ndarray, owner: np.ndarray, ranks: np.ndarray, flag: np.ndarray, first: int = 0) -> pa.RecordBatch:
    """(part, block) of a batch's postings, parts counted from ``first``: per target the contents' headers (id, label, size) and the tokens with a flag each.

    The 46 bits of a hash split into the partition and the token, of 31 bits; other bits are used only beyond 32,768 partitions.
    """
    x = ranks & np.uint64((1 << 46) - 1)
    whole = x // np.uint64(parts)
    part = (x - whole * np.uint64(parts)).astype(np.int64)
    token = ((whole & np.uint64(0x7FFFFFFF)).astype(np.uint32) << np.uint32(1)) | flag.astype(np.uint32)
    at = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[at], np.arange(parts + 1))
    out_part, out_block = [], []
    for p in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
        take = at[bounds[p] : bounds[p + 1]]
        own = owner[take]
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        who, count = own[begin], np.diff(np.append(begin, len(own)))
        out_part.append(first + p)
        out_block.append(packed(ids[who], label[who], size[who], count, token[take]))
    return pa.RecordBatch.from_arrays([pa.array(out_part, pa.int64()), pa.array(out_block, pa.binary())], names=["part", "block"])


#: Widths in which a block's columns are kept, as differences from their smallest value: with many parts a content has a header for nearly every run.
_WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)


def packed(ids: np.ndarray, label: np.ndarray, size: np.ndarray, count: np.ndarray, token: np.ndarray) -> bytes:
    """One block: the contents' columns, how many tokens each has, and the tokens with their flag."""
    least, widths, columns = [], 0, []
    for i, x in enumerate((ids, label, size, count)):
        low = int(x.min()) if len(x) else 0
        x = (x.astype(np.int64) - low).view(np.uint64)
        width = int(np.searchsorted((1 << 8, 1 << 16, 1 << 32), int(x.max()) if len(x) else 0, "right"))
        least.append(low)
        widths |= width << 2 * i
        columns.append(x.astype(_WIDTHS[width]).tobytes())
    return b"".join([np.array([len(ids), len(token), widths, *least], np.int64).tobytes(), token.tobytes(), *columns])


def read_blocks(column) -> tuple[np.ndarray, ...]:
    """ids, labels, sizes of the contents of some blocks, and (owner, token, flag) of their postings."""
    kinds = (np.int64, np.int32, np.int32, np.int32)
    raws = bytes_of(column)
    counts = [np.frombuffer(raw, np.int64, 2).tolist() for raw in raws]
    heads, tokens = [np.empty(sum(n for n, _ in counts), k) for k in kinds], np.empty(sum(m for _, m in counts), np.uint32)
    head = run = 0
    for raw, (n, m) in zip(raws, counts):
        widths, *least = np.frombuffer(raw, np.int64, 5, 16).tolist()
        tokens[run : run + m] = np.frombuffer(raw, np.uint32, m, 56)
        at = 56 + 4 * m
        for i, (out, low) in enumerate(zip(heads, least)):
            x = np.frombuffer(raw, _WIDTHS[widths >> 2 * i & 3], n, at)
            out[head : head + n] = x.astype(np.int64) + low
            at += x.nbytes
        head, run = head + n, run + m
    ids, label, size, count = heads
    return ids, label, size.astype(np.int64), np.repeat(np.arange(len(ids)), count), tokens >> np.uint32(1), (tokens & np.uint32(1)) > 0


def met_again(token: np.ndarray) -> np.ndarray:
    """Where the tokens are that occur more than once, ascending. Most runs of most contents occur once."""
    x = token.astype(np.uint64) << np.uint64(32) | np.arange(len(token), dtype=np.uint64)
    x.sort()
    same = x[1:] >> np.uint64(32) == x[:-1] >> np.uint64(32)
    again = np.append(same, False) | np.append(False, same) if len(x) else np.zeros(0, bool)
    at = (x[again] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at.sort()
    return at


def by_part(run, schema: pa.Schema):
    """``run`` for each part of a task's rows; the rows of a part must be in one task."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("block")):
                held.setdefault(part, []).append(block)
        for part in sorted(held):
            for table in run(part, held.pop(part)):
                yield from table.cast(schema).to_batches()

    return every


def _bands(contents: DataFrame, most: int = 0) -> np.ndarray:
    """Sizes at which the bands begin, the first at 0: each has about ``most`` bytes (else ``_BAND_BYTES``), unless one 64th of a doubling has more."""
    most = most or _BAND_BYTES
    step = F.floor(F.log2(F.greatest(F.octet_length("content"), F.lit(1)).cast("double")) * 64)
    rows = contents.groupBy(step.alias("step")).agg(F.sum(F.octet_length("content").cast("long")).alias("bytes")).orderBy("step").collect()  # a row per step
    begin, held = [0], 0
    for r in rows:
        if held and held + r.bytes > most:
            begin.append(int(np.ceil(2.0 ** (r.step / 64))) - WIDTH + 1)
            held = 0
        held += r.bytes
    return np.unique(np.maximum(begin, 0))


def _band_of(bands: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.searchsorted(bands, size, "right") - 1


def _asked_in(bands: np.ndarray, size: np.ndarray, member: np.ndarray, threshold: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The first and last band in which contents ask: members for all pivots, pivots for smaller ones."""
    t = np.where(member, threshold - reach, threshold)
    last = np.where(member, np.floor(size / t + _EPS).astype(np.int64), size)
    return _band_of(bands, np.ceil(t * size - _EPS).astype(np.int64)), _band_of(bands, last)


def _posted(role: np.ndarray, size: np.ndarray, guest: np.ndarray, least: int, threshold: float, reach: float) -> np.ndarray:
    """How many first runs contents post in a band that begins at ``least``: pivots of the band for all who ask, others (``guest``) for the band's sizes."""
    wide = threshold - reach
    held = first_runs(size, np.where(role == _SINGLE, threshold, wide))
    return np.where(guest, first_runs(size, np.where(role == _MEMBER, wide, threshold), least), held)


def _passes(bands: np.ndarray, threshold: float, reach: float) -> list[range]:
    """The bands in runs of neighbours that are joined at a time."""
    low, high = _asked_in(bands, np.maximum(bands, 1), np.zeros(len(bands), bool), threshold, reach)
    asked = (high - low + 1).mean()
    step = -(-len(bands) // max(1, round(asked / _ASKED_AT_ONCE)))
    return [range(i, min(i + step, len(bands))) for i in range(0, len(bands), step)]


def _postings(order: np.ndarray, threshold: float, reach: float, bands: np.ndarray, now: range, roles: tuple[np.ndarray, np.ndarray] | None):
    """Posting blocks of the contents' first runs in the bands ``now``. ``roles``: ids in order and their roles, all others are single pivots; None: a column has them.

    The label is the role, and 4 more where a content only asks. The flag of a token tells whether it is among those that a larger pivot asks for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            if roles is None:
                role = batch.column("role").to_numpy()
            else:
                role = np.full(len(ids), _SINGLE)
                if len(roles[0]):
                    at = np.minimum(np.searchsorted(roles[0], ids), len(roles[0]) - 1)
                    known = roles[0][at] == ids
                    role[known] = roles[1][at[known]]
            ranks = [ranks_of(c, order) for c in bytes_of(batch.column("content"))]
            size = np.array([len(x) for x in ranks], np.int64)
            member = role == _MEMBER
            most = first_runs(size, np.where(role == _SINGLE, threshold, threshold - reach))
            kept = [np.zeros(0, np.uint64)]
            for x, k in zip(ranks, most.tolist()):
                if k:
                    x.partition(k - 1)
                    x = x[:k]
                    x.sort()
                kept.append(x[:k])
            every, begin = np.concatenate(kept), np.cumsum(most) - most
            early = np.minimum(most, first_runs_of_smaller(size, threshold))
            own = _band_of(bands, size)
            low, high = _asked_in(bands, size, member, threshold, reach)
            for band in now:
                guest = member | (own != band)
                here = np.flatnonzero(((low <= band) & (band <= high) | ~guest) & (size > 0))
                if not len(here):
                    continue
                n = _posted(role[here], size[here], guest[here], int(bands[band]), threshold, reach)
                owner = np.repeat(here, n)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                yield blocks_of(_CLASSES, ids, role + 4 * guest, size, owner, every[begin[owner] + place], place < early[owner], band * _CLASSES)

    return run


def spans(low: np.ndarray, high: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for all j from low[i] to high[i] - 1, in pieces of about ``most``."""
    n = high - low
    ends, start = np.cumsum(n), 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        m = n[start:stop]
        yield np.repeat(np.arange(start, stop), m), np.repeat(low[start:stop] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        start = stop


def in_pieces(who: np.ndarray, n: np.ndarray) -> Iterator[slice]:
    """Slices of the askers ``who``, in order, with about ``_AT_ONCE`` collisions ``n``; a content is in one."""
    if len(who):
        begin = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        ends, at = np.cumsum(np.add.reduceat(n, begin)), 0
        begin = np.append(begin, len(who))
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE, "right")))
            yield slice(int(begin[at]), int(begin[stop]))
            at = stop


def _meet(threshold: float, reach: float, bands: np.ndarray):
    """One class and band of the postings: pairs (a, b) of a content and a pivot of the band that share enough first runs here; ``window`` where b has a region and a may be in its window.

    Pivots ask for pivots, the larger (of equal sizes the larger id) for the smaller; members ask for all pivots. A pair within the
    distance shares at least the mean of what it must in one class, so what shares less in this one is left to the others.
    """
    wide = threshold - reach
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("window", pa.bool_())])

    def run(part: int, blocks) -> Iterator[pa.Table]:
        ids, role, size, owner, token, early = read_blocks(blocks)
        guest, role = role >= 4, role & 3
        keep = met_again(token)
        owner, token, early = owner[keep], token[keep].astype(np.int64) << 32, early[keep]
        asked = _posted(role, size, guest, int(bands[part // _CLASSES]), threshold, reach)
        smaller = np.minimum(asked, first_runs_of_smaller(size, threshold))
        pivot, here = role[owner] != _MEMBER, ~guest[owner]
        for member in (False, True):
            held = np.flatnonzero(here if member else here & early)
            shelf = token[held] | size[owner[held]]
            sort = np.argsort(shelf)
            shelf, shelf_owner = shelf[sort], owner[held[sort]]
            mine = np.flatnonzero(pivot != member)
            who, key = owner[mine], token[mine]
            n, t = size[who], wide if member else threshold
            low = np.searchsorted(shelf, key | np.ceil(t * n - _EPS).astype(np.int64), "left")
            high = np.searchsorted(shelf, key | (np.floor(n / t + _EPS).astype(np.int64) if member else n), "right")
            for this in in_pieces(who, high - low):
                asking, first, found = who[this], who[this.start], [np.zeros(0, np.int64)]
                for i, j in spans(low[this], high[this]):
                    a, b = asking[i], shelf_owner[j]
                    if not member:
                        ok = (size[b] < size[a]) | (ids[b] < ids[a])
                        a, b = a[ok], b[ok]
                    found.append((a - first) * len(ids) + b)
                pairs, shared = np.unique(np.concatenate(found), return_counts=True)
                a, b = pairs // len(ids) + first, pairs % len(ids)
                window = (role[b] == _SHARED) & member
                t = np.where(window, wide, threshold)
                both = np.ceil(t / (1 + t) * (size[a] + size[b]) - _EPS)
                must = np.maximum(1, both - np.maximum(size[a] - asked[a], size[b] - (asked if member else smaller)[b]))
                ok = (shared * _CLASSES >= must) & (np.minimum(size[a], size[b]) >= t * np.maximum(size[a], size[b]) - _EPS)
                if ok.any():
                    yield pa.table([ids[a[ok]], ids[b[ok]], window[ok]], schema=schema)

    return by_part(run, schema)


def _roles(signed: DataFrame) -> DataFrame:
    """(id, role) of the contents that share a mark."""
    groups = signed.filter("mark is not null").groupBy("mark").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).filter("n > 1").select("mark", "pivot")
    return signed.join(groups, "mark").select("id", F.when(F.col("id") == F.col("pivot"), _SHARED).otherwise(_MEMBER).alias("role"))


def _inside(spokes: DataFrame, home: DataFrame, near: float) -> DataFrame:
    """(a, b, sure): the pairs of two members that a region finds, from the distances to its pivot."""
    radius = home.groupBy("p").agg(F.max("d").alias("radius"))
    rows = spokes.filter("window").select(F.col("b").alias("p"), F.col("a").alias("id"), "d").join(radius, "p").filter(F.col("d") <= F.col("radius") + near + _EPS).select("p", "id", "d")
    rows = rows.join(home.select("id", F.col("p").alias("home")), "id", "left")
    x = rows.filter("home = p").select("p", F.col("id").alias("a"), F.col("d").alias("da"))
    y = rows.select("p", F.col("id").alias("b"), F.col("d").alias("db"), "home")
    pairs = x.join(y, "p").filter(F.when(F.col("home") == F.col("p"), F.col("a") < F.col("b")).otherwise(F.col("home").isNull() | (F.col("p") < F.col("home"))))
    return pairs.filter(F.abs(F.col("da") - F.col("db")) <= near + _EPS).select("a", "b", (F.col("da") + F.col("db") <= near - _EPS).alias("sure"))


def _joined(contents: DataFrame, threshold: float, links: bool = False) -> DataFrame:
    """(a, b): all pairs of ``contents`` (id, content) within the distance, each once.

    With ``links`` without those of two contents that are both linked to their pivot anyway: as many as a region has members, and the
    same groups.
    """
    near = 1.0 - threshold
    reach = near / 3
    order, results, active = None, [], contents
    for level in range(_LEVELS):
        roles, sent, posted = None, (np.zeros(0, np.int64), np.zeros(0, np.int32)), active
        if level + 1 < _LEVELS or order is None:
            signed = materialize(active.mapInArrow(_signatures(level, order is None), "id long, mark long, counts binary"), "signatures")
            if order is None:
                order = rarer_first(summed_counters(signed.filter("counts is not null").select("counts")))
            roles = materialize(_roles(signed.select("id", "mark")), "roles")
            discard(signed)
            if roles.count() <= _ROLES_SENT:
                table = roles.toArrow().sort_by("id")
                sent = table.column("id").to_numpy(), table.column("role").to_numpy()
            else:
                sent, posted = None, active.join(roles, "id", "left").withColumn("role", F.coalesce("role", F.lit(_SINGLE)))
        bands, parts = _bands(active), []
        for now in _passes(bands, threshold, reach):
            blocks = posted.mapInArrow(_postings(order, threshold, reach, bands, now, sent), "part long, block binary")
            met = blocks.repartitionById(_CLASSES * len(now), F.col("part").cast("int") - now.start * _CLASSES).mapInArrow(_meet(threshold, reach, bands), "a long, b long, window boolean")
            parts.append(materialize(met.groupBy("a", "b").agg(F.bool_or("window").alias("window")), "met"))
        met = reduce(DataFrame.unionByName, parts)  # a pair meets in the band of b only
        spokes = materialize(measured(met, contents).filter(F.col("d") <= near + _EPS + F.when(F.col("window"), reach).otherwise(0.0)), "spokes")
        discard(*parts)
        results.append(spokes.filter(F.col("d") <= near + _EPS).select("a", "b"))
        if roles is None:
            break
        home = spokes.filter(F.col("window") & (F.col("d") <= reach)).groupBy(F.col("a").alias("id")).agg(F.min(F.struct("d", F.col("b").alias("p"))).alias("h")).select("id", "h.p", "h.d")
        home = materialize(home, "regions")
        pairs = materialize(_inside(spokes, home, near), "inside")
        if not links:
            results.append(pairs.filter("sure").select("a", "b"))
        results.append(measured(pairs.filter("not sure").select("a", "b"), contents).filter(F.col("d") <= near + _EPS).select("a", "b"))
        free = materialize(roles.filter(F.col("role") == _MEMBER).select("id").join(home, "id", "left_anti"), "free")
        discard(roles, home)
        if free.isEmpty():
            break
        active = contents.join(free, "id", "left_semi")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return materialize(out, "near")


def near_pairs(docs: DataFrame, key: str, content: str, threshold: float = 0.7, links: bool = False) -> DataFrame:
    """(key_a, key_b) with key_a < key_b: all pairs of different keys whose contents' similarity is at least ``threshold``.

    With ``links`` only as many of them as connect the same groups, for groups().

    ``key`` STRING, ``content`` BINARY; rows with a null in either are left out, of several contents of one key
    the smallest counts. Contents shorter than 8 bytes have no runs and no pairs. Other columns are ignored.
    Exact: nothing is sampled or capped; hashes of runs only propose pairs, which are measured on the runs
    themselves. An empty table gives no rows.
    """
    one = docs.select(F.col(key).alias("key"), F.col(content).alias("content")).filter("key is not null and content is not null").groupBy("key").agg(F.min("content").alias("content"))
    laid = materialize(one.select(F.monotonically_increasing_id().alias("id"), "key", "content"), "contents")
    result = _joined(laid.select("id", "content"), threshold, links)
    name = laid.select("id", "key")
    named = result.join(name.select(F.col("id").alias("a"), F.col("key").alias("k")), "a").join(name.select(F.col("id").alias("b"), F.col("key").alias("l")), "b")
    return named.select(F.least("k", "l").alias("key_a"), F.greatest("k", "l").alias("key_b"))


def groups(pairs: DataFrame, left: str = "key_a", right: str = "key_b") -> DataFrame:
    """(key, group_key): the connected groups of ``pairs``, named by their smallest key; keys without a pair are absent.

    Alternating large and small stars: every round all links of a key meet at its smallest neighbour, so a
    group of any size shrinks by a round's factor and a large one is spread over its keys.
    """
    links = materialize(pairs.select(F.col(left).alias("u"), F.col(right).alias("v")), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "links")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(links)
        links = after
        if mark == before:
            break
        before = mark
    roots = links.select("v").distinct().select(F.col("v").alias("key"), F.col("v").alias("group_key"))
    return links.select(F.col("u").alias("key"), F.col("v").alias("group_key")).unionByName(roots)

"""The similarity-delta store: chunks by digest, each whole or as a delta against an earlier similar one.

Resolving a chunk always yields its bytes, so the sizes of deltas depend on contents only and are computed for
all candidate pairs at once. What depends on the order of arrival is a chunk's depth, as it limits which
references may be used. Depths are settled in rounds over fragments of the arrival order: a fragment decides, in
order, all chunks whose candidates are known or decided before in it. A round is a join, and their number is how
often a chain of candidates goes from one fragment to another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import chunking, delta, sketches
from tessera.operators.ordering import numbered
from tessera.session import discard, materialize


#: Fixed value: bytes that name a chunk in a manifest.
POINTER = 32


@dataclass(frozen=True)
class StoreParams:
    """Chunk sizes, banding, candidates per chunk, longest chain and codec."""

    sizes: chunking.ChunkSizes = field(default_factory=chunking.ChunkSizes)
    sketch: sketches.SketchParams = field(default_factory=lambda: sketches.SketchParams(bands=32, rows=2))
    search: sketches.SearchParams = field(default_factory=lambda: sketches.SearchParams(limit=8, least=0.10, candidates=512))
    tried: int = 4
    depth: int = 4
    codec: str = "zlib-9"

    def __post_init__(self):
        if self.tried < 0 or self.depth < 0 or self.codec not in delta.CODECS:
            raise ValueError("tried and depth must not be negative, the codec one of " + ", ".join(delta.CODECS))


_SIZED = "target bigint, reference bigint, place int, raw_bytes int, stored_bytes int, good boolean"


def _sketched(p: StoreParams):
    """Packed sketch and compressed size of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = delta.CODECS[p.codec]()
        for batch in batches:
            each = batch.column("bytes").to_pylist()
            lists = []
            for at in range(0, len(each), 500):
                flat, size = sketches.batch_features(each[at : at + 500], p.sketch)
                lists += [x.tobytes() for x in np.split(flat, np.cumsum(size)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("seq"), pa.array(lists, pa.binary()), pa.array([len(codec.compress(v)) for v in each], pa.int32())], names=["id", "seq", "features", "baseline"])

    return run


def _sized(codec_name: str):
    """Raw and compressed size of each pair's delta, and whether it decodes to the target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = delta.CODECS[codec_name]()
        for batch in batches:
            raw, stored, good = [], [], []
            targets, references = batch.column("target_bytes").to_pylist(), batch.column("reference_bytes").to_pylist()
            for t, r, asked, held in zip(targets, references, delta.batch_hashes(targets), delta.batch_hashes(references)):
                d = delta.encode(r, t, held, asked)
                packed = codec.compress(d)
                raw.append(len(d))
                stored.append(len(packed) + delta.POINTER_BYTES)
                good.append(delta.apply(r, codec.decompress(packed)) == t)
            yield pa.RecordBatch.from_arrays([batch.column("target"), batch.column("reference"), batch.column("place"), pa.array(raw, pa.int32()), pa.array(stored, pa.int32()), pa.array(good, pa.bool_())], names=["target", "reference", "place", "raw_bytes", "stored_bytes", "good"])

    return run


def _packed(codec_name: str, kept: list[str]):
    """Payload of each chunk: compressed as it is or, where it has a reference, as its delta."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = delta.CODECS[codec_name]()
        for batch in batches:
            packed = [codec.compress(b if r is None else delta.encode(r, b)) for b, r in zip(batch.column("bytes").to_pylist(), batch.column("reference_bytes").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(packed, pa.binary())], names=[*kept, "payload"])

    return run


#: Rows of one slice of the tables that carry bytes, and most slices; each is a step of its own, whose shuffle files go before the next.
_SLICE, _SLICES = 100_000, 8


def _by_slices(make, rows: int, name: str) -> DataFrame:
    """``make(keep)`` for slices of the chunks' ids, ``keep`` telling whether a column of ids is in the slice."""
    n = max(1, min(_SLICES, -(-rows // _SLICE)))
    parts = [materialize(make(lambda c, i=i: F.pmod(F.xxhash64(c), F.lit(n)) == i), name) for i in range(n)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out.parts = parts
    return out


#: Candidate pairs of one fragment of the arrival order.
_FACTS = 200_000


def _decided(depth: int, tried: int):
    """Of one fragment, in order of arrival, the depth and reference of every target all of whose candidates are known or decided before it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("seq", "ascending"), ("place", "ascending")])
        done: dict[int, int] = {}
        out: list[tuple] = []
        rows: dict[int, list[tuple]] = {}
        for target, *fact in zip(*(table.column(c).to_pylist() for c in ("target", "reference", "place", "raw_bytes", "wins", "reference_depth"))):
            rows.setdefault(target, []).append(fact)
        for target, facts in rows.items():
            at = [(known if known is not None else done.get(reference), raw, reference, wins) for reference, _, raw, wins, known in facts]
            if any(d is None for d, *_ in at):
                continue
            usable = [x for x in at if x[0] < depth][:tried]
            best = min(usable, key=lambda x: (x[1], x[2]), default=None)
            won = best is not None and best[3]
            done[target] = best[0] + 1 if won else 0
            out.append((target, done[target], best[2] if won else None))
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["id", "depth", "reference"])

    return run


def ingest(blobs: DataFrame, p: StoreParams = StoreParams()) -> tuple[DataFrame, DataFrame]:
    """(records, manifest) of all ``blobs`` (blob_id, seq BIGINT order of arrival, content BINARY).

    records: digest, seq, length, kind, payload, reference_digest, stored_bytes, chain_depth,
    standalone_baseline_bytes, candidates (similar chunks found and sized), fallbacks (of them, those whose delta did not decode to the
    chunk); both null where no search is made. manifest: blob_id, ord, digest, length. A chunk's references come earlier.
    """
    chunks = chunking.content_chunks(blobs.select("blob_id", "seq", "content"), "content", p.sizes)
    manifest = chunks.select("blob_id", "ord", "digest", "length")  # cut anew where it is read
    place = F.col("seq") * F.lit(1 << 24) + F.col("ord")
    unique = chunks.groupBy("digest").agg(F.min(place).alias("seq"), F.min("length").alias("length"), F.min("bytes").alias("bytes"))
    one = materialize(unique.repartitionByRange("digest").sortWithinPartitions("digest").withColumn("id", F.monotonically_increasing_id()), "unique")  # ids in the order of digests
    whole = one.count()
    searched = bool(p.tried and p.depth)
    settled = sized = base = None
    if searched:
        s = materialize(one.select("id", "seq", "bytes").mapInArrow(_sketched(p), "id bigint, seq bigint, features binary, baseline int"), "sketches")
        matches = sketches.earlier_matches(s.select("id", "seq", "features"), p.sketch, p.search)
        pairs = matches.select(F.col("probe").alias("target"), F.col("match").alias("reference"), "place")
        base = materialize(s.select("id", "seq", "baseline"), "alone")
        discard(s)
        targets, references = (one.select(F.col("id").alias(c), F.col("bytes").alias(f"{c}_bytes")) for c in ("target", "reference"))
        sized = _by_slices(lambda keep: pairs.filter(keep("target")).join(targets.filter(keep("target")), "target").join(references, "reference").select("target", "reference", "place", "target_bytes", "reference_bytes").mapInArrow(_sized(p.codec), _SIZED), matches.count(), "deltas")
        settled = _settled(sized, base, p)
    kept = ["digest", "seq", "length", "id", "reference", "depth"]

    def packed(keep) -> DataFrame:
        own = one.filter(keep("id"))
        nothing = own.select("digest", "seq", "length", "id", F.lit(None).cast("bigint").alias("reference"), F.lit(0).alias("depth"), "bytes", F.lit(None).cast("binary").alias("reference_bytes"), F.lit(None).cast("string").alias("reference_digest"))
        if searched:
            picked = settled.filter(F.col("reference").isNotNull() & keep("id"))
            upper = one.select(F.col("id").alias("reference"), F.col("bytes").alias("reference_bytes"), F.col("digest").alias("reference_digest"))
            nothing = nothing.join(picked.select("id"), "id", "left_anti").select(nothing.columns).unionByName(own.join(picked, "id").join(upper, "reference").select(nothing.columns))
        out = nothing.mapInArrow(_packed(p.codec, [*kept, "reference_digest"]), "digest string, seq bigint, length int, id bigint, reference bigint, depth int, reference_digest string, payload binary")
        has = F.col("reference").isNotNull()
        size = F.octet_length("payload")
        if searched:
            examined = sized.filter(keep("target")).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("found"), F.count_if(~F.col("good")).alias("failed"))
            out = out.join(base.filter(keep("id")).select("id", "baseline"), "id").join(examined, "id", "left").withColumns({"candidates": F.coalesce("found", F.lit(0)).cast("long"), "fallbacks": F.coalesce("failed", F.lit(0)).cast("long")})
        else:
            out = out.withColumns({"baseline": size, "candidates": F.lit(None).cast("long"), "fallbacks": F.lit(None).cast("long")})
        return out.select("digest", "seq", "length", F.when(has, "delta").otherwise("standalone").alias("kind"), "payload", "reference_digest", F.when(has, size + delta.POINTER_BYTES).otherwise(size).alias("stored_bytes"), F.col("depth").alias("chain_depth"), F.col("baseline").alias("standalone_baseline_bytes"), "candidates", "fallbacks")

    records = _by_slices(packed, whole, "records")
    discard(one, *([matches, base, settled, *sized.parts] if searched else []))
    return records, manifest


def _settled(sized: DataFrame, base: DataFrame, p: StoreParams) -> DataFrame:
    """(id, depth, reference) of every chunk, decided in order of arrival."""
    facts = sized.join(base.select(F.col("id").alias("target"), "baseline", "seq"), "target").select("target", "seq", "reference", "place", "raw_bytes", (F.col("good") & (F.col("stored_bytes") < F.col("baseline"))).alias("wins"))
    whole = sized.count()
    waiting = materialize(facts.repartitionByRange(-(-whole // _FACTS) or 1, "seq").withColumn("frag", F.spark_partition_id()), "waiting")
    settled = base.select("id").join(waiting.select(F.col("target").alias("id")), "id", "left_anti").select("id", F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("reference"))
    settled = materialize(settled, "settled")
    while not waiting.isEmpty():
        known = waiting.join(settled.select(F.col("id").alias("reference"), F.col("depth").alias("reference_depth")), "reference", "left")
        new = known.select("frag", "target", "seq", "reference", "place", "raw_bytes", "wins", "reference_depth").groupBy("frag").applyInArrow(_decided(p.depth, p.tried), "id bigint, depth int, reference bigint")
        both = materialize(settled.unionByName(new), "settled")
        rest = materialize(waiting.join(both.select(F.col("id").alias("target")), "target", "left_anti"), "waiting")
        discard(settled, waiting)
        settled, waiting = both, rest
    discard(waiting)
    return settled


def _decoded(codec_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = delta.CODECS[codec_name]()
        for batch in batches:
            out = []
            for packed, above in zip(batch.column("payload").to_pylist(), batch.column("above").to_pylist()):
                plain = codec.decompress(packed)
                out.append(delta.apply(above, plain) if above is not None else plain)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(out, pa.binary())], names=["digest", "bytes"])

    return run


def resolved(records: DataFrame, p: StoreParams = StoreParams()) -> DataFrame:
    """(digest, bytes) of all records: level by level, a delta after its reference; ``depth`` joins at most."""
    out = records.filter("reference_digest is null").select("digest", "payload", F.lit(None).cast("binary").alias("above")).mapInArrow(_decoded(p.codec), "digest string, bytes binary")
    out = materialize(out, "resolved")
    level = out
    for depth in range(1, p.depth + 1):
        next_level = records.filter(F.col("chain_depth") == depth).join(level.select(F.col("digest").alias("reference_digest"), F.col("bytes").alias("above")), "reference_digest").select("digest", "payload", "above")
        level = materialize(next_level.mapInArrow(_decoded(p.codec), "digest string, bytes binary"), "resolved")
        out = out.unionByName(level)
    return out


def stats(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row of counters over a store; its ratio is 1 where nothing is stored."""
    zero = F.lit(0).cast("long")
    r = records.agg(F.count("*").alias("chunks"), F.count_if(F.col("kind") == "delta").alias("deltas"), F.count_if(F.col("kind") == "standalone").alias("standalone"), F.coalesce(F.sum(F.col("stored_bytes").cast("long")), zero).alias("stored_bytes"), F.coalesce(F.sum(F.col("standalone_baseline_bytes").cast("long")), zero).alias("dedup_only_bytes"), F.coalesce(F.max("chain_depth"), F.lit(0)).alias("max_depth"), F.count("candidates").alias("similarity_queries"), F.coalesce(F.sum("candidates"), zero).alias("candidates_examined"), F.coalesce(F.sum("fallbacks"), zero).alias("verification_fallbacks"))
    m = manifest.agg(F.count("*").alias("chunk_refs"), F.coalesce(F.sum(F.col("length").cast("long")), zero).alias("input_bytes"))
    out = m.join(F.broadcast(r)).withColumn("manifest_bytes", F.col("chunk_refs") * POINTER)
    return out.withColumns({
        "exact_hits": F.col("chunk_refs") - F.col("chunks"),
        "delta_bytes_saved": F.col("dedup_only_bytes") - F.col("stored_bytes"),
        "stored_bytes_with_manifest": F.col("stored_bytes") + F.col("manifest_bytes"),
        "ratio": F.when(F.col("stored_bytes") == 0, 1.0).otherwise(F.round(F.col("input_bytes") / F.when(F.col("stored_bytes") > 0, F.col("stored_bytes")), 6)),
        "mean_candidates_per_query": F.when(F.col("similarity_queries") == 0, 0.0).otherwise(F.round(F.col("candidates_examined") / F.when(F.col("similarity_queries") > 0, F.col("similarity_queries")), 6)),
        "index_size": F.col("chunks"),
    })


def chain_faults(records: DataFrame, depth: int) -> DataFrame:
    """(digest, fault): the records whose chain of references does not end at a whole chunk within ``depth`` steps.

    ``records``: digest, kind, reference_digest, one row per digest. fault: ``missing_reference`` (a record named on the way is not
    there, or a delta names none), ``cycle`` (a record is met again), ``too_deep``. ``depth`` joins at most; a chain is followed by its
    ids only. A record that is whole ends its chain, whatever it names.
    """
    links = records.select(F.col("digest").alias("at"), F.when(F.col("kind") == "delta", F.coalesce("reference_digest", F.lit(""))).alias("next"), F.lit(True).alias("there"))
    way = records.select("digest", F.col("digest").alias("at"), F.array("digest").alias("seen"))
    faults = []
    for step in range(depth + 1):
        told = way.join(links, "at", "left")
        faults.append(told.filter("there is null").select("digest", F.lit("missing_reference").alias("fault")))
        further = told.filter("next is not null")
        again = F.array_contains("seen", F.col("next"))
        faults.append(further.filter(again).select("digest", F.lit("cycle").alias("fault")))
        further = further.filter(~again)
        if step == depth:
            faults.append(further.select("digest", F.lit("too_deep").alias("fault")))
        else:
            way = materialize(further.select("digest", F.col("next").alias("at"), F.concat("seen", F.array("next")).alias("seen")), "chains")
    out = faults[0]
    for f in faults[1:]:
        out = out.unionByName(f)
    return out


def listed(records: DataFrame) -> DataFrame:
    """(pos, digest): the stored digests in order of their arrival."""
    return numbered(records.select("seq", "digest"), [F.col("seq"), F.col("digest")]).select("pos", "digest")


def depth_histogram(records: DataFrame, depth: int) -> DataFrame:
    """(chain_depth, chunks) for every depth from 0 to ``depth``."""
    every = records.sparkSession.range(depth + 1).select(F.col("id").cast("int").alias("chain_depth"))
    return every.join(records.groupBy("chain_depth").agg(F.count("*").alias("n")), "chain_depth", "left").select("chain_depth", F.coalesce("n", F.lit(0)).alias("chunks"))


def receipts(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """Per blob: chunk references and bytes, and how many references are to deltas."""
    kinds = records.select("digest", "kind", "stored_bytes")
    return manifest.join(kinds, "digest").groupBy("blob_id").agg(F.count("*").alias("chunk_refs"), F.sum(F.col("length").cast("long")).alias("total_bytes"), F.count_if(F.col("kind") == "delta").alias("delta_refs"))

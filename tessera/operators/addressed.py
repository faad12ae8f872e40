"""A content-addressed store of chunks: put, has, get, and what deduplication saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unseen(chunks: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The chunks (digest, bytes, length) to add to a store: each digest once, without those stored."""
    new = chunks.filter("digest is not null").groupBy("digest").agg(F.min("bytes").alias("bytes"), F.min("length").alias("length"))
    return new if stored is None else new.join(stored.select("digest"), "digest", "left_anti")


def has(digests: DataFrame, stored: DataFrame) -> DataFrame:
    """The distinct digests that a store holds."""
    return digests.select("digest").distinct().join(stored.select("digest"), "digest", "left_semi")


def reassembled(manifest: DataFrame, stored: DataFrame, by: str) -> DataFrame:
    """(by, content, total_bytes, missing) from a manifest of (by, ord, digest).

    ``content`` is null where a chunk is missing. A value's chunks meet in one row, as the value itself must.
    """
    found = manifest.select(by, "ord", "digest").join(stored.select("digest", "bytes"), "digest", "left")
    parts = found.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("ord", "bytes"))).alias("p"), F.count_if(F.col("bytes").isNull()).alias("missing"))
    whole = F.reduce(F.col("p"), F.lit(b""), lambda acc, x: F.concat(acc, x["bytes"]))
    return parts.select(by, F.when(F.col("missing") == 0, whole).alias("content"), F.when(F.col("missing") == 0, F.octet_length(whole)).cast("long").alias("total_bytes"), "missing")


def dedup_stats(chunks: DataFrame, *by: str | Column) -> DataFrame:
    """total_bytes, stored_bytes, total_chunks, unique_chunks and dedup_ratio (1 where nothing is stored), per ``by``.

    Chunks are reduced per digest before the totals, so a chunk that occurs in a third of all rows is one row
    a task. Columns: digest, length.
    """
    names = [c if isinstance(c, str) else c for c in by]
    per = chunks.groupBy(*names, "digest").agg(F.sum(F.col("length").cast("long")).alias("_sum"), F.first("length").cast("long").alias("_one"), F.count("*").alias("_n"))
    totals = per.groupBy(*[c for c in per.columns if c not in ("digest", "_sum", "_one", "_n")]).agg(F.coalesce(F.sum("_sum"), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum("_one"), F.lit(0)).alias("stored_bytes"), F.coalesce(F.sum("_n"), F.lit(0)).alias("total_chunks"), F.count("*").alias("unique_chunks"))
    return totals.withColumn("dedup_ratio", F.when(F.col("stored_bytes") == 0, 1.0).otherwise(F.round(F.col("total_bytes") / F.when(F.col("stored_bytes") > 0, F.col("stored_bytes")), 6)))


def exact_hits(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Chunks whose digest came earlier in ``order`` (columns that order all chunks)."""
    first = chunks.groupBy("digest").agg(F.min(F.struct(*order)).alias("_first"))
    return chunks.join(first, "digest").filter(F.struct(*order) > F.col("_first")).drop("_first")


def overlap(candidate: DataFrame, base: DataFrame) -> DataFrame:
    """How much of ``candidate``'s chunks ``base`` has: shared and all blocks and bytes, and the share of bytes."""
    known = base.select("digest").distinct().withColumn("_known", F.lit(True))
    totals = candidate.join(known, "digest", "left").agg(
        F.count_if("_known").alias("shared_blocks"), F.count("*").alias("blocks"),
        F.coalesce(F.sum(F.when(F.col("_known"), F.col("length").cast("long"))), F.lit(0)).alias("shared_bytes"), F.coalesce(F.sum(F.col("length").cast("long")), F.lit(0)).alias("bytes"),
    )
    return totals.withColumn("shared_share", F.when(F.col("bytes") == 0, 0.0).otherwise(F.round(F.col("shared_bytes") / F.when(F.col("bytes") > 0, F.col("bytes")), 6)))


def cumulative_checkpoints(sizes: DataFrame, seq: str, size: str) -> DataFrame:
    """(n, total) at the row counts 1, 2, 4, 8, ...: the running total of ``size`` in order of ``seq``.

    Every row adds its size to the checkpoints at or after its place; a place comes from the counts of the range
    partitions before its own, so no single task orders all rows.
    """
    laid = sizes.select(F.col(seq).alias("_seq"), F.col(size).cast("long").alias("_size")).repartitionByRange("_seq").sortWithinPartitions("_seq").withColumn("_part", F.spark_partition_id())
    counts = laid.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("_size").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum0"))
    own = Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = laid.select("_part", F.row_number().over(own).alias("_i"), F.sum("_size").over(own).alias("_run")).join(F.broadcast(offsets), "_part")
    n = F.col("_n0") + F.col("_i")
    return placed.select(n.alias("n"), (F.col("_sum0") + F.coalesce("_run", F.lit(0))).alias("total")).filter(F.bit_count("n") == 1)

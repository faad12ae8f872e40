"""References to records that do not exist, are deleted, or come later.

The distinct non-null foreign keys are anti-joined with the parent keys, so the shuffle holds each key once
however often it is used; what they lack is joined back to the references. A key that a third of all references
name is one row on the key side, and its references are split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reference_states(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Bad references with their state.

    ``refs``: src_table, parent_table, from_key, to_key, from_batch; rows with a null key are no references.
    ``parents``: parent_table, key, batch (smallest batch of the key's rows), deleted; one row per key.
    Returns the distinct (src_table, from_key, to_key, ref_state, from_batch) with ref_state ``missing`` (no
    such parent), else ``deleted``, else ``late`` (the parent's first batch after from_batch, both not null).
    """
    refs = refs.filter("from_key is not null and to_key is not null")
    wanted = refs.select("parent_table", F.col("to_key").alias("key")).distinct()
    missing = wanted.join(parents, ["parent_table", "key"], "left_anti").select("parent_table", "key", F.lit("missing").alias("state"), F.lit(None).cast("long").alias("batch"))
    present = wanted.join(parents, ["parent_table", "key"]).select("parent_table", "key", F.when(F.col("deleted"), "deleted").alias("state"), "batch")
    states = missing.unionByName(present).withColumnRenamed("key", "to_key")
    state = F.coalesce("state", F.when(F.col("batch") > F.col("from_batch"), "late"))
    return refs.join(states, ["parent_table", "to_key"]).withColumn("ref_state", state).filter("ref_state is not null").select("src_table", "from_key", "to_key", "ref_state", "from_batch")


def count_by_period(bad: DataFrame, batches_per_period: int) -> DataFrame:
    """Bad references per table, period (from_batch divided by ``batches_per_period``; null stays null) and state."""
    return bad.groupBy("src_table", F.floor(F.col("from_batch") / batches_per_period).alias("period"), "ref_state").agg(F.count("*").alias("n"))


def project_references(changes: DataFrame, stories: DataFrame, evidence: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """refs and parents of reference_states() from this project's four tables."""

    def exploded(df, table, parent, key, array, batch):
        one = df.select(F.lit(table).alias("src_table"), F.lit(parent).alias("parent_table"), key.alias("from_key"), F.explode(F.array_distinct(array)).alias("to_key"), batch.alias("b"))
        return one.filter("to_key is not null").groupBy("src_table", "parent_table", "from_key", "to_key").agg(F.min("b").alias("b"))

    def first(df, table, key, deleted):
        return df.select(F.lit(table).alias("parent_table"), key.alias("key"), F.col("batch_no").cast("long").alias("b"), deleted.alias("d")).filter("key is not null").groupBy("parent_table", "key").agg(F.min("b").alias("batch"), F.max("d").alias("deleted"))

    none = F.lit(False)
    digest = F.lower("digest")
    by_change, by_story = first(changes, "changes", F.col("change_id"), none), first(stories, "story_manifests", F.col("story_id"), none)
    by_chunk = first(chunks, "chunk_records", digest, F.col("evicted_at").isNotNull())
    parents = by_change.unionByName(first(evidence, "evidence_receipts", F.col("receipt_id"), F.col("withdrawn_at").isNotNull())).unionByName(by_chunk)
    batch = F.col("batch_no").cast("long")
    refs = exploded(changes, "changes", "changes", F.col("change_id"), F.col("change_header.parents"), batch)
    refs = refs.unionByName(exploded(stories, "story_manifests", "evidence_receipts", F.col("story_id"), F.col("evidence_receipt_ids"), batch))
    refs = refs.unionByName(exploded(chunks, "chunk_records", "chunk_records", digest, F.array(F.lower("reference_digest")), batch))
    begun = by_change.unionByName(by_story).unionByName(by_chunk).select(F.col("parent_table").alias("src_table"), F.col("key").alias("from_key"), F.col("batch").alias("from_batch"))
    return refs.drop("b").join(begun, ["src_table", "from_key"]), parents

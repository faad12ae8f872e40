"""Applying a feed of inserts, updates and deletes to a table of current state.

Every change addresses a *cell*: a register (set, or deleted, by the latest change) or a grow/remove element
(gone for good once any change removes it). Cells are hashed to buckets; each bucket is one task with an
embedded DuckDB database whose ``INSERT ... ON CONFLICT DO UPDATE ... WHERE`` compares the stored version with
the new one, so repeated and late changes lose whatever their order. Deleted cells stay as tombstones, else a
late set would revive them. Bucket results are written as one version of the state table, which one rename
makes current.

Skew: repeats are reduced per Arrow batch before the shuffle, so a cell holding a third of all changes
arrives as one row a batch; the cells of a hot object spread over all buckets, as the bucket hashes the cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import publish, published, scratch_path, tasks_for

STATE = "cell string, kind string, object_id string, seq long, happened string, op_id string, dead boolean"
_COLUMNS = "cell, kind, object_id, seq, happened, op_id, dead"
#: Latest first: removal wins for elements, else the larger (seq, happened, op_id); nulls are lowest.
_ORDER = "(kind = 'element' and dead) desc, seq desc nulls last, happened desc nulls last, op_id desc nulls last, dead desc, object_id desc nulls last"
_NEWER = "(kind='element' and {0}.dead)::int, coalesce({0}.seq, -9223372036854775808), coalesce({0}.happened, ''), coalesce({0}.op_id, ''), {0}.dead::int, coalesce({0}.object_id, '')"


def _key(*parts: Column) -> Column:
    """One string per tuple: each part with its length, so that no two tuples meet and null differs from ''."""
    return F.concat(*[F.when(p.isNull(), F.lit("-:")).otherwise(F.concat(F.length(p).cast("string"), F.lit(":"), p)) for p in parts])


def social_changes(ops: DataFrame) -> DataFrame:
    """Turns operation deliveries into cell changes (columns of STATE).

    Rows of unknown or null op_type change nothing. A null field_name or block_id is a cell of its own.
    Columns beyond those named are ignored, whatever their names.
    """
    p = F.col("payload")
    base = ops.select("op_type", "object_id", F.col("op_sequence").cast("long").alias("seq"), F.col("created_at").alias("happened"), "op_id", p["field_name"].alias("field_name"), p["block_id"].alias("block_id"), p["observed_add_ids"].alias("adds"))
    kind = F.col("op_type")
    removed = kind == "edge.remove"
    slots = F.when(removed, F.array_distinct(F.coalesce("adds", F.array().cast("array<string>")))).when(kind == "edge.add", F.array("op_id")).otherwise(F.array(F.lit(None).cast("string")))
    o = F.col("object_id")
    return base.filter(kind.isin("profile.field.set", "post.block.set", "post.block.delete", "edge.add", "edge.remove", "object.tombstone")).withColumn("slot", F.explode(slots)).filter(~removed | F.col("slot").isNotNull()).select(
        F.when(kind == "profile.field.set", F.concat(F.lit("f"), _key(o, F.col("field_name"))))
        .when(kind.isin("post.block.set", "post.block.delete"), F.concat(F.lit("b"), _key(o, F.col("block_id"))))
        .when(kind.isin("edge.add", "edge.remove"), F.concat(F.lit("e"), _key(F.col("slot"))))
        .otherwise(F.concat(F.lit("t"), _key(o)))
        .alias("cell"),
        F.when(kind.isin("edge.add", "edge.remove"), F.lit("element")).when(kind == "object.tombstone", F.lit("object")).otherwise(F.lit("register")).alias("kind"),
        F.when(~removed, o).alias("object_id"),
        "seq", "happened", "op_id",
        kind.isin("post.block.delete", "edge.remove", "object.tombstone").alias("dead"),
    )


def _database():
    import duckdb

    db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
    db.execute("set preserve_insertion_order = false")
    return db


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: of each batch one row per cell."""
    db = _database()
    for batch in batches:
        changes = pa.Table.from_batches([batch])  # noqa: F841
        yield from db.sql(f"select {_COLUMNS} from changes qualify row_number() over (partition by cell order by {_ORDER}) = 1").to_arrow_table().cast(batch.schema).to_batches()


def _upsert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: conditional upsert of every batch, then export."""
    db, schema = _database(), None
    db.execute("create table state (cell varchar primary key, kind varchar, object_id varchar, seq bigint, happened varchar, op_id varchar, dead boolean)")
    new, old = _NEWER.format("excluded").replace("(kind", "(excluded.kind"), _NEWER.format("state").replace("(kind", "(state.kind")
    for batch in batches:
        schema = batch.schema
        changes = pa.Table.from_batches([batch])  # noqa: F841
        db.execute(
            f"insert into state select {_COLUMNS} from changes qualify row_number() over (partition by cell order by {_ORDER}) = 1 "
            "on conflict (cell) do update set object_id = excluded.object_id, seq = excluded.seq, happened = excluded.happened, op_id = excluded.op_id, dead = excluded.dead "
            f"where ({new}) > ({old})"
        )
    if schema is not None:
        yield from db.sql(f"select {_COLUMNS} from state").to_arrow_table().cast(schema).to_batches(max_chunksize=50_000)


def apply_changes(changes: DataFrame, state_dir: str, rows_per_bucket: int = 500_000) -> DataFrame:
    """Applies ``changes`` (columns of STATE) to the state table in ``state_dir`` and publishes the new version.

    The present state enters as further changes, so applying the same feed twice, in parts or in another order
    gives the same table. Memory: a bucket's state is bounded by ``rows_per_bucket`` through the number of
    buckets. An empty feed publishes the present state again.
    """
    spark = changes.sparkSession
    changes = changes.select(*[c.strip().split(" ")[0] for c in STATE.split(",")])
    before = published(spark, state_dir)
    rows = changes.count() + (before.count() if before is not None else 0)
    reduced = changes.mapInArrow(_reduce, STATE)
    if before is not None:
        reduced = reduced.unionByName(before)
    buckets = reduced.repartition(tasks_for(spark, rows, rows_per_bucket), "cell")
    return publish(buckets.mapInArrow(_upsert, STATE), state_dir)


def current(state: DataFrame) -> DataFrame:
    """The live cells of a state table: not deleted, and not of an object with a tombstone.

    The anti-join splits a hot object at run time (adaptive skew join); its right side holds object ids only.
    """
    gone = state.filter("kind = 'object'").select("object_id")
    return state.filter("kind <> 'object' and not dead").join(gone, "object_id", "left_anti")


def current_social_ops(spark: SparkSession, ops: DataFrame, state_dir: str | None = None) -> DataFrame:
    """(object_id, op_id) of the operations that give the current state after all of ``ops``."""
    state = apply_changes(social_changes(ops), state_dir or scratch_path(spark, "state"))
    return current(state).select("object_id", "op_id")

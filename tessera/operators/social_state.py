"""Profiles, posts, edges and tombstones after a set of social operations.

Registers take the operation of the largest clock: sequence, then actor, then id, the last two in locale order
(not byte order). An edge stays while no removal has observed its add. A post lists its blocks by the block
they follow, then by clock. Each part is one aggregation on its own key; the two-sided comparison of blocks
is one aggregation as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import list_digests


def once(ops: DataFrame) -> DataFrame:
    """One row per op_id, that of the smallest delivery_id."""
    return ops.groupBy("op_id").agg(F.min_by(F.struct("actor", "op_sequence", "created_at", "op_type", "object_id", "payload"), "delivery_id").alias("r")).select("op_id", "r.*")


def clock() -> Column:
    return F.struct("op_sequence", F.collate("actor", "UNICODE").alias("actor"), F.collate("op_id", "UNICODE").alias("op_id"))


def profiles(ops: DataFrame) -> DataFrame:
    """(object_id, field_name, new_value) of the latest set; tombstones do not matter here."""
    sets = ops.filter("op_type = 'profile.field.set'")
    return sets.groupBy("object_id", F.col("payload.field_name").alias("field_name")).agg(F.max_by("payload.new_value", clock()).alias("new_value"))


def blocks(ops: DataFrame) -> DataFrame:
    """(object_id, block_id, block_kind, new_value, place): blocks whose latest set is after their latest delete."""
    both = ops.filter("op_type in ('post.block.set', 'post.block.delete')").withColumn("is_set", F.col("op_type") == "post.block.set")
    latest = both.groupBy("object_id", F.col("payload.block_id").alias("block_id")).agg(F.max_by(F.struct("is_set", "op_sequence", "actor", "op_id", "payload.block_kind", "payload.new_value", "payload.after_block"), clock()).alias("r"))
    kept = latest.filter("r.is_set").select("object_id", "block_id", "r.*")
    order = Window.partitionBy("object_id").orderBy(F.collate(F.coalesce("after_block", F.lit("null")), "UNICODE"), "op_sequence", F.collate("actor", "UNICODE"), F.collate("op_id", "UNICODE"))
    return kept.withColumn("place", F.row_number().over(order)).select("object_id", "block_id", "block_kind", "new_value", "place")


def edges(ops: DataFrame) -> DataFrame:
    """(edge_id, edge_kind, subject_id, target_id, add_id) of adds that no removal has observed."""
    removed = ops.filter("op_type = 'edge.remove'").select(F.explode("payload.observed_add_ids").alias("op_id"))
    p = F.col("payload")
    adds = ops.filter("op_type = 'edge.add'").join(removed, "op_id", "left_anti")
    return adds.select(F.concat_ws(":", p["edge_kind"], p["subject_id"], p["target_id"]).alias("edge_id"), p["edge_kind"].alias("edge_kind"), p["subject_id"].alias("subject_id"), p["target_id"].alias("target_id"), F.col("op_id").alias("add_id"))


def tombstones(ops: DataFrame) -> DataFrame:
    """(object_id, op_id, reason_code) of the latest tombstone of each object."""
    return ops.filter("op_type = 'object.tombstone'").groupBy("object_id").agg(F.max_by(F.struct("op_id", "payload.reason_code"), clock()).alias("r")).select("object_id", "r.*")


def operation_body(protocol: str) -> Column:
    """The canonical JSON that an operation's id is the hash of; null for a type that is not one of the six."""
    p, kind = F.col("payload"), F.col("op_type")

    def body(**fields: Column) -> Column:
        return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())]), {"ignoreNullFields": "false"})

    edge = {"edge": p["edge_kind"], "subject": p["subject_id"], "target": p["target_id"]}
    told = F.when(kind == "profile.field.set", body(field=p["field_name"], value=p["new_value"]))
    told = told.when(kind == "post.block.set", body(after=p["after_block"], blockId=p["block_id"], kind=p["block_kind"], value=p["new_value"])).when(kind == "post.block.delete", body(blockId=p["block_id"]))
    told = told.when(kind == "edge.add", body(**edge, value=p["new_value"])).when(kind == "edge.remove", body(**edge, observedAddIds=p["observed_add_ids"])).when(kind == "object.tombstone", body(reason=p["reason_code"]))

    def quoted(c: Column) -> Column:
        return F.regexp_replace(F.to_json(F.array(c), {"ignoreNullFields": "false"}), r"^\[|\]$", "")

    parts = (("actor", quoted(F.col("actor"))), ("createdAt", quoted(F.col("created_at"))), ("objectId", quoted(F.col("object_id"))), ("payload", told), ("protocol", F.to_json(F.struct(F.lit(protocol).alias("x"))).substr(F.lit(6), F.lit(len(protocol) + 2))), ("sequence", F.coalesce(F.col("op_sequence").cast("string"), F.lit("null"))), ("type", quoted(kind)), ("version", F.lit("1")))
    return F.concat(F.lit("{"), *[x for i, (n, c) in enumerate(parts) for x in (F.lit(("," if i else "") + f'"{n}":'), c)], F.lit("}"))


def object_states(ops: DataFrame) -> DataFrame:
    """(object_id, operations, receipt, deleted, fields, blocks) of every object: how many distinct operations, the hash of their ids by clock, and what is current."""
    one = ops.select(F.coalesce("object_id", F.lit("")).alias("object_id"), "op_sequence", F.collate("actor", "UNICODE").alias("actor"), F.collate("op_id", "UNICODE").alias("id"), F.regexp_replace(F.to_json(F.array("op_id")), r"^\[|\]$", "").alias("piece"))
    out = list_digests(one, "object_id", ["op_sequence", "actor", "id"], "piece").select("object_id", F.col("n").alias("operations"), F.col("digest").alias("receipt"))
    gone = tombstones(ops).select("object_id", F.lit(True).alias("deleted"))
    counts = [f(ops).groupBy("object_id").agg(F.count("*").alias(n)) for f, n in ((profiles, "fields"), (blocks, "blocks"))]
    for more in (gone, *counts):
        out = out.join(more, "object_id", "left")
    zero = F.lit(0).cast("long")
    return out.select("object_id", "operations", "receipt", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("fields", zero).alias("fields"), F.coalesce("blocks", zero).alias("blocks"))

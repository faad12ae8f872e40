"""Sets of signed changes: order, heads, inventory, what a replica lacks, and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import hierarchy
from tessera.operators.ordering import numbered

#: Fixed value: how many ids one request may name.
WANT = 128


def distinct_changes(changes: DataFrame, key: str = "change_id") -> DataFrame:
    """One row per id, that of the smallest delivery_id."""
    return changes.groupBy(key).agg(F.min_by(F.struct(*[c for c in changes.columns if c != key]), "delivery_id").alias("r")).select(key, "r.*")


def collisions(changes: DataFrame, key: str, *content: str) -> DataFrame:
    """Ids that came with different content."""
    body = F.xxhash64(*content)
    return changes.groupBy(key).agg(F.min(body).alias("a"), F.max(body).alias("b"), F.count("*").alias("n")).filter("a <> b").select(key, "n")


def edges(changes: DataFrame) -> DataFrame:
    """(change_id, parent), distinct, parents not null."""
    return changes.select("change_id", F.explode("change_header.parents").alias("parent")).filter("parent is not null").distinct()


def dag_levels(changes: DataFrame) -> DataFrame:
    """(change_id, level): the round in which a change's parents are all placed; -1 where no round does (a cycle)."""
    nodes = changes.select(F.col("change_id").alias("node_id"), F.col("change_header.parents").alias("parents"), F.col("change_header.space_id").alias("family"), F.col("delivery_id").alias("nth"))
    return hierarchy.resolve(nodes, ["family", "nth"]).select(F.col("node_id").alias("change_id"), F.col("node_depth").alias("level"))


def dag_order(changes: DataFrame) -> DataFrame:
    """(pos, change_id, level, created_at): all changes in order of level, then time, then id in locale order; a cycle's have level -1 and come first."""
    one = changes.groupBy("change_id").agg(F.min("change_header.created_at").alias("created_at"))
    levels = dag_levels(changes).join(one, "change_id")
    return numbered(levels.select("change_id", "level", "created_at"), [F.col("level"), F.collate("created_at", "UNICODE"), F.collate("change_id", "UNICODE"), F.col("change_id")])


def heads(changes: DataFrame) -> DataFrame:
    """Changes that no change names as a parent."""
    return changes.select("change_id").distinct().join(edges(changes).select(F.col("parent").alias("change_id")), "change_id", "left_anti")


def missing_parents(changes: DataFrame) -> DataFrame:
    """(change_id, parent) where the parent is no change."""
    return edges(changes).join(changes.select(F.col("change_id").alias("parent")), "parent", "left_anti").select("change_id", "parent")


def missing(mine: DataFrame, theirs: DataFrame, key: str = "change_id") -> DataFrame:
    """The distinct ids of ``theirs`` that ``mine`` lacks."""
    return theirs.select(key).distinct().join(mine.select(key), key, "left_anti")


def want(mine: DataFrame, theirs: DataFrame, key: str = "change_id", most: int = WANT) -> DataFrame:
    """The first ``most`` missing ids in byte order, what one request asks for."""
    return missing(mine, theirs, key).orderBy(key).limit(most)


def merged(*replicas: DataFrame, key: str = "change_id") -> DataFrame:
    """The union of replicas, each id once (its smallest delivery_id)."""
    whole = replicas[0]
    for r in replicas[1:]:
        whole = whole.unionByName(r)
    return distinct_changes(whole, key)


def space_receipts(changes: DataFrame) -> DataFrame:
    """(space_id, changes, heads): how many distinct changes and heads each space has."""
    one = changes.select("change_id", F.col("change_header.space_id").alias("space_id")).distinct()
    top = heads(changes).withColumn("head", F.lit(1))
    return one.join(top, "change_id", "left").groupBy("space_id").agg(F.count("*").alias("changes"), F.count("head").alias("heads"))


def sequence_gaps(frames: DataFrame, session: str, sequence: str) -> DataFrame:
    """(session, expected, got) where a session's next sequence is not the last one plus one (the first must be 0)."""
    w = Window.partitionBy(session).orderBy(sequence)
    expected = F.coalesce(F.lag(sequence).over(w) + 1, F.lit(0))
    return frames.select(session, F.col(sequence).alias("got"), expected.alias("expected")).filter("got <> expected")


def replayed(messages: DataFrame, peer: str, nonce: str, at: str, window_s: int = 120) -> DataFrame:
    """Messages whose peer and nonce came within ``window_s`` seconds before: ``messages`` with previous_at."""
    previous = F.lag(at).over(Window.partitionBy(peer, nonce).orderBy(at))
    return messages.withColumn("previous_at", previous).filter(F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("previous_at").cast("timestamp")) <= window_s * 1_000_000)

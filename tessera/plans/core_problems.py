"""Queries of the general problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import arrivals, changefeed, hierarchy, references
from tessera.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.current_social_ops(spark, table(spark, sf_dir, "social_ops"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(name, key):
        return arrivals.repeated_arrivals(table(spark, sf_dir, name), key, "delivery_id", "batch_no").select(F.lit(name).alias("src_table"), F.col("arrival").alias("delivery_id"))

    return one("social_ops", "op_id").unionByName(one("changes", "change_id"))


def hierarchy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes and stories as nodes; a change lies near its space's earlier ones, a story near its root's."""
    changes = table(spark, sf_dir, "changes").select(F.concat(F.lit("c"), "change_id").alias("node_id"), F.transform("change_header.parents", lambda p: F.concat(F.lit("c"), p)).alias("parents"), F.concat(F.lit("c"), "change_header.space_id").alias("family"), F.col("delivery_id").alias("nth"))
    stories = table(spark, sf_dir, "story_manifests").select(F.concat(F.lit("s"), "story_id").alias("node_id"), F.array(F.concat(F.lit("s"), "previous_story_id")).alias("parents"), F.concat(F.lit("s"), F.coalesce("root_story_id", "story_id")).alias("family"), F.col("manifest_no").alias("nth"))
    return changes.unionByName(stories)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hierarchy.resolve(hierarchy_nodes(spark, sf_dir), ["family", "nth"])
    return found.select(F.when(F.col("node_id").startswith("c"), "change").otherwise("story").alias("node_kind"), F.expr("substr(node_id, 2)").alias("node_id"), F.when(F.col("node_depth") < 0, F.col("root_id")).otherwise(F.expr("substr(root_id, 2)")).alias("root_id"), "node_depth")


def _story_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    stories = table(spark, sf_dir, "story_manifests").select(F.col("story_id").alias("node_id"), F.array("previous_story_id").alias("parents"), F.coalesce("root_story_id", "story_id").alias("family"), F.col("manifest_no").alias("nth"))
    return hierarchy.resolve(stories, ["family", "nth"], with_path=True)


def _change_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "changes").select(F.col("change_id").alias("node_id"), F.col("change_header.parents").alias("parents"), F.col("change_header.space_id").alias("family"), F.col("delivery_id").alias("nth"))


def p4_change_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest path of every change that has one."""
    found = hierarchy.resolve(_change_nodes(spark, sf_dir), ["family", "nth"], with_path=True)
    return found.filter("path is not null").select("node_id", "node_depth", F.array_join("path", "/").alias("full_path"))


def p4_change_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every change, by whichever of their parents."""
    return hierarchy.all_descendants(_change_nodes(spark, sf_dir), ["family", "nth"])


def p4_story_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full path of every story that has one."""
    return _story_paths(spark, sf_dir).filter("path is not null").select("node_id", "node_depth", F.array_join("path", "/").alias("full_path"))


def p4_story_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every story."""
    return hierarchy.descendants(_story_paths(spark, sf_dir)).select("node_id", "descendant", F.col("distance").cast("long").alias("distance"))


def _bad_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, parents = references.project_references(*(table(spark, sf_dir, t) for t in ("changes", "story_manifests", "evidence_receipts", "chunk_records")))
    return references.reference_states(refs, parents)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bad_references(spark, sf_dir).select("src_table", "from_key", "to_key", "ref_state")


def p7_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad references per table, period of 30 batches and state."""
    return references.count_by_period(_bad_references(spark, sf_dir), 30)


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p4_found, p4_story_paths, p4_story_descendants, p4_change_paths, p4_change_descendants, p7_found, p7_by_period)}

_ORDERED = "partition by {} order by op_sequence desc nulls last, created_at desc nulls last, op_id desc nulls last"

_P1 = f"""
with o as (select distinct object_id, op_id, op_type, op_sequence, created_at, payload.field_name field_name, payload.block_id block_id from social_ops),
gone as (select object_id from o where op_type = 'object.tombstone'),
removed as (select distinct unnest(payload.observed_add_ids) add_id from social_ops where op_type = 'edge.remove'),
f as (select object_id, op_id from o where op_type = 'profile.field.set' qualify row_number() over ({_ORDERED.format("object_id, field_name")}) = 1),
b as (select object_id, op_id, op_type from o where op_type in ('post.block.set', 'post.block.delete') qualify row_number() over ({_ORDERED.format("object_id, block_id")}) = 1),
e as (select object_id, op_id from o where op_type = 'edge.add' and op_id not in (select add_id from removed where add_id is not null))
select object_id, op_id from (select * from f union all select object_id, op_id from b where op_type = 'post.block.set' union all select * from e)
where object_id not in (select object_id from gone where object_id is not null)
"""

_P3 = """
select 'social_ops' src_table, delivery_id from social_ops qualify row_number() over (partition by op_id order by delivery_id) > 1
union all
select 'changes', delivery_id from changes qualify row_number() over (partition by change_id order by delivery_id) > 1
"""

_GRAPH = """
nodes as (select distinct 'change' k, change_id id from changes union select distinct 'story', story_id from story_manifests),
raw as (select 'change' k, change_id child, unnest(change_header.parents) parent from changes union select 'story', story_id, previous_story_id from story_manifests where previous_story_id is not null),
edges as (select distinct r.k, child, parent from raw r join nodes n on n.k = r.k and n.id = r.parent),
above as (select k, child, parent anc from edges union select a.k, a.child, e.parent from above a join edges e on e.k = a.k and e.child = a.anc),
loops as (select k, child from above where child = anc),
doomed as (select k, child from loops union select a.k, a.child from above a join loops l on l.k = a.k and l.child = a.anc),
ok as (select k, id from nodes where (k, id) not in (select (k, child) from doomed)),
roots as (select k, id from ok where (k, id) not in (select (k, child) from edges)),
walk as (select k, id, id root, 0::bigint depth from roots union select e.k, e.child, w.root, w.depth + 1 from walk w join edges e on e.k = w.k and e.parent = w.id join ok o on o.k = e.k and o.id = e.child)
"""

_P4 = f"""
with recursive {_GRAPH}
select k node_kind, id node_id, min(root) root_id, max(depth) node_depth from walk group by k, id
union all select k, child, 'cycle', -1 from doomed
"""

_P4_PATHS = f"""
with recursive {_GRAPH},
trail as (select id, 0::bigint depth, id path from roots where k = 'story' union all select e.child, t.depth + 1, t.path || '/' || e.child from trail t join edges e on e.k = 'story' and e.parent = t.id)
select id node_id, depth node_depth, path full_path from trail
"""

_P4_DESCENDANTS = f"""
with recursive {_GRAPH},
pairs as (select child node_id, parent anc, 1::bigint distance from edges where k = 'story' and ('story', child) not in (select (k, child) from doomed)
          union all select p.node_id, e.parent, p.distance + 1 from pairs p join edges e on e.k = 'story' and e.child = p.anc)
select anc node_id, node_id descendant, distance from pairs
"""

_P4_CHANGE_DESCENDANTS = f"""
with recursive {_GRAPH}
select anc node_id, child descendant from above where k = 'change' and (k, child) not in (select (k, child) from doomed)
"""

_BAD = """
refs as (
  select distinct 'changes' src_table, 'c' pt, change_id from_key, unnest(change_header.parents) to_key from changes
  union select distinct 'story_manifests', 'e', story_id, unnest(evidence_receipt_ids) from story_manifests
  union select distinct 'chunk_records', 'k', lower(digest), lower(reference_digest) from chunk_records where reference_digest is not null),
parents as (
  select 'c' pt, change_id key, min(batch_no) b, false d from changes group by 2
  union all select 'e', receipt_id, min(batch_no), bool_or(withdrawn_at is not null) from evidence_receipts group by 2
  union all select 'k', lower(digest), min(batch_no), bool_or(evicted_at is not null) from chunk_records group by 2),
begun as (
  select 'changes' src_table, change_id from_key, min(batch_no) fb from changes group by 2
  union all select 'story_manifests', story_id, min(batch_no) from story_manifests group by 2
  union all select 'chunk_records', lower(digest), min(batch_no) from chunk_records group by 2),
bad as (
  select r.src_table, r.from_key, r.to_key, fb, case when p.key is null then 'missing' when d then 'deleted' when p.b > fb then 'late' end ref_state
  from refs r join begun using (src_table, from_key) left join parents p on p.pt = r.pt and p.key = r.to_key where r.to_key is not null)
"""

SQL = {
    "p1_found": _P1,
    "p3_found": _P3,
    "p4_found": _P4,
    "p4_story_paths": _P4_PATHS,
    "p4_story_descendants": _P4_DESCENDANTS,
    "p4_change_descendants": _P4_CHANGE_DESCENDANTS,
    "p7_found": f"with {_BAD} select src_table, from_key, to_key, ref_state from bad where ref_state is not null",
    "p7_by_period": f"with {_BAD} select src_table, cast(floor(fb / 30) as bigint) period, ref_state, count(*) n from bad where ref_state is not null group by all",
}

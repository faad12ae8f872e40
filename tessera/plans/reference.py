"""Queries of the chunk, sketch, feed, change-set, social and provenance operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import addressed, changesets, chunking, provenance, ranking, sketches, social_state, store, transcode, validation
from tessera.plans.core_problems import _GRAPH, table
from tessera.session import materialize
from tessera.sources import tables

_SIZES = chunking.ChunkSizes(64, 256, 1024)
_RANK = ranking.RankParams(as_of="2019-04-15T00:00:00.000Z", affinity={"weather": 400, "local-news": 300, "archives": 200}, followed=tuple(f"author:morholt-{i}" for i in range(1, 40)), consecutive=2, limit=100)
_QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _texts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null and text <> ''").select("doc_id", *more, F.encode("text", "UTF-8").alias("content"))


def _whole(spark, sf_dir, *more):
    """Whole texts as chunks."""
    return _texts(spark, sf_dir, *more).select("doc_id", *more, F.lit(0).alias("ord"), F.octet_length("content").alias("length"), F.sha2("content", 256).alias("digest"))


_DOC = "d as (select *, sha256(text) digest, octet_length(encode(text))::bigint length from documents where text is not null and text <> '')"
_STATS = """select {key} sum(s)::bigint total_bytes, sum(o)::bigint stored_bytes, sum(n)::bigint total_chunks, count(*) unique_chunks, round(sum(s) / sum(o)::double, 6) dedup_ratio
from (select {key} digest, sum(length) s, any_value(length) o, count(*) n from {src} group by {key} digest) {group}"""


@_query(f"with {_DOC} {_STATS.format(key='', src='d', group='')}")
def doc_exact_dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addressed.dedup_stats(_whole(spark, sf_dir))


@_query(f"with {_DOC} {_STATS.format(key='lang,', src='d', group='group by lang')}")
def doc_dedup_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addressed.dedup_stats(_whole(spark, sf_dir, "lang"), "lang")


@_query(f"with {_DOC} {_STATS.format(key='source,', src='d', group='group by source')}")
def doc_dedup_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addressed.dedup_stats(_whole(spark, sf_dir, "source"), "source")


@_query(f"with {_DOC} select doc_id, digest from d qualify row_number() over (partition by digest order by doc_id) > 1")
def doc_exact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addressed.exact_hits(_whole(spark, sf_dir), ["doc_id"]).select("doc_id", "digest")


_FIXED = "h as (select doc_id, hex(encode(text)) x from documents where text is not null and text <> ''), f as (select doc_id, i ord, substr(x, i * 1024 + 1, 1024) piece from (select doc_id, x, unnest(range(0, (length(x) + 1023) // 1024)) i from h)), c as (select doc_id, ord, piece digest, length(piece) // 2 length from f)"


@_query(f"with {_FIXED} {_STATS.format(key='', src='c', group='')}")
def fixed_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addressed.dedup_stats(chunking.fixed_chunks(_texts(spark, sf_dir), "content", 512))


@_query(f"""with {_FIXED}, b as (select distinct digest from c where doc_id % 2 = 0), o as (select c.*, b.digest is not null known from c left join b using (digest) where doc_id % 2 = 1)
select count(*) filter (known) shared_blocks, count(*) blocks, coalesce(sum(length) filter (known), 0)::bigint shared_bytes, sum(length)::bigint bytes, round(coalesce(sum(length) filter (known), 0) / sum(length)::double, 6) shared_share from o""")
def fixed_block_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.fixed_chunks(_texts(spark, sf_dir), "content", 512)
    return addressed.overlap(c.filter("doc_id % 2 = 1"), c.filter("doc_id % 2 = 0"))


def _cut(spark, sf_dir, *more):
    return chunking.content_chunks(_texts(spark, sf_dir, *more), "content", _SIZES)


@_query()
def cdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir).select("doc_id", "ord", "offset", "length", "digest")


@_query()
def cdc_dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addressed.dedup_stats(_cut(spark, sf_dir, "lang"), "lang")


@_query()
def cdc_insert_resilience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every text shifted by seven bytes its chunks still find, content-defined and fixed."""
    texts = _texts(spark, sf_dir)
    moved = texts.withColumn("content", F.concat(F.lit(b"shifted"), "content"))
    by_content = addressed.overlap(chunking.content_chunks(moved, "content", _SIZES), chunking.content_chunks(texts, "content", _SIZES))
    return by_content.withColumn("method", F.lit("content")).unionByName(addressed.overlap(chunking.fixed_chunks(moved, "content", 256), chunking.fixed_chunks(texts, "content", 256)).withColumn("method", F.lit("fixed")))


@_query("select doc_id, sha256(text) digest, octet_length(encode(text))::bigint total_bytes from documents where text is not null and text <> ''")
def cdc_reassembly_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text put together again from the distinct stored chunks."""
    c = _cut(spark, sf_dir)
    return addressed.reassembled(c.select("doc_id", "ord", "digest"), addressed.unseen(c), "doc_id").select("doc_id", F.sha2("content", 256).alias("digest"), "total_bytes")


@_query("select n, total from (select row_number() over (order by doc_id) n, sum(coalesce(n_chars, 0)) over (order by doc_id)::bigint total from documents) where bit_count(n) = 1")
def cumulative_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addressed.cumulative_checkpoints(table(spark, sf_dir, "documents"), "doc_id", "n_chars")


def _sketches(spark, sf_dir):
    return sketches.sketched(_texts(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), "content"), "content")


@_query()
def sketch_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sketches(spark, sf_dir).select("id", F.size("features").alias("n"), F.array_join(F.col("features").cast("array<string>"), ",").alias("features"))


@_query()
def lsh_band_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.band_keys(_sketches(spark, sf_dir))


@_query()
def lsh_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document with an id divisible by 20, all its matches among the others."""
    s = materialize(_sketches(spark, sf_dir), "sketches")
    return sketches.all_matches(s.filter("id % 20 = 0"), s)


@_query("select string_class, count(*) n from (select case when regexp_matches(s, '^(0|[1-9][0-9]{0,15})$') and try_cast(s as bigint) <= 9007199254740991 then 'integer' when regexp_matches(s, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}\\.\\d{3}Z$') then 'timestamp' when regexp_matches(s, '^[^:]+(:[^:]*)*:(u[A-Za-z0-9_-]{43})$') then 'composite' else 'text' end string_class from (select created_at s from social_ops union all select op_id from social_ops union all select op_sequence::varchar from social_ops)) group by 1")
def string_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "social_ops")
    s = o.select(F.explode(F.array("created_at", "op_id", F.col("op_sequence").cast("string"))).alias("s"))
    return s.groupBy(fn.string_class(F.col("s")).alias("string_class")).agg(F.count("*").alias("n"))


@_query("select case " + " ".join(f"when o_orderkey < {1 << (7 * k)} then {k}" for k in range(1, 8)) + " else 8 end bytes, count(*) n from orders group by 1")
def varint_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(fn.varint_length(F.col("o_orderkey")).alias("bytes")).agg(F.count("*").alias("n"))


@_query("select c_custkey, 'customer:v1:u' || rtrim(replace(replace(to_base64(unhex(sha256(c_name))), '+', '-'), '/', '_'), '=') id from customer")
def multibase_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", fn.typed_id("customer", F.encode("c_name", "UTF-8")).alias("id"))


@_query("select n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}') digest from nation")
def canonical_json_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct("n_name", "n_nationkey", "n_regionkey"), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "nation").select("n_nationkey", F.sha2(body, 256).alias("digest"))


_LATEST = "i as (select object_id, r.* from (select object_id, arg_max({author_id: author_id, created_at: created_at, topics: topics, evidence_score: evidence_score}, item_no) r from feed_items group by 1))"
_SCORED = f"""with {_LATEST}, a as (select *, greatest(0, 1555286400000 - epoch_ms(created_at::timestamp)) age, coalesce(author_id in ({", ".join(repr(x) for x in _RANK.followed)}), false) rel from i),
s as (select object_id, author_id, greatest(0, 1000 - floor(least(age, 604800000) * 1000 / 604800000.0))::bigint recency, (case when rel then 1000 else 0 end)::bigint relationship, (case when rel then 0 else 1000 end)::bigint discovery, coalesce(evidence_score, 0)::bigint evidence,
floor(coalesce(list_sum(list_transform(topics, lambda t: case t when 'weather' then 400 when 'local-news' then 300 when 'archives' then 200 else 0 end)), 0) / greatest(coalesce(len(topics), 0), 1)::double)::bigint topic from a)
select *, floor((recency * 500 + relationship * 900 + evidence * 700 + discovery * 250) / 2350.0)::bigint + topic score from s"""


def _scored(spark, sf_dir):
    items = table(spark, sf_dir, "feed_items")
    latest = items.groupBy("object_id").agg(F.max_by(F.struct("author_id", "created_at", "topics", "evidence_score"), "item_no").alias("r")).select("object_id", "r.*")
    return ranking.scored(latest, _RANK)


@_query(_SCORED)
def feed_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("object_id", "author_id", "recency", "relationship", "discovery", "evidence", "topic", "score")


@_query()
def feed_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred items, at most two of one author in a row."""
    return ranking.ranked(_scored(spark, sf_dir), _RANK)


@_query("select object_id, count(*) n from feed_items where object_id is not null group by 1 having count(*) > 1")
def feed_repeated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.duplicated(table(spark, sf_dir, "feed_items"), "object_id")


@_query("""select case when object_id is null or object_id = '' then 'invalid_object' when author_id is null or author_id = '' then 'invalid_author' when not coalesce(regexp_matches(created_at, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}\\.\\d{3}Z$'), false) then 'invalid_time'
when coalesce(len(topics), 99) > 32 then 'invalid_topics' when not coalesce(evidence_score between 0 and 1000, false) then 'invalid_score' else 'none' end violation, count(*) n from feed_items group by 1""")
def feed_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.counted(table(spark, sf_dir, "feed_items"), validation.item_violation())


_OPS = "o as (select op_id, any_value(object_id) object_id, any_value(op_sequence) op_sequence, any_value(actor) actor, any_value(op_type) op_type, any_value(payload) p from social_ops group by 1)"
_CLOCK = "op_sequence desc, {0}actor collate en_us desc, {0}op_id collate en_us desc".replace("{0}", "")


def _ops(spark, sf_dir):
    return social_state.once(table(spark, sf_dir, "social_ops"))


@_query(f"with {_OPS} select object_id, p.field_name field_name, p.new_value new_value from o where op_type = 'profile.field.set' qualify row_number() over (partition by object_id, p.field_name order by {_CLOCK}) = 1")
def crdt_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return social_state.profiles(_ops(spark, sf_dir))


@_query(f"""with {_OPS}, l as (select * from o where op_type in ('post.block.set', 'post.block.delete') qualify row_number() over (partition by object_id, p.block_id order by {_CLOCK}) = 1)
select object_id, p.block_id block_id, p.block_kind block_kind, p.new_value new_value, row_number() over (partition by object_id order by coalesce(p.after_block, 'null') collate en_us, op_sequence, actor collate en_us, op_id collate en_us) place from l where op_type = 'post.block.set'""")
def crdt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return social_state.blocks(_ops(spark, sf_dir))


@_query(f"""with {_OPS}, gone as (select unnest(p.observed_add_ids) id from o where op_type = 'edge.remove')
select concat_ws(':', p.edge_kind, p.subject_id, p.target_id) edge_id, p.edge_kind edge_kind, p.subject_id subject_id, p.target_id target_id, op_id add_id from o where op_type = 'edge.add' and op_id not in (select id from gone where id is not null)""")
def crdt_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return social_state.edges(_ops(spark, sf_dir))


@_query(f"with {_OPS} select object_id, op_id, p.reason_code reason_code from o where op_type = 'object.tombstone' qualify row_number() over (partition by object_id order by {_CLOCK}) = 1")
def crdt_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return social_state.tombstones(_ops(spark, sf_dir))


def _form(x: str, kind: str) -> str:
    return f"coalesce(regexp_full_match({x}, '[a-z]*{kind}:v1:u[A-Za-z0-9_-]{{43}}'), false)"


_IS_TIME = "coalesce(regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d{{3}}Z') and try_cast({0} as timestamptz) is not null, false)"
_BLOCK_FORM = "[a-zA-Z0-9._:-]{1,96}"


@_query(f"""with o as (select *, payload p, octet_length(encode(payload.new_value)) b from social_ops) select case when not {_form("op_id", "op")} then 'invalid_op_id' when not {_form("actor", "id")} then 'invalid_actor' when not coalesce(op_sequence between 1 and 9007199254740991, false) then 'invalid_sequence'
when not {_IS_TIME.format("created_at")} then 'invalid_time' when not coalesce(regexp_full_match(object_id, '(profile|post|comment|community|media|channel|message):[a-zA-Z0-9._:-]{{1,160}}'), false) then 'invalid_object_id'
when not coalesce(op_type in ('profile.field.set', 'post.block.set', 'post.block.delete', 'edge.add', 'edge.remove', 'object.tombstone'), false) then 'invalid_type'
when op_type = 'profile.field.set' and not (starts_with(object_id, 'profile:') and coalesce(p.field_name in ('displayName', 'handle', 'bio', 'avatar'), false)) then 'invalid_profile'
when op_type = 'profile.field.set' and coalesce(b > (case when p.field_name = 'bio' then 2000 else 320 end) or contains(p.new_value, chr(0)), false) then 'invalid_text'
when op_type = 'post.block.set' and not (starts_with(object_id, 'post:') or starts_with(object_id, 'comment:')) then 'invalid_post'
when op_type = 'post.block.set' and not (coalesce(regexp_full_match(p.block_id, '{_BLOCK_FORM}'), false) and coalesce(regexp_full_match(p.after_block, '{_BLOCK_FORM}'), true) and coalesce(p.block_kind in ('text', 'media'), false)) then 'invalid_block'
when op_type = 'post.block.set' and not coalesce(b <= (case when p.block_kind = 'text' then 32000 else 2048 end) and not contains(p.new_value, chr(0)), false) then 'invalid_text'
when op_type = 'post.block.delete' and not coalesce(regexp_full_match(p.block_id, '{_BLOCK_FORM}'), false) then 'invalid_block'
when op_type in ('edge.add', 'edge.remove') and not coalesce(p.edge_kind in ('follow', 'reaction', 'membership', 'bookmark'), false) then 'invalid_edge'
when op_type in ('edge.add', 'edge.remove') and not coalesce(octet_length(encode(p.subject_id)) <= 200 and octet_length(encode(p.target_id)) <= 200, false) then 'invalid_text'
when op_type = 'edge.add' and coalesce(b > 128, false) then 'invalid_text'
when op_type = 'edge.remove' and not coalesce(len(p.observed_add_ids) <= 256 and len(list_filter(p.observed_add_ids, lambda x: not {_form("x", "op")})) = 0, false) then 'invalid_edge_remove'
when op_type = 'object.tombstone' and not coalesce(p.reason_code in ('author_delete', 'moderator_hide'), false) then 'invalid_tombstone' else 'none' end violation, count(*) n from o group by 1""")
def crdt_op_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.counted(table(spark, sf_dir, "social_ops"), validation.operation_violation())


@_query(f"""with c as (select change_id, change_header h, change_header.parents ps from changes) select case when not coalesce(h.protocol <> '' and h.proto_version = 1, false) then 'unsupported_protocol' when not {_form("change_id", "change")} then 'invalid_change_id'
when not {_form("h.space_id", "space")} or not {_form("h.author", "id")} then 'invalid_id' when not coalesce(h.kind in ('social.object.put', 'social.object.delete', 'membership.rotate', 'snapshot'), false) then 'invalid_kind' when not {_IS_TIME.format("h.created_at")} then 'invalid_time'
when not coalesce(regexp_full_match(h.nonce, 'u[A-Za-z0-9_-]{{16}}'), false) then 'invalid_nonce' when not coalesce(len(ps) <= 32 and list_sort(list_distinct(ps)) = ps, false) then 'invalid_parents'
when len(list_filter(ps, lambda x: not {_form("x", "change")})) > 0 then 'invalid_id' when list_contains(ps, change_id) then 'missing_or_cyclic_parent' else 'none' end violation, count(*) n from c group by 1""")
def change_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.counted(table(spark, sf_dir, "changes"), validation.change_violation())


_C = "c as (select change_id, any_value(change_header) h, min(delivery_id) first from changes group by 1), e as (select distinct change_id, unnest(change_header.parents) parent from changes)"


@_query(f"""with recursive {_GRAPH}, l as (select id change_id, max(depth) as level from walk where k = 'change' group by 1 union all select child, -1 from doomed where k = 'change')
select row_number() over (order by level, created_at collate en_us, change_id collate en_us, change_id) pos, change_id, level, created_at from l join (select change_id, min(change_header.created_at) created_at from changes group by 1) using (change_id)""")
def dag_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changesets.dag_order(table(spark, sf_dir, "changes"))


@_query(f"with {_C} select change_id from c where change_id not in (select parent from e where parent is not null)")
def dag_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changesets.heads(table(spark, sf_dir, "changes"))


@_query(f"with {_C} select change_id, parent from e where parent is not null and parent not in (select change_id from c)")
def dag_missing_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changesets.missing_parents(table(spark, sf_dir, "changes"))


@_query(f"with {_C} select h.space_id space_id, count(*) changes, count(*) filter (change_id not in (select parent from e where parent is not null)) heads from c group by 1")
def space_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changesets.space_receipts(table(spark, sf_dir, "changes"))


def _replicas(spark, sf_dir):
    """Two replicas that share a third of the deliveries."""
    c = table(spark, sf_dir, "changes")
    return c.filter("delivery_id % 3 <> 0"), c.filter("delivery_id % 3 <> 1")


_LACK = "select distinct change_id from changes where delivery_id % 3 <> 1 and change_id not in (select change_id from changes where delivery_id % 3 <> 0)"


@_query(_LACK)
def replica_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changesets.missing(*_replicas(spark, sf_dir))


@_query(f"{_LACK} order by 1 limit 128")
def replica_want(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changesets.want(*_replicas(spark, sf_dir))


@_query("select change_id, min(delivery_id) delivery_id from changes group by 1")
def replica_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changesets.merged(*_replicas(spark, sf_dir)).select("change_id", "delivery_id")


@_query("select change_id, count(*) n from changes group by 1 having count(distinct ciphertext || '|' || signature) > 1")
def change_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changesets.collisions(table(spark, sf_dir, "changes"), "change_id", "ciphertext", "signature")


@_query("select actor, op_sequence got, expected from (select actor, op_sequence, coalesce(lag(op_sequence) over (partition by actor order by op_sequence) + 1, 0) expected from (select distinct actor, op_sequence from social_ops)) where op_sequence <> expected")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changesets.sequence_gaps(table(spark, sf_dir, "social_ops").select("actor", "op_sequence").distinct(), "actor", "op_sequence")


@_query("select event_id, user_id, event_type from (select *, lag(ts) over (partition by user_id, event_type order by ts) prev from events) where epoch_us(ts) - epoch_us(prev) <= 120000000")
def nonce_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changesets.replayed(table(spark, sf_dir, "events"), "user_id", "event_type", "ts").select("event_id", "user_id", "event_type")


_S = "s as (select story_id, any_value(previous_story_id) previous_story_id, any_value(root_story_id) root_story_id, any_value(revision) revision, any_value(published_at) published_at, any_value(evidence_receipt_ids) ev, any_value(source_risk_labels) labels from story_manifests group by 1)"


def _stories(spark, sf_dir):
    return provenance.distinct_stories(table(spark, sf_dir, "story_manifests"))


@_query(f"with {_S} select previous_story_id, count(distinct story_id) children from s where previous_story_id is not null group by 1 having count(distinct story_id) > 1")
def history_forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.forks(_stories(spark, sf_dir))


@_query(f"""with {_S} select story_id, violation from (select c.story_id, case when not coalesce(c.revision = p.revision + 1, false) then 'invalid_revision' when c.root_story_id is null or c.root_story_id <> coalesce(p.root_story_id, p.story_id) then 'invalid_root' when c.published_at < p.published_at then 'invalid_time' end violation
from s c join s p on p.story_id = c.previous_story_id) where violation is not null""")
def history_broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.broken_links(_stories(spark, sf_dir))


@_query(f"with {_S} select distinct receipt_id from evidence_receipts where receipt_id not in (select r from (select unnest(ev) r from s) where r is not null)")
def history_orphan_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.orphan_evidence(_stories(spark, sf_dir), table(spark, sf_dir, "evidence_receipts"))


@_query(f"""with {_S}, l as (select distinct story_id, unnest(ev) receipt_id, labels from s)
select distinct story_id, receipt_id, source_risk from l join (select distinct receipt_id, source_risk from evidence_receipts) using (receipt_id) where source_risk is not null and not coalesce(list_contains(labels, source_risk), false)""")
def history_risk_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.undisclosed_risks(_stories(spark, sf_dir), table(spark, sf_dir, "evidence_receipts"))


@_query(f"with {_S} select root_story_id, story_id, revision, expected from (select *, coalesce(lag(revision) over (partition by root_story_id order by revision, story_id) + 1, 1) expected from s where root_story_id is not null) where revision <> expected")
def history_chain_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.chain_gaps(_stories(spark, sf_dir))


_STORE = store.StoreParams(sizes=_SIZES)


def _store(spark, sf_dir):
    return store.ingest(tables.blobs_from_texts(table(spark, sf_dir, "documents"), "doc_id", "text"), _STORE)


@_query()
def store_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir)[0].select("digest", "length", "kind", "reference_digest", "stored_bytes", "chain_depth", "standalone_baseline_bytes")


@_query()
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stats(*_store(spark, sf_dir))


@_query()
def store_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.depth_histogram(_store(spark, sf_dir)[0], _STORE.depth)


@_query("select cast(doc_id as varchar) blob_id, sha256(text) digest from documents where text is not null and text <> ''")
def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every text read back from the store."""
    records, manifest = _store(spark, sf_dir)
    return addressed.reassembled(manifest, store.resolved(records, _STORE), "blob_id").select("blob_id", F.sha2("content", 256).alias("digest"))


def _documents(spark, sf_dir):
    """Operations as JSON documents, and the events' properties, which are not in canonical form."""
    ops = table(spark, sf_dir, "social_ops").select(F.concat(F.lit("op"), "delivery_id").alias("id"), F.encode(F.to_json(F.struct("actor", "created_at", "object_id", "op_id", "op_sequence", "op_type")), "UTF-8").alias("document"))
    return ops.unionByName(table(spark, sf_dir, "events").select(F.concat(F.lit("ev"), "event_id").alias("id"), F.encode("props", "UTF-8").alias("document")))


@_query()
def container_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents are typed or kept plain, and the bytes before and after."""
    d = _documents(spark, sf_dir).withColumn("container", F.col("document"))
    return transcode.transcoded(d, "container").groupBy(transcode.mode(F.col("container")).alias("mode")).agg(F.count("*").alias("n"), F.sum(F.octet_length("document")).alias("bytes_in"), F.sum(F.octet_length("container")).alias("bytes_out"))


@_query("select 'ev' || event_id id, sha256(props) digest from events union all select 'op' || delivery_id, sha256('{\"actor\":\"' || actor || '\",\"created_at\":\"' || created_at || '\",\"object_id\":\"' || object_id || '\",\"op_id\":\"' || op_id || '\",\"op_sequence\":' || op_sequence || ',\"op_type\":\"' || op_type || '\"}') from social_ops")
def transcode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = transcode.transcoded(_documents(spark, sf_dir), "document")
    return transcode.transcoded(there, "document", back=True).select("id", F.sha2("document", 256).alias("digest"))


@_query("select change_header.space_id space_id, count(*) rows_opened from changes where change_header.space_id is not null group by 1")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deliveries of every space sealed as one snapshot and opened again."""
    key = F.unhex(F.sha2(F.lit(b"a key for checking"), 256))
    c = table(spark, sf_dir, "changes").select(F.col("change_header.space_id").alias("space_id"), "delivery_id", "change_id").filter("space_id is not null")
    iv = F.substring(F.unhex(F.sha2(F.encode("space_id", "UTF-8"), 256)), 1, 12)
    snapshots = tables.sealed(c, "space_id", "delivery_id", F.col("change_id"), key, iv)
    return tables.opened(snapshots, "space_id", key).groupBy("space_id").agg(F.count("*").alias("rows_opened"))


QUERIES = dict(_QUERIES)

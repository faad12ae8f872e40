"""Queries of replication, receipts, histories and schemas, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import time_ms, typed_id
from tessera.operators import accounting, provenance, replication, social_state, store, validation
from tessera.operators.ordering import list_digests
from tessera.plans.core_problems import _GRAPH, table
from tessera.plans.reference import _CLOCK, _DOC, _LACK, _OPS, _S, _ops, _replicas, _stories, _whole

QUERIES, SQL = {}, {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


_MINE = "(select change_id from changes where delivery_id % 3 <> 0)"


def _multibase(x: str) -> str:
    return f"'u' || rtrim(replace(replace(to_base64(unhex(sha256({x}))), '+', '-'), '/', '_'), '=')"


def _list(x: str, order: str) -> str:
    return _multibase(f"'[' || string_agg({x}, ',' order by {order}) || ']'")


@_query(f"select row_number() over (order by change_id) pos, change_id from (select distinct change_id from {_MINE})")
def replica_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replication.inventory(_replicas(spark, sf_dir)[0])


@_query(f"select distinct change_id, change_id in {_MINE} found from changes where delivery_id % 3 <> 1")
def replica_requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replication.requested(*_replicas(spark, sf_dir))


@_query(f"select change_id, (row_number() over (order by change_id) - 1) // 128 + 1 round from ({_LACK})")
def replica_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replication.rounds(*_replicas(spark, sf_dir))


@_query("""with c as (select change_id, arg_min(octet_length(encode(ciphertext)), delivery_id)::bigint b from changes group by 1), p as (select (row_number() over (order by change_id) - 1) // 128 + 1 payload, b from c)
select payload, count(*) changes, sum(b)::bigint bytes, sum(b) <= 4194304 fits from p group by 1""")
def change_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replication.payloads(table(spark, sf_dir, "changes"), F.octet_length("ciphertext"))


@_query(f"""with recursive {_GRAPH}, broken as (select child from raw where k = 'change' and parent is not null and parent not in (select change_id from changes)),
below as (select child from broken union select a.child from above a where a.k = 'change' and a.anc in (select child from broken) union select child from doomed where k = 'change')
select change_id, change_id not in (select child from below) accepted from ({_LACK})""")
def replica_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replication.applicable(*_replicas(spark, sf_dir))


_ONE = "c as (select change_id, arg_min(coalesce(change_header.space_id, ''), delivery_id) space_id from changes group by 1), h as (select * from c where change_id not in (select p from (select unnest(change_header.parents) p from changes) where p is not null))"


@_query(f"""with {_ONE}, r as (select space_id, count(*) changes, {_list("'\"' || change_id || '\"'", "change_id")} root from c group by 1), t as (select space_id, count(*) heads, {_list("'\"' || change_id || '\"'", "change_id")} heads_root from h group by 1)
select space_id, changes, coalesce(heads, 0) heads, root, heads_root from r left join t using (space_id)""")
def space_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipt of every space: counts and the hashes of its sorted changes and heads."""
    return replication.receipts(table(spark, sf_dir, "changes"))


@_query("select delivery_id from changes where not coalesce(abs(epoch_ms(received_at) - epoch_ms(try_cast(change_header.created_at as timestamptz))) <= 120000, false)")
def stale_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "changes").select("delivery_id", "received_at", F.col("change_header.created_at").alias("created_at"))
    return replication.stale(c, "created_at", F.unix_millis("received_at")).select("delivery_id")


@_query("""with c as (select change_id, arg_min({a: change_header.author, k: public_key, s: signature}, delivery_id) r from changes group by 1)
select r.a author, count(*) changes, count(distinct r.s) signatures, count(distinct r.k) public_keys, count(distinct r.k) = 1 bound from c group by 1""")
def author_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replication.key_bindings(table(spark, sf_dir, "changes"))


@_query("select delivery_id, change_id content, cast(null as varchar) violation from changes")
def change_seal_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change sealed, verified and opened again."""
    h = F.col("change_header")
    header = F.struct(h["author"].alias("author"), h["created_at"].alias("createdAt"), h["kind"].alias("kind"), h["parents"].alias("parents"), h["space_id"].alias("spaceId"), F.lit(1).alias("version"))
    key = F.unhex(F.sha2(F.lit(b"a key for checking"), 256))
    c = table(spark, sf_dir, "changes").select("delivery_id", "change_header", F.col("change_id").alias("content"))
    nonce = F.substring(F.unhex(F.sha2(F.encode(F.concat_ws(":", F.col("delivery_id").cast("string"), "content"), "UTF-8"), 256)), 1, 12)  # of the content, so no two contents share one
    done = replication.opened(replication.sealed(c, key, F.encode("content", "UTF-8"), header, nonce, "change"), key, header)
    told = replication.verification(done, header, "change")
    return done.select("delivery_id", "change_id", F.decode("plaintext", "UTF-8").alias("content")).join(told, "change_id").select("delivery_id", "content", "violation")


@_query("select op_type kind, count(*) n, count(*) filter (op_type <> 'edge.remove') read, count(distinct object_id) filter (op_type <> 'edge.remove') objects from social_ops group by 1")
def carrier_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations as carrier messages and back; one kind is not known and rejected."""
    o = table(spark, sf_dir, "social_ops").select("op_type", replication.framed(F.col("op_type"), F.struct("object_id", "op_id")).alias("m"))
    got = o.select("op_type", replication.unframed(F.col("m"), tuple(k for k in validation.OP_TYPES if k != "edge.remove"), "struct<object_id string, op_id string>").alias("r"))
    return got.groupBy(F.col("op_type").alias("kind")).agg(F.count("*").alias("n"), F.count("r").alias("read"), F.countDistinct("r.body.object_id").alias("objects"))


_BODY = """case op_type when 'profile.field.set' then to_json({field: p.field_name, value: p.new_value}) when 'post.block.set' then to_json({after: p.after_block, blockId: p.block_id, kind: p.block_kind, value: p.new_value})
when 'post.block.delete' then to_json({blockId: p.block_id}) when 'edge.add' then to_json({edge: p.edge_kind, subject: p.subject_id, target: p.target_id, value: p.new_value})
when 'edge.remove' then to_json({edge: p.edge_kind, observedAddIds: p.observed_add_ids, subject: p.subject_id, target: p.target_id}) else to_json({reason: p.reason_code}) end::varchar"""


@_query(f"""with {_OPS.replace("any_value(payload) p", "any_value(payload) p, any_value(created_at) created_at")}
select op_id, 'op:v1:' || {_multibase(f"concat('{{\"actor\":', to_json(actor)::varchar, ',\"createdAt\":', to_json(created_at)::varchar, ',\"objectId\":', to_json(object_id)::varchar, ',\"payload\":', {_BODY}, ',\"protocol\":\"social.operation\",\"sequence\":', coalesce(op_sequence::varchar, 'null'), ',\"type\":', to_json(op_type)::varchar, ',\"version\":1}}')")} derived from o""")
def op_ids_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id that follows from each operation's content."""
    return _ops(spark, sf_dir).select("op_id", typed_id("op", F.encode(social_state.operation_body("social.operation"), "UTF-8")).alias("derived"))


@_query(f"""with {_OPS}, r as (select coalesce(object_id, '') object_id, count(*) operations, {_list("'\"' || op_id || '\"'", "op_sequence, actor collate en_us, op_id collate en_us")} receipt from o group by 1),
f as (select object_id, count(distinct p.field_name) fields from o where op_type = 'profile.field.set' group by 1),
b as (select object_id, count(*) filter (op_type = 'post.block.set') blocks from (select * from o where op_type in ('post.block.set', 'post.block.delete') qualify row_number() over (partition by object_id, p.block_id order by {_CLOCK}) = 1) group by 1)
select r.*, object_id in (select object_id from o where op_type = 'object.tombstone') deleted, coalesce(fields, 0) fields, coalesce(blocks, 0) blocks from r left join f using (object_id) left join b using (object_id)""")
def object_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is current of every object, and the hash of the operations that made it."""
    return social_state.object_states(_ops(spark, sf_dir))


@_query(f"""with i as (select object_id, arg_max({{author_id: author_id, content_label: content_label, created_at: created_at, evidence_score: evidence_score, object_id: object_id, topics: topics}}, item_no) r from feed_items where object_id is not null group by 1)
select coalesce(substr(r.created_at, 1, 10), '') as day, count(*) n, {_list("to_json(r)::varchar", "object_id")} digest from i group by 1""")
def feed_input_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipt of a day's feed: the hash of its items, each once, in order of their ids."""
    items = table(spark, sf_dir, "feed_items").filter("object_id is not null")
    latest = items.groupBy("object_id").agg(F.max_by(F.struct("author_id", "content_label", "created_at", "evidence_score", "object_id", "topics"), "item_no").alias("r"))
    return list_digests(latest.select(F.coalesce(F.substring("r.created_at", 1, 10), F.lit("")).alias("day"), "object_id", F.to_json("r", {"ignoreNullFields": "false"}).alias("piece")), "day", ["object_id"], "piece")


@_query(f"""with recursive {_GRAPH}, root as (select id story_id, min(root) root_id from walk where k = 'story' group by 1), {_S},
e as (select root_id, count(distinct x) evidence from (select root_id, unnest(ev) x from s join root using (story_id)) group by 1), l as (select root_id, count(distinct x) labels from (select root_id, unnest(labels) x from s join root using (story_id)) group by 1)
select root_id, count(*) stories, coalesce(any_value(evidence), 0) evidence, coalesce(any_value(labels), 0) labels from root left join e using (root_id) left join l using (root_id) group by 1""")
def history_chain_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.chain_unions(_stories(spark, sf_dir))


@_query(f"""with recursive {_GRAPH}, {_S},
link as (select c.story_id, case when not coalesce(c.revision = p.revision + 1, false) then 'invalid_revision' when c.root_story_id is null or c.root_story_id <> coalesce(p.root_story_id, p.story_id) then 'invalid_root' when c.published_at < p.published_at then 'invalid_time' end violation from s c join s p on p.story_id = c.previous_story_id),
fork as (select previous_story_id from s where previous_story_id is not null group by 1 having count(distinct story_id) > 1),
ev as (select story_id, unnest(ev) r, labels from s), risk as (select distinct story_id from ev join (select distinct receipt_id r, source_risk from evidence_receipts) using (r) where source_risk is not null and not coalesce(list_contains(labels, source_risk), false))
select story_id, case when ('story', story_id) in (select (k, child) from doomed) then 'cycle' when previous_story_id is not null and previous_story_id not in (select story_id from s) then 'missing_predecessor' when coalesce(previous_story_id in (select previous_story_id from fork), false) then 'fork'
when violation is not null then violation when story_id in (select story_id from ev where r is not null and r not in (select receipt_id from evidence_receipts)) then 'missing_evidence' when story_id in (select story_id from risk) then 'undisclosed_risk' else 'valid' end verdict
from s left join link using (story_id)""")
def history_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thing wrong with every story of its history."""
    return provenance.verdicts(_stories(spark, sf_dir), table(spark, sf_dir, "evidence_receipts"))


@_query("select coalesce(list_sort(json_keys(props)) = ['k'], false) is_closed, count(*) n from events group by 1")
def props_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the events' properties have exactly their one key."""
    return table(spark, sf_dir, "events").groupBy(F.coalesce(validation.closed(F.col("props"), ("k",)), F.lit(False)).alias("is_closed")).agg(F.count("*").alias("n"))


@_query("select doc_id, n, asset, row_number() over (partition by asset order by n) - 1 item from (select *, n % least(16, ceil(sqrt(n + 1)))::bigint asset from (select doc_id, row_number() over (order by doc_id) - 1 n from documents))")
def reuse_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.reuse_schedule(table(spark, sf_dir, "documents"), "doc_id")


@_query("""with r as (select kind, sum(chunk_length)::double raw, sum(stored_bytes)::double stored, sum(standalone_baseline_bytes)::double alone, count(*) n from chunk_records where chunk_length is not null group by 1)
select kind, n, round(raw / stored, 6) ratio, round(raw / alone, 6) base_ratio, round((raw / stored) / (raw / alone) * (ln(n * 2.0) / ln(n + 1.0)), 6) score, round(raw / (n + 1) * 1000, 3) bytes_per_second from r""")
def compression_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of each kind of chunk against whole storage, and the score with times in proportion to the number of chunks."""
    r = table(spark, sf_dir, "chunk_records").filter("chunk_length is not null").groupBy("kind").agg(F.sum("chunk_length").cast("double").alias("raw"), F.sum("stored_bytes").cast("double").alias("stored"), F.sum("standalone_baseline_bytes").cast("double").alias("alone"), F.count("*").alias("n"))
    ours, base, seconds = accounting.ratio(F.col("raw"), F.col("stored")), accounting.ratio(F.col("raw"), F.col("alone")), (F.col("n") + 1) / 1000
    return r.select("kind", "n", F.round(ours, 6).alias("ratio"), F.round(base, 6).alias("base_ratio"), F.round(accounting.score(ours, seconds, base, F.col("n") * 2 / 1000), 6).alias("score"), F.round(accounting.throughput(F.col("raw"), seconds), 3).alias("bytes_per_second"))


@_query("""with recursive c as (select lower(digest) digest, arg_min({k: kind, r: lower(reference_digest)}, record_no) x from chunk_records group by 1),
way as (select digest, digest as at, [digest] seen, 0 step from c union all select w.digest, coalesce(c.x.r, ''), list_append(seen, coalesce(c.x.r, '')), step + 1 from way w join c on c.digest = w.at where c.x.k = 'delta' and not list_contains(seen, coalesce(c.x.r, '')) and step < 4)
select w.digest, case when c.digest is null then 'missing_reference' when list_contains(seen, coalesce(c.x.r, '')) then 'cycle' else 'too_deep' end fault from way w left join c on c.digest = w.at
where c.digest is null or (c.x.k = 'delta' and (list_contains(seen, coalesce(c.x.r, '')) or step = 4))""")
def chunk_chain_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, each by its first record, that cannot be resolved within four references."""
    c = table(spark, sf_dir, "chunk_records").withColumn("digest", F.lower("digest"))
    one = c.groupBy("digest").agg(F.min_by(F.struct("kind", F.lower("reference_digest").alias("reference_digest")), "record_no").alias("r")).select("digest", "r.*")
    return store.chain_faults(one, 4)


@_query(f"with {_DOC} select row_number() over (order by min(doc_id), digest) pos, digest from d group by digest")
def doc_digest_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct texts' digests in order of their first document."""
    return store.listed(_whole(spark, sf_dir).groupBy("digest").agg(F.min("doc_id").alias("seq")))

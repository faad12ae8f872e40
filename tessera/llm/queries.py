"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import capping, history, mixing, neardup, packing, repetition, tokens
from tessera.plans.core_problems import table
from tessera.session import materialize, scratch_path


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunk_records").withColumn("digest", F.lower("digest"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_pairs(_chunks(spark, sf_dir), "digest", "payload").withColumnsRenamed({"key_a": "digest_a", "key_b": "digest_b"})


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every chunk that has an edited version, named by the group's smallest digest."""
    return neardup.groups(neardup.near_pairs(_chunks(spark, sf_dir), "digest", "payload", links=True)).withColumnsRenamed({"key": "digest", "group_key": "group_digest"})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "feed_items").filter("object_id is not null")
    latest = items.groupBy("object_id").agg(F.max_by(F.struct("author_id", "created_at", "evidence_score"), "item_no").alias("r")).select("object_id", "r.*")
    group = F.when(F.col("author_id").isNotNull(), F.concat("author_id", F.lit("\u0000"), F.coalesce(F.substring("created_at", 1, 10), F.lit(""))))
    return capping.over_limit(latest, group, capping.preference_key(F.col("evidence_score"), F.col("object_id")), most=4).select("object_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads, the earlier half of the batches into an empty store and then the rest."""
    chunks = _chunks(spark, sf_dir).select("digest", F.col("payload").alias("content"), F.col("batch_no").alias("batch"))
    named = table(spark, sf_dir, "ingest_receipts").select(F.explode("chunk_digests").alias("digest"), F.col("batch_no").alias("batch")).select(F.lower("digest").alias("digest"), "batch")
    half = (chunks.agg(F.max("batch")).first()[0] or 0) // 2
    store = history.History(spark, scratch_path(spark, "history"))
    early = store.add(chunks.filter(F.col("batch") <= half), named.filter(F.col("batch") <= half))
    return early.unionByName(store.add(chunks.filter(F.col("batch") > half), named.filter(F.col("batch") > half))).withColumnRenamed("batch", "batch_no")


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(tokens.token_lengths(table(spark, sf_dir, "documents"), "doc_id", "text", "source"), "lengths")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's container, for each capacity."""
    lengths, out = _lengths(spark, sf_dir), None
    for r in table(spark, sf_dir, "pack_sizes").collect():  # three rows
        one = packing.packed(lengths.select("id", "n_tokens"), r.capacity_tokens)
        one = one.select(F.lit(r.pack_name).alias("pack_name"), "container", F.col("id").alias("doc_id"), "piece", "start", "n_tokens")
        out = one if out is None else out.unionByName(one)
    return out


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are, per capacity."""
    filled = p8_packed(spark, sf_dir).groupBy("pack_name").agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    sizes = table(spark, sf_dir, "pack_sizes")
    return filled.join(F.broadcast(sizes), "pack_name").select("pack_name", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled_share"))


def p9_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn, with how often each is used."""
    return mixing.mixed(_lengths(spark, sf_dir), table(spark, sf_dir, "mix_targets")).withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source."""
    return mixing.report(p9_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repeating(table(spark, sf_dir, "documents"), "doc_id", "text", "doc_kind").select("doc_id")


def p10_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cutoff certified for each kind of document, with what all clean and repeating documents say of it."""
    return repetition.cutoffs_for(repetition.scored_for(table(spark, sf_dir, "documents"), "doc_id", "text", "doc_kind"), "doc_id", "doc_kind")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word runs and repeated share of every document."""
    scored = repetition.measured(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return scored.select("doc_id", F.col("_runs").cast("long").alias("runs"), F.round("_share", 9).alias("repeated_share"))


QUERIES = {f.__name__: f for f in (p2_found, p2_groups, p5_found, p6_found, p8_packed, p8_fill, p9_mixed, p9_shares, p10_found, p10_cutoffs, p10_shares)}

_RUNS = """
w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+') words from documents),
r as (select doc_id, greatest(len(words) - 5, 0) runs, list_transform(range(1, greatest(len(words) - 5, 0) + 1), lambda i: array_to_string(words[i:i+5], ' ')) run from w),
s as (select doc_id, runs::bigint runs, case when runs > 0 then (runs - len(list_distinct(run))) / runs::double else 0.0 end share from r)
"""

_PAIRS = """
c as (select lower(digest) digest, min(hex(payload)) x from chunk_records where payload is not null and digest is not null group by 1),
r as (select distinct digest, substr(x, 2 * i + 1, 16) run from (select digest, x, unnest(range(0, length(x) // 2 - 7)) i from c)),
n as (select digest, count(*) n from r group by 1),
met as (select a.digest digest_a, b.digest digest_b, count(*) shared from r a join r b on a.run = b.run and a.digest < b.digest group by 1, 2),
pairs as (select digest_a, digest_b from met join n na on na.digest = digest_a join n nb on nb.digest = digest_b where shared >= 0.7 * (na.n + nb.n - shared))
"""

SQL: dict[str, str] = {
    "p2_found": f"with {_PAIRS} select digest_a, digest_b from pairs",
    "p2_groups": f"""
with recursive {_PAIRS}, e as (select digest_a a, digest_b b from pairs union select digest_b, digest_a from pairs),
reach as (select a, a b from e union select r.a, e.b from reach r join e on e.a = r.b)
select a digest, min(b) group_digest from reach group by 1
""",
    "p6_found": f"""
with {_PAIRS}, held as (select distinct batch_no, lower(digest) digest from chunk_records where digest is not null and batch_no is not null),
come as (select * from held union select batch_no, lower(d) from (select batch_no, unnest(chunk_digests) d from ingest_receipts) where d is not null and batch_no is not null),
first as (select digest, min(batch_no) b from come group by 1), stored as (select digest, min(batch_no) b from held group by 1),
near as (select digest_a d, digest_b e from pairs union all select digest_b, digest_a from pairs)
select batch_no, digest from come join first using (digest) where batch_no > b
union select h.batch_no, h.digest from held h join near on near.d = h.digest join stored s on s.digest = near.e where s.b < h.batch_no
""",
    "p5_found": """
with l as (select object_id, arg_max({a: author_id, c: created_at, s: evidence_score}, item_no) r from feed_items where object_id is not null group by 1)
select object_id from l where r.a is not null
qualify row_number() over (partition by r.a, substr(r.c, 1, 10) order by r.s desc nulls last, object_id) > 4
""",
    "p10_found": f"with {_RUNS} select doc_id from s where runs >= 12 and share >= 0.3",
    "p10_shares": f"with {_RUNS} select doc_id, runs, round(share, 9) repeated_share from s",
}

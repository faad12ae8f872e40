"""Violation codes of records: the first rule a row breaks, null for none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import SAFE, multibase_decoded, time_ms

# The form of identifiers, kinds and bounds of the record formats.
OP_TYPES = ("profile.field.set", "post.block.set", "post.block.delete", "edge.add", "edge.remove", "object.tombstone")
CHANGE_KINDS = ("social.object.put", "social.object.delete", "membership.rotate", "snapshot")
FIELDS, BLOCK_KINDS, EDGES, REASONS = ("displayName", "handle", "bio", "avatar"), ("text", "media"), ("follow", "reaction", "membership", "bookmark"), ("author_delete", "moderator_hide")
OBJECT = r"^(profile|post|comment|community|media|channel|message):[a-zA-Z0-9._:-]{1,160}$"
BLOCK = r"^[a-zA-Z0-9._:-]{1,96}$"
MOST_PARENTS, MOST_TOPICS, MOST_SCORE, MOST_OBSERVED = 32, 32, 1000, 256


def typed(kind: str) -> str:
    """The form of an id of a kind: any project's prefix that ends with the kind's name, version 1 and a multibase hash."""
    return f"^[a-z]*{kind}:v1:u[A-Za-z0-9_-]{{43}}$"


def bounded(text: Column, most: int, nullable: bool = False) -> Column:
    """Whether a text has at most ``most`` bytes of UTF-8 and no NUL."""
    fits = (F.octet_length(text) <= most) & (F.locate("\0", text) == 0)
    return (text.isNull() | fits) if nullable else (text.isNotNull() & fits)


def closed(document: Column, names: tuple[str, ...]) -> Column:
    """Whether a JSON text is an object with exactly these keys."""
    return F.array_sort(F.json_object_keys(document)) == F.array(*[F.lit(n) for n in sorted(names)])


def _first(*rules: tuple[Column, str]) -> Column:
    """A rule whose condition is null counts as broken."""
    out = F.when(~F.coalesce(rules[0][0], F.lit(False)), rules[0][1])
    for holds, code in rules[1:]:
        out = out.when(~F.coalesce(holds, F.lit(False)), code)
    return out


def sorted_unique(ids: Column, most: int) -> Column:
    """Ascending in bytes, without repeats or nulls, and at most ``most``."""
    return (F.size(ids) <= most) & (F.array_sort(F.array_distinct(ids)) == ids) & ~F.exists(ids, lambda x: x.isNull())


def change_violation(protocol: str | None = None) -> Column:
    """``protocol``: the name that headers must have; None: any, but some."""
    h = F.col("change_header")
    named = (h["protocol"] == protocol) if protocol else (F.length(h["protocol"]) > 0)
    return _first(
        (named & (h["proto_version"] == 1), "unsupported_protocol"), (F.col("change_id").rlike(typed("change")), "invalid_change_id"), (h["space_id"].rlike(typed("space")), "invalid_id"), (h["author"].rlike(typed("id")), "invalid_id"),
        (h["kind"].isin(*CHANGE_KINDS), "invalid_kind"), (time_ms(h["created_at"]).isNotNull(), "invalid_time"), (F.octet_length(multibase_decoded(h["nonce"])) == 12, "invalid_nonce"), (sorted_unique(h["parents"], MOST_PARENTS), "invalid_parents"),
        (F.forall(h["parents"], lambda p: p.rlike(typed("change"))), "invalid_id"), (~F.array_contains(h["parents"], F.col("change_id")), "missing_or_cyclic_parent"),
    )


def operation_violation() -> Column:
    p, kind, o = F.col("payload"), F.col("op_type"), F.col("object_id")
    value = p["new_value"]

    def when(*kinds: str):
        return lambda rule, code: (~kind.isin(*kinds) | F.coalesce(rule, F.lit(False)), code)

    profile, block, delete, edge, add, remove, stone = when("profile.field.set"), when("post.block.set"), when("post.block.delete"), when("edge.add", "edge.remove"), when("edge.add"), when("edge.remove"), when("object.tombstone")
    return _first(
        (F.col("op_id").rlike(typed("op")), "invalid_op_id"), (F.col("actor").rlike(typed("id")), "invalid_actor"), (F.col("op_sequence").between(1, SAFE), "invalid_sequence"), (time_ms(F.col("created_at")).isNotNull(), "invalid_time"),
        (o.rlike(OBJECT), "invalid_object_id"), (kind.isin(*OP_TYPES), "invalid_type"),
        profile(o.startswith("profile:") & p["field_name"].isin(*FIELDS), "invalid_profile"), profile(F.when(p["field_name"] == "bio", bounded(value, 2_000, True)).otherwise(bounded(value, 320, True)), "invalid_text"),
        block(o.startswith("post:") | o.startswith("comment:"), "invalid_post"), block(p["block_id"].rlike(BLOCK) & (p["after_block"].isNull() | p["after_block"].rlike(BLOCK)) & p["block_kind"].isin(*BLOCK_KINDS), "invalid_block"), block(F.when(p["block_kind"] == "text", bounded(value, 32_000)).otherwise(bounded(value, 2_048)), "invalid_text"),
        delete(p["block_id"].rlike(BLOCK), "invalid_block"), edge(p["edge_kind"].isin(*EDGES), "invalid_edge"), edge(bounded(p["subject_id"], 200) & bounded(p["target_id"], 200), "invalid_text"), add(bounded(value, 128, True), "invalid_text"),
        remove((F.size(p["observed_add_ids"]) <= MOST_OBSERVED) & F.forall(p["observed_add_ids"], lambda x: F.coalesce(x.rlike(typed("op")), F.lit(False))), "invalid_edge_remove"), stone(p["reason_code"].isin(*REASONS), "invalid_tombstone"),
    )


def item_violation() -> Column:
    return _first((F.length("object_id") > 0, "invalid_object"), (F.length("author_id") > 0, "invalid_author"), (time_ms(F.col("created_at")).isNotNull(), "invalid_time"), (F.size("topics") <= MOST_TOPICS, "invalid_topics"), (F.col("evidence_score").between(0, MOST_SCORE), "invalid_score"))


def counted(df: DataFrame, violation: Column) -> DataFrame:
    """(violation, n), rows without one under 'none'."""
    return df.groupBy(F.coalesce(violation, F.lit("none")).alias("violation")).agg(F.count("*").alias("n"))


def duplicated(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")

"""Replication of signed changes: requests, payloads, what may be applied, receipts, and the sealed form of a change.

Sets of changes meet by joins on their ids; orders are total positions (ordering.numbered), so a request or a payload is a range
of positions and any number of rounds is planned at once. Signatures are checked in Arrow batches, everything else by built-in
expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import ed25519
from tessera.functions.text import multibase, multibase_decoded, time_ms, typed_id
from tessera.operators import changesets, hierarchy
from tessera.operators.ordering import list_digests, numbered

# Bounds of the exchange.
MOST_INVENTORY, MOST_BATCH, MOST_BYTES, FRESH_MS = 4_096, 128, 4 << 20, 120_000


def inventory(changes: DataFrame) -> DataFrame:
    """(pos, change_id): the distinct ids in byte order; message number (pos - 1) div MOST_INVENTORY names a bounded part of it."""
    return numbered(changes.select("change_id").filter("change_id is not null").distinct(), [F.col("change_id")])


def requested(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """(change_id, found): every distinct wanted id and whether the store has it; a complete answer has no false."""
    have = store.select("change_id").distinct().withColumn("_have", F.lit(True))
    return wanted.select("change_id").filter("change_id is not null").distinct().join(have, "change_id", "left").select("change_id", F.coalesce("_have", F.lit(False)).alias("found"))


def rounds(mine: DataFrame, theirs: DataFrame, most: int = MOST_BATCH) -> DataFrame:
    """(change_id, round): in which round of bounded requests each id that ``mine`` lacks is asked for, from 1.

    Requests go in byte order, so all rounds of an anti-entropy exchange are known at once; after the last one both have the same.
    """
    lacking = numbered(changesets.missing(mine, theirs).filter("change_id is not null"), [F.col("change_id")])
    return lacking.select("change_id", F.expr(f"(pos - 1) div {int(most)} + 1").alias("round"))


def payloads(changes: DataFrame, size: Column, most: int = MOST_BATCH, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(payload, changes, bytes, fits): consecutive changes by id, ``most`` at a time, and whether they keep to the byte limit."""
    one = changesets.distinct_changes(changes).filter("change_id is not null").select("change_id", size.cast("long").alias("bytes"))
    at = numbered(one, [F.col("change_id")]).withColumn("payload", F.expr(f"(pos - 1) div {int(most)} + 1"))
    return at.groupBy("payload").agg(F.count("*").alias("changes"), F.sum("bytes").alias("bytes")).withColumn("fits", F.col("bytes") <= most_bytes)


def applicable(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """(change_id, accepted) of the incoming ids the store lacks: accepted when every ancestor is in the store or accepted too.

    A change below a missing parent, on a cycle or below one is not. Null ids are left out.
    """
    both = store.select("change_id", "change_header", "delivery_id").unionByName(incoming.select("change_id", "change_header", "delivery_id"))
    broken = changesets.missing_parents(both).select("change_id").distinct().withColumn("_broken", F.lit(True))
    own = F.when(F.col("_broken"), F.array("change_id")).otherwise(F.array().cast("array<string>"))  # its own parent: placed by no order
    nodes = both.join(broken, "change_id", "left").select(F.col("change_id").alias("node_id"), F.concat(F.coalesce("change_header.parents", F.array().cast("array<string>")), own).alias("parents"), F.col("change_header.space_id").alias("family"), F.col("delivery_id").alias("nth"))
    placed = hierarchy.resolve(nodes, ["family", "nth"]).select(F.col("node_id").alias("change_id"), (F.col("node_depth") >= 0).alias("accepted"))
    return changesets.missing(store, incoming).filter("change_id is not null").join(placed, "change_id")


def receipts(changes: DataFrame) -> DataFrame:
    """(space_id, changes, heads, root, heads_root): per space how many distinct changes and heads, and the hash of their sorted ids."""
    one = changesets.distinct_changes(changes).filter("change_id is not null").select("change_id", F.coalesce("change_header.space_id", F.lit("")).alias("space_id"), F.to_json(F.array("change_id")).alias("_list"))
    one = one.withColumn("piece", F.expr("substring(_list, 2, length(_list) - 2)"))
    top = one.join(changesets.heads(changes), "change_id")
    both = list_digests(one, "space_id", ["change_id"], "piece").select("space_id", F.col("n").alias("changes"), F.col("digest").alias("root"))
    return both.join(list_digests(top, "space_id", ["change_id"], "piece").select("space_id", F.col("n").alias("heads"), F.col("digest").alias("heads_root")), "space_id", "left").select("space_id", "changes", F.coalesce("heads", F.lit(0)).alias("heads"), "root", "heads_root")


def stale(messages: DataFrame, at: str, now_ms: Column, most_ms: int = FRESH_MS) -> DataFrame:
    """Messages whose exact-millisecond time is unreadable or further than ``most_ms`` from now."""
    return messages.filter(~F.coalesce(F.abs(now_ms - time_ms(F.col(at))) <= most_ms, F.lit(False)))


def key_bindings(changes: DataFrame) -> DataFrame:
    """(author, changes, signatures, public_keys, bound): whether all of an author's distinct changes carry one key, as a session's peer must."""
    one = changesets.distinct_changes(changes).select(F.col("change_header.author").alias("author"), "public_key", "signature")
    return one.groupBy("author").agg(F.count("*").alias("changes"), F.countDistinct("signature").alias("signatures"), F.countDistinct("public_key").alias("public_keys")).withColumn("bound", F.col("public_keys") == 1)


def descriptor(header: Column, hash_text: Column) -> Column:
    """What a change's author signs: the canonical JSON of its header and its ciphertext's hash. The header's fields must be in order of their names."""
    return F.to_json(F.struct(hash_text.alias("ciphertextHash"), header.alias("header")), {"ignoreNullFields": "false"})


def sealed(changes: DataFrame, key: Column, plaintext: Column, header: Column, nonce: Column, prefix: str) -> DataFrame:
    """``changes`` with ciphertext, ciphertext_hash, descriptor and change_id: AES-256-GCM under ``key``, bound to the header as additional data."""
    aad = F.to_json(header, {"ignoreNullFields": "false"})
    cipher = F.aes_encrypt(plaintext, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, aad)
    out = changes.withColumn("ciphertext", multibase(cipher)).withColumn("ciphertext_hash", multibase(F.unhex(F.sha2(multibase_decoded(F.col("ciphertext")), 256))))
    return out.withColumn("descriptor", descriptor(header, F.col("ciphertext_hash"))).withColumn("change_id", typed_id(prefix, F.encode("descriptor", "UTF-8")))


def opened(sealed_changes: DataFrame, key: Column, header: Column) -> DataFrame:
    """``sealed_changes`` with the plaintext; null where key, header or ciphertext do not fit."""
    aad = F.to_json(header, {"ignoreNullFields": "false"})
    return sealed_changes.withColumn("plaintext", F.try_aes_decrypt(multibase_decoded(F.col("ciphertext")), key, F.lit("GCM"), F.lit("DEFAULT"), aad))


def _each(df: DataFrame, name: str, kind: str, *columns: str):
    def apply(f) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [f(*x) for x in zip(*(batch.column(c).to_pylist() for c in columns))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, {"binary": pa.binary(), "boolean": pa.bool_()}[kind])], names=[*batch.schema.names, name])

        return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{name}` {kind}")

    return apply


def signed(df: DataFrame, message: str, secret: bytes) -> DataFrame:
    """``df`` with ``signature`` BINARY over the ``message`` STRING; null for a null message."""
    return _each(df, "signature", "binary", message)(lambda m: None if m is None else ed25519.sign(secret, m.encode()))


def verified(df: DataFrame, public_key: str, message: str, signature: str) -> DataFrame:
    """``df`` with ``valid``: whether the BINARY ``signature`` is that of the BINARY ``public_key`` over the ``message``; false where one is null."""
    return _each(df, "valid", "boolean", public_key, message, signature)(lambda k, m, s: None not in (k, m, s) and ed25519.verify(k, m.encode(), s))


def verification(changes: DataFrame, header: Column, prefix: str) -> DataFrame:
    """(change_id, violation) of sealed changes: the first of hash, id and (with a ``valid`` column) signature that does not fit; null for none."""
    whole = multibase_decoded(F.col("ciphertext"))
    told = descriptor(header, F.col("ciphertext_hash"))
    code = F.when(~F.coalesce(multibase(F.unhex(F.sha2(whole, 256))) == F.col("ciphertext_hash"), F.lit(False)), "ciphertext_hash_mismatch").when(~F.coalesce(typed_id(prefix, F.encode(told, "UTF-8")) == F.col("change_id"), F.lit(False)), "change_id_mismatch")
    if "valid" in changes.columns:
        code = code.when(~F.coalesce("valid", F.lit(False)), "invalid_signature")
    return changes.select("change_id", code.alias("violation"))


def framed(kind: Column, body: Column) -> Column:
    """A carrier message: canonical JSON of its body and kind."""
    return F.to_json(F.struct(body.alias("body"), kind.alias("kind")), {"ignoreNullFields": "false"})


def unframed(message: Column, kinds: tuple[str, ...], body_type: str) -> Column:
    """Struct (body, kind) of a message; null where it is no such JSON or of another kind."""
    read = F.from_json(message, f"body {body_type}, kind string")
    return F.when(read["kind"].isin(*kinds), read)

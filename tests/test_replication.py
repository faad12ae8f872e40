"""Sealing, signatures, requests and rules on small fixtures: nulls, repeats, empty tables, tampering."""

from datetime import datetime

from pyspark.sql import functions as F

from tessera.functions import ed25519
from tessera.operators import ordering, replication, validation

CHANGES = "delivery_id long, change_id string, change_header struct<space_id: string, author: string, created_at: string, parents: array<string>>"


def change(n, name, parents=(), space="s"):
    return (n, name, (space, "a", "2024-01-01T00:00:00.000Z", list(parents) if parents is not None else None))


def test_numbered_and_list_digests(spark):
    df = spark.createDataFrame([(i * 7 % 100, f"g{i % 3}") for i in range(100)], "k long, g string")
    assert {r.k: r.pos for r in ordering.numbered(df, [F.col("k")]).collect()} == {i: i + 1 for i in range(100)}
    assert ordering.numbered(df.limit(0), [F.col("k")]).count() == 0
    import base64
    import hashlib

    got = {r.g: (r.n, r.digest) for r in ordering.list_digests(df.withColumn("p", F.col("k").cast("string")), "g", ["k"], "p").collect()}
    for g in ("g0", "g1", "g2"):
        ks = sorted(i * 7 % 100 for i in range(100) if f"g{i % 3}" == g)
        want = hashlib.sha256(("[" + ",".join(map(str, ks)) + "]").encode()).digest()
        assert got[g] == (len(ks), "u" + base64.urlsafe_b64encode(want).rstrip(b"=").decode())


def test_requests_rounds_and_what_may_be_applied(spark):
    store = spark.createDataFrame([change(1, "a"), change(2, "b", ["a"]), change(9, None)], CHANGES)
    incoming = spark.createDataFrame([change(3, "b", ["a"]), change(4, "c", ["b", "a"]), change(5, "d", ["lost"]), change(6, "e", ["d"]), change(7, "f", ["g"]), change(8, "g", ["f"]), change(8, "c", ["b"]), change(10, "h", None), change(11, None)], CHANGES)
    got = {r.change_id: r.accepted for r in replication.applicable(store, incoming).collect()}
    assert got == {"c": True, "d": False, "e": False, "f": False, "g": False, "h": True}
    assert {r.change_id: r["round"] for r in replication.rounds(store, incoming, most=4).collect()} == {"c": 1, "d": 1, "e": 1, "f": 1, "g": 2, "h": 2}
    assert {r.change_id: r.found for r in replication.requested(store, incoming).collect()} == {x: x == "b" for x in "bcdefgh"}
    assert replication.rounds(store, incoming.limit(0)).count() == 0 and replication.applicable(store, incoming.limit(0)).count() == 0
    r = {x.space_id: x for x in replication.receipts(store.unionByName(incoming)).collect()}["s"]
    assert r.changes == 8 and r.heads == 3 and r.root != r.heads_root


def test_sealed_changes_verify_until_tampered_with(spark):
    key = F.lit(bytes(range(32)))
    secret = bytes(32)
    df = spark.createDataFrame([(i, f"text {i}é") for i in range(4)], "i long, body string")
    header = F.struct(F.lit("me").alias("author"), F.col("i").alias("n"))
    made = replication.sealed(df, key, F.encode("body", "UTF-8"), header, F.substring(F.unhex(F.sha2(F.encode("body", "UTF-8"), 256)), 1, 12), "change")
    made = replication.signed(made, "descriptor", secret).withColumn("public", F.lit(ed25519.public_key(secret)))
    made = made.withColumn("ciphertext", F.when(F.col("i") == 1, F.concat(F.lit("uAAAA"), F.col("ciphertext").substr(6, 999))).otherwise(F.col("ciphertext")))
    made = made.withColumn("signature", F.when(F.col("i") == 2, F.lit(bytes(64))).otherwise(F.col("signature"))).withColumn("i", F.when(F.col("i") == 3, 33).otherwise(F.col("i")))
    told = replication.verification(replication.verified(made, "public", "descriptor", "signature"), header, "change").collect()
    assert [r.violation for r in told] == [None, "ciphertext_hash_mismatch", "invalid_signature", "change_id_mismatch"]
    assert [r.plaintext and bytes(r.plaintext).decode() for r in replication.opened(made, key, header).collect()] == ["text 0é", None, "text 2é", None]


def test_messages_freshness_and_schemas(spark):
    df = spark.createDataFrame([("want", "x", "2024-01-01T00:00:00.000Z"), ("odd", None, "2024-01-01T00:02:00.001Z"), (None, "y", None)], "kind string, body string, at string")
    m = df.select("kind", "body", replication.unframed(replication.framed(F.col("kind"), F.col("body")), ("want",), "string").alias("r"))
    assert [(r.r.body if r.r else None) for r in m.collect()] == ["x", None, None]
    now = int(datetime.fromisoformat("2024-01-01T00:00:00+00:00").timestamp() * 1000)
    assert [r.kind for r in replication.stale(df, "at", F.lit(now)).collect()] == ["odd", None]
    j = spark.createDataFrame([('{"a":1,"b":2}',), ('{"b":2,"a":1}',), ('{"a":1}',), ("[1]",), ("no",), (None,)], "j string")
    assert [bool(r[0]) for r in j.select(validation.closed(F.col("j"), ("b", "a"))).collect()] == [True, True, False, False, False, False]


def test_operation_rules(spark):
    op, me = "xop:v1:u" + "A" * 43, "xid:v1:u" + "A" * 43
    schema = "op_id string, actor string, op_sequence long, created_at string, op_type string, object_id string, payload struct<field_name: string, block_id: string, after_block: string, block_kind: string, edge_kind: string, subject_id: string, target_id: string, new_value: string, observed_add_ids: array<string>, reason_code: string>"
    names = ["field_name", "block_id", "after_block", "block_kind", "edge_kind", "subject_id", "target_id", "new_value", "observed_add_ids", "reason_code"]

    def row(kind, obj, op_id=op, actor=me, seq=1, **p):
        return (op_id, actor, seq, "2024-01-01T00:00:00.000Z", kind, obj, tuple(p.get(n) for n in names))

    edge = {"edge_kind": "follow", "subject_id": "s", "target_id": "t"}
    cases = [
        (row("profile.field.set", "profile:a", field_name="bio", new_value="é" * 1000), None), (row("profile.field.set", "profile:a", field_name="bio", new_value="é" * 1001), "invalid_text"), (row("profile.field.set", "post:a", field_name="bio"), "invalid_profile"),
        (row("profile.field.set", "profile:a", field_name="bio", op_id=me), "invalid_op_id"), (row("profile.field.set", "profile:a", field_name="bio", actor=op), "invalid_actor"), (row("profile.field.set", "profile:a", field_name="bio", seq=0), "invalid_sequence"),
        (row("post.block.set", "post:a", block_id="b", block_kind="text", new_value="x"), None), (row("post.block.set", "post:a", block_id="b", block_kind="text"), "invalid_text"), (row("post.block.set", "post:a", block_id="b", block_kind="poll", new_value="x"), "invalid_block"), (row("post.block.set", "channel:a", block_id="b", block_kind="text", new_value="x"), "invalid_post"),
        (row("post.block.set", "post:a", block_id="b", block_kind="text", new_value="a\0b"), "invalid_text"), (row("post.block.delete", "post:a", block_id="b c"), "invalid_block"), (row("edge.add", "channel:a", **edge), None), (row("edge.add", "channel:a", edge_kind="like"), "invalid_edge"),
        (row("edge.remove", "channel:a", **edge, observed_add_ids=[op]), None), (row("edge.remove", "channel:a", **edge, observed_add_ids=[op, None]), "invalid_edge_remove"), (row("edge.remove", "channel:a", **edge), "invalid_edge_remove"), (row("object.tombstone", "post:a", reason_code="spam"), "invalid_tombstone"), (row("other", "post:a"), "invalid_type"), (row("object.tombstone", "a"), "invalid_object_id"),
    ]
    got = spark.createDataFrame([c[0] for c in cases], schema).select(validation.operation_violation().alias("v")).collect()
    assert [r.v for r in got] == [c[1] for c in cases]

"""Scalar functions and byte codecs against golden vectors and brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import ed25519
from tessera.functions import text as fn
from tessera.functions.bloom import Bloom
from tessera.functions.u32 import mix32, np_mix32
from tessera.operators import chunking, delta, sketches, transcode


def test_golden_vectors():
    assert [int(x) for x in chunking.GEAR[:4]] == [0x9F003DA4, 0xD7995366, 0xF102F89F, 0x27922745]
    assert [int(x) for x in sketches.TABLE[:4]] == [0x32F6F8E6, 0x041B17AB, 0x44351B4B, 0xDA4248C9]
    assert np_mix32(np.array([1, 0xFFFFFFFF])).tolist() == [2261973619, 2578835075]
    p = sketches.SketchParams()
    assert sketches.features(b"abc", p).tolist() == [2224114336]
    assert sketches.features(bytes(range(16)), p).tolist() == [4280178529]
    assert sketches.features(b"", p).tolist() == []


def test_mix32_column(spark):
    values = [0, 1, 65535, 65536, 0xFFFFFFFF, 123456789]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(mix32(F.col("v"))).collect()]
    assert got == np_mix32(np.array(values, np.uint32)).tolist()


@pytest.mark.parametrize("sizes", [(64, 256, 1024), (33, 128, 512), (8, 32, 64)])
@pytest.mark.parametrize("n", [0, 1, 64, 65, 5000])
def test_cut_equals_the_byte_at_a_time_rule(sizes, n):
    sizes = chunking.ChunkSizes(*sizes)
    data = random.Random(n).randbytes(n)
    strict, lax = sizes.masks()
    ends, start = [], 0
    while start < n:
        start += n - start if n - start <= sizes.least else chunking._scalar(data, start, n, sizes, strict, lax)
        ends.append(start)
    assert chunking.cut(data, sizes) == ends


@pytest.mark.parametrize("bad", [(0, 1, 2), (8, 8, 9), (1, 4, 9), (8, 16, 16)])
def test_chunk_sizes_are_checked(bad):
    with pytest.raises(ValueError):
        chunking.ChunkSizes(*bad)


@pytest.mark.parametrize("gram", [1, 5, 16, 31])
def test_features_equal_brute_force(gram):
    data = random.Random(gram).randbytes(300)
    out = set()
    for i in range(len(data) - gram + 1):
        h = 0
        for b in data[i : i + gram]:
            h = ((h << 1 | h >> 31) & 0xFFFFFFFF) ^ int(sketches.TABLE[b])
        out.add(int(np_mix32(np.array([h], np.uint32))[0]))
    assert sketches.features(data, sketches.SketchParams(64, gram)).tolist() == sorted(out)[:64]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600), st.lists(st.tuples(st.integers(0, 600), st.binary(max_size=30), st.integers(0, 40)), max_size=5))
def test_delta_round_trip(reference, edits):
    target = bytearray(reference)
    for at, added, gone in edits:
        at %= len(target) + 1
        target[at : at + gone] = added
    d = delta.encode(reference, bytes(target))
    assert delta.apply(reference, d) == bytes(target)
    for end in range(len(d)):
        with pytest.raises(delta.DeltaError):
            delta.apply(reference, d[:end])


def test_delta_of_an_edited_chunk_is_small():
    data = random.Random(1).randbytes(32768)
    moved = data[:1000] + b"inserted" + data[1000:]
    made = delta.chosen(moved, data, delta.CODECS["zlib-9"]())
    assert made["kind"] == "delta" and made["stored_bytes"] < 100
    assert delta.described(delta.encode(data, moved))["copies"] == 2
    assert delta.chosen(data, random.Random(2).randbytes(32768), delta.CODECS["zlib-9"]())["kind"] == "standalone"


@pytest.mark.parametrize("document, typed", [
    (b"", False), (b"null", True), (b'{"a":1}', True), (b'{"a": 1}', False), (b'{"b":1,"1":2}', False), (b'{"1":2,"b":1}', True), (b"[1.50]", False), (b"[1.5,1e+21,1e-7,123456789012345680000]", True),
    (b"-0", False), (b"\xff", False), (b'{"a":1,"a":2}', False), (b"[NaN]", False), (b"[" * 600 + b"]" * 600, False), ('"é"'.encode(), True), (b'"2019-03-01T00:00:00.000Z"', True), (b'"2019-02-30T00:00:00.000Z"', True),
])
def test_container(document, typed):
    codec = delta.CODECS["zlib-9"]()
    made = transcode.encode(document, codec)
    assert transcode.decode(made, codec) == document
    assert made[4] == (transcode.TYPED if typed else transcode.PLAIN)


def test_identifiers():
    key = bytes(range(1, 33))
    assert fn.base58_key(fn.base58_encode(key)) == key and fn.base58_key("0" * 40) is None
    assert fn.cid_digest(fn.cid_of(key)) == key and fn.cid_digest("bafkrei") is None
    assert fn.multibase_bytes(fn.multibase_text(key), 32) == key and fn.multibase_bytes("uA") is None
    assert fn.parse_ms("2019-03-01T00:00:00.001Z") == 1551398400001 and fn.parse_ms("2019-02-30T00:00:00.000Z") is None
    for n in (0, 127, 128, fn.SAFE):
        assert fn.read_varint(fn.varint(n), 0) == (n, len(fn.varint(n)))
    with pytest.raises(ValueError):
        fn.read_varint(b"\x80\x00", 0)


def test_signature_vector():
    secret = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert ed25519.public_key(secret).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    signature = ed25519.sign(secret, b"")
    assert ed25519.verify(ed25519.public_key(secret), b"", signature) and not ed25519.verify(ed25519.public_key(secret), b"x", signature)


def test_bloom_has_no_false_negatives():
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    bloom = Bloom(len(h))
    bloom.add(h)
    assert bloom.contains(h).all() and Bloom.from_bytes(bloom.to_bytes()).contains(h).all()
    assert bloom.contains(np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 5000)).mean() < 0.02

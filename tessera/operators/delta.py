"""Deltas between byte strings: copies from a reference and inserted literals, in a checked binary form.

Matching follows one rule: at each position of the target the reference's windows with the same bucket are
tried in ascending order, at most 64; a match grows forwards, then backwards over literals not yet written; the
longest wins, the lowest reference offset among equals; 20 bytes make a copy.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from tessera.functions.u32 import M1

# Fixed values of the format and of the matching.
MAGIC, VERSION, INSERT, COPY = b"WMOD", 1, 1, 2
WINDOW, LEAST_MATCH, MOST_TRIED = 16, 20, 64
HASH_SEED, HASH_PRIME = 0x811C9DC5, 0x01000193
LEAST_BITS, MOST_BITS = 10, 18
POINTER_BYTES, VARINT_BYTES = 32, 7


class DeltaError(ValueError):
    """A delta that is foreign, cut off, out of bounds or not canonical."""


@dataclass(frozen=True)
class Codec:
    """A named compressor; ratios are comparable within one codec only."""

    name: str
    compress: Callable[[bytes], bytes]
    decompress: Callable[[bytes], bytes]


def _zstd(level: int) -> Codec:
    import zstandard

    return Codec(f"zstd-{level}", lambda b: zstandard.ZstdCompressor(level=level).compress(b), lambda b: zstandard.ZstdDecompressor().decompress(b))


CODECS: dict[str, Callable[[], Codec]] = {
    "identity": lambda: Codec("identity", bytes, bytes),
    "zlib-9": lambda: Codec("zlib-9", lambda b: zlib.compress(b, 9), zlib.decompress),
    "zstd-19": lambda: _zstd(19),
}


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _hashes(data: bytes) -> np.ndarray:
    """The avalanche-mixed hash of every window."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    h = np.full(n, HASH_SEED, np.uint32)
    for i in range(WINDOW):
        h = h * np.uint32(HASH_PRIME) + a[i : i + n]
    h = (h ^ (h >> np.uint32(16))) * np.uint32(M1)
    return h ^ (h >> np.uint32(15))


def batch_hashes(values: list[bytes]) -> list[np.ndarray]:
    """Of every value the hashes of its windows, as of all values in one go."""
    whole, out, at = _hashes(b"".join(values)), [], 0
    for v in values:
        out.append(whole[at : at + max(0, len(v) - WINDOW + 1)])
        at += len(v)
    return out


def _common(a: bytes, i: int, b: bytes, j: int) -> int:
    """Length of the common run from a[i] and b[j]."""
    most, n, step = min(len(a) - i, len(b) - j), 0, 32
    while n < most:
        m = min(step, most - n)
        x, y = a[i + n : i + n + m], b[j + n : j + n + m]
        if x != y:
            d = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
            return n + ((d & -d).bit_length() - 1) // 8
        n += m
        step *= 2
    return n


def encode(reference: bytes, target: bytes, held: np.ndarray | None = None, asked: np.ndarray | None = None) -> bytes:
    """The delta that makes ``target`` from ``reference``; ``held`` and ``asked`` are the hashes of their windows, where known."""
    out = bytearray(MAGIC + bytes([VERSION]) + _number(len(reference)) + _number(len(target)))
    held, asked = _hashes(reference) if held is None else held, _hashes(target) if asked is None else asked
    written = 0
    if len(held):
        bits = min(MOST_BITS, max(LEAST_BITS, (len(held) - 1).bit_length()))
        mask = np.uint32((1 << bits) - 1)
        buckets = held & mask
        order = np.argsort(buckets, kind="stable")
        ranked = buckets[order]
        want = asked & mask
        low, high = np.searchsorted(ranked, want, "left"), np.searchsorted(ranked, want, "right")
        places, low, high = order.tolist(), low.tolist(), np.minimum(high, low + MOST_TRIED).tolist()
        hopeful = np.flatnonzero(np.array(high) > np.array(low)).tolist() if len(low) else []
        at, k = 0, 0
        while k < len(hopeful):
            at = hopeful[k]
            if at < written:
                k += 1
                continue
            best, best_from, best_at = 0, 0, at
            for p in places[low[at] : high[at]]:
                ahead = _common(target, at, reference, p)
                if not ahead:
                    continue
                back = 0
                while at - back > written and p - back > 0 and target[at - back - 1] == reference[p - back - 1]:
                    back += 1
                if ahead + back > best or (ahead + back == best and p - back < best_from):
                    best, best_from, best_at = ahead + back, p - back, at - back
            if best >= LEAST_MATCH:
                if best_at > written:
                    out += bytes([INSERT]) + _number(best_at - written) + target[written:best_at]
                out += bytes([COPY]) + _number(best) + _number(best_from)
                written = best_at + best
            k += 1
    if written < len(target):
        out += bytes([INSERT]) + _number(len(target) - written) + target[written:]
    return bytes(out)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise DeltaError("cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        n = 0
        for k in range(VARINT_BYTES):
            b = self.take(1)[0]
            n |= (b & 127) << (7 * k)
            if not b & 128:
                if k and not b:
                    raise DeltaError("number is not canonical")
                return n
        raise DeltaError("number is too long")


def parsed(delta: bytes) -> tuple[int, int, list[tuple[str, int, int, bytes]]]:
    """(reference length, target length, operations (op, length, reference offset, literal)), all checked."""
    r = _Reader(delta)
    if r.take(4) != MAGIC or r.take(1)[0] != VERSION:
        raise DeltaError("not a delta of this version")
    held, whole, made, out = r.number(), r.number(), 0, []
    while r.at < len(delta):
        op, n = r.take(1)[0], 0
        if op not in (INSERT, COPY):
            raise DeltaError("unknown operation")
        n = r.number()
        start = r.number() if op == COPY else 0
        if not n or start + n * (op == COPY) > held or made + n > whole:
            raise DeltaError("operation out of bounds")
        out.append(("copy", n, start, b"") if op == COPY else ("insert", n, 0, r.take(n)))
        made += n
    if made != whole:
        raise DeltaError("operations do not make the target")
    return held, whole, out


def apply(reference: bytes, delta: bytes) -> bytes:
    """The target of a delta."""
    held, _, ops = parsed(delta)
    if held != len(reference):
        raise DeltaError("another reference length")
    return b"".join(reference[start : start + n] if op == "copy" else literal for op, n, start, literal in ops)


def described(delta: bytes) -> dict[str, int]:
    held, whole, ops = parsed(delta)
    copies = [n for op, n, _, _ in ops if op == "copy"]
    inserts = [n for op, n, _, _ in ops if op == "insert"]
    return {"reference_length": held, "target_length": whole, "copies": len(copies), "inserts": len(inserts), "copied_bytes": sum(copies), "inserted_bytes": sum(inserts), "delta_bytes": len(delta)}


def chosen(target: bytes, reference: bytes | None, codec: Codec, standalone: int | None = None) -> dict:
    """kind, payload and sizes: the compressed delta where it decodes to the target and with its pointer is smaller than the compressed target."""
    alone = codec.compress(target)
    out = {"kind": "standalone", "payload": alone, "stored_bytes": len(alone), "standalone_bytes": len(alone), "delta_bytes": None, "verified": False}
    if reference is not None:
        packed = codec.compress(encode(reference, target))
        try:
            out["verified"] = apply(reference, codec.decompress(packed)) == target
        except (DeltaError, ValueError):
            out["verified"] = False
        out["delta_bytes"] = len(packed) + POINTER_BYTES
        if out["verified"] and out["delta_bytes"] < len(alone):
            out.update(kind="delta", payload=packed, stored_bytes=out["delta_bytes"])
    return out

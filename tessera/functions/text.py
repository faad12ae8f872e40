"""Identifiers, times, numbers and canonical JSON as column expressions; byte codecs as plain functions for Arrow UDFs."""

from __future__ import annotations

import base64
import json
import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alphabets, prefixes and bounds of the identifiers' public formats.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
CID_PREFIX = bytes([1, 0x55, 0x12, 0x20])
SAFE = 2**53 - 1
TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"


def multibase(b: Column) -> Column:
    """'u' and unpadded base64url of a BINARY."""
    return F.concat(F.lit("u"), F.rtrim(F.translate(F.base64(b), "+/", "-_"), F.lit("=")))


def multibase_decoded(s: Column) -> Column:
    """The bytes of a canonical multibase string, else null."""
    body = F.translate(F.substring(s, 2, 1 << 30), "-_", "+/")
    whole = F.when(s.rlike(r"^u[A-Za-z0-9_-]*$") & (F.length(body) % 4 != 1), F.unbase64(F.concat(body, F.repeat(F.lit("="), (4 - F.length(body) % 4) % 4))))
    return F.when(multibase(whole) == s, whole)


def typed_id(prefix: str, b: Column) -> Column:
    """``prefix``:v1: and the multibase SHA-256 of a BINARY."""
    return F.concat(F.lit(f"{prefix}:v1:"), multibase(F.unhex(F.sha2(b, 256))))


def time_ms(s: Column) -> Column:
    """Milliseconds of an exact-millisecond UTC string, null for any other string; dates that do not exist are null."""
    t = F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX"))
    return F.when(s.rlike(TIME), F.unix_millis(t))


def ms_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def integer_text(s: Column) -> Column:
    """The number of a canonical decimal text up to 2**53 - 1, else null."""
    return F.when(s.rlike(r"^(0|[1-9]\d{0,15})$"), F.when(s.try_cast("bigint") <= SAFE, s.try_cast("bigint")))


def varint_length(n: Column) -> Column:
    """Bytes of the LEB128 form of 0 .. 2**53 - 1, else null."""
    out = F.when((n < 0) | (n > SAFE), None)
    for k in range(1, 8):
        out = out.when(n < 1 << (7 * k), k)
    return out.otherwise(8)


def string_class(s: Column) -> Column:
    """Which form the recogniser takes a string for: the first that fits, text otherwise. base58 and cid by shape."""
    composite = r"^[^:]+(:[^:]*)*:(u[A-Za-z0-9_-]{43}|\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z)$"
    return (
        F.when(s.rlike(r"^[1-9A-HJ-NP-Za-km-z]{43,44}$"), "base58")
        .when(multibase_decoded(s).isNotNull() & (F.length(s) > 1), "multibase")
        .when(s.rlike(r"^bafkrei[a-z2-7]{52}$"), "cid")
        .when(time_ms(s) >= 0, "timestamp")
        .when(integer_text(s).isNotNull(), "integer")
        .when(s.rlike(composite), "composite")
        .otherwise("text")
    )


def canonical(value) -> str:
    """JSON with sorted keys and no white space."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def varint(n: int) -> bytes:
    if not 0 <= n <= SAFE:
        raise ValueError("varint out of range")
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data, at: int, most: int = 8) -> tuple[int, int]:
    """(number, next position); only the shortest form, of at most ``most`` bytes, is taken."""
    n = 0
    for k in range(most):
        if at + k >= len(data):
            raise ValueError("varint is cut off")
        b = data[at + k]
        n |= (b & 127) << (7 * k)
        if not b & 128:
            if (k and not b) or n > SAFE:
                raise ValueError("varint is not canonical")
            return n, at + k + 1
    raise ValueError("varint is too long")


def base58_encode(b: bytes) -> str:
    n, out = int.from_bytes(b, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = BASE58[r] + out
    return "1" * (len(b) - len(b.lstrip(b"\0"))) + out


def base58_key(s: str) -> bytes | None:
    """The 32 bytes of a canonical base58 key, else None."""
    if not re.fullmatch(f"[{BASE58}]{{32,44}}", s):
        return None
    n = 0
    for c in s:
        n = n * 58 + BASE58.index(c)
    if n >> 256:
        return None
    b = n.to_bytes(32, "big")
    return b if base58_encode(b) == s else None


def base32_encode(b: bytes) -> str:
    return base64.b32encode(b).decode().rstrip("=").lower()


def base32_decode(s: str) -> bytes | None:
    if not re.fullmatch("[a-z2-7]*", s):
        return None
    try:
        b = base64.b32decode(s.upper() + "=" * (-len(s) % 8))
    except ValueError:
        return None
    return b if base32_encode(b) == s else None


def cid_digest(s: str) -> bytes | None:
    """The SHA-256 digest of a raw CIDv1, else None."""
    b = base32_decode(s[1:]) if s.startswith("b") else None
    return b[4:] if b is not None and len(b) == 36 and b.startswith(CID_PREFIX) else None


def cid_of(digest: bytes) -> str:
    return "b" + base32_encode(CID_PREFIX + digest)


def multibase_bytes(s: str, length: int | None = None) -> bytes | None:
    if not re.fullmatch("u[A-Za-z0-9_-]*", s) or len(s) % 4 == 2:
        return None
    b = base64.urlsafe_b64decode(s[1:] + "=" * (-len(s[1:]) % 4))
    return b if multibase_text(b) == s and (length is None or len(b) == length) else None


def multibase_text(b: bytes) -> str:
    return "u" + base64.urlsafe_b64encode(b).decode().rstrip("=")


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def parse_ms(s: str) -> int | None:
    if not re.fullmatch(TIME, s):
        return None
    try:
        ms = (datetime.strptime(s[:-1] + "+0000", "%Y-%m-%dT%H:%M:%S.%f%z") - _EPOCH) // timedelta(milliseconds=1)
    except ValueError:
        return None
    return ms if ms >= 0 and format_ms(ms) == s else None


def format_ms(ms: int) -> str:
    return (_EPOCH + timedelta(milliseconds=ms)).strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}Z"

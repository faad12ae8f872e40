"""Typed transcoding of JSON documents: known string forms become raw bytes or numbers, other strings a dictionary.

A container holds either the document as it was or its tokens, compressed; the encoder decodes what it made and
keeps the document as it was wherever that differs, so any input comes back byte for byte.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators.delta import CODECS, Codec

# Fixed values of the format: magic, modes, tags and the deepest nesting.
MAGIC, PLAIN, TYPED = b"WMO1", 0, 1
NULL, FALSE, TRUE, UINT, NEGINT, NUMBER, STRING, INTEGER, TIME, BASE58, MULTIBASE, CID, COMPOSITE, ARRAY, OBJECT = range(15)
DEEPEST = 512


class ContainerError(ValueError):
    """A container that is foreign, cut off or not canonical."""


def number_text(x: float) -> str:
    """A double as the shortest text of the JSON number form that scripts print: plain from 1e-6 to below 1e21."""
    if x == 0:
        return "0"
    sign, body = ("-", repr(-x)) if x < 0 else ("", repr(x))
    mantissa, _, e = body.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(e or 0)
    digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    digits = digits.rstrip("0")
    if -6 < point <= 21:
        if point >= len(digits):
            return sign + digits + "0" * (point - len(digits))
        return sign + (digits[:point] + "." + digits[point:] if point > 0 else "0." + "0" * -point + digits)
    power = point - 1
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'+' if power > 0 else '-'}{abs(power)}"


def _object(pairs):
    """Pairs in the order in which scripts list an object's keys: array indices ascending, then as written; a repeated key keeps its first place and last value."""
    found = dict(pairs)
    index = [k for k in found if re.fullmatch(r"0|[1-9]\d*", k) and int(k) < 2**32 - 1]
    return {**{k: found[k] for k in sorted(index, key=int)}, **{k: v for k, v in found.items() if k not in set(index)}}


def _integer(s: str):
    n = int(s)
    return n if abs(n) <= fn.SAFE else float(s)


def _refuse(s: str):
    raise ContainerError(f"{s} is no JSON")


def _stringify(v) -> str:
    if isinstance(v, float):
        return number_text(v)
    if isinstance(v, list):
        return "[" + ",".join(map(_stringify, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + _stringify(x) for k, x in v.items()) + "}"
    return json.dumps(v, ensure_ascii=False)


class _Writer:
    def __init__(self):
        self.out, self.names = bytearray(), {}

    def name(self, s: str) -> int:
        return self.names.setdefault(s, len(self.names))

    def put(self, tag: int, *parts) -> None:
        self.out.append(tag)
        for p in parts:
            self.out += fn.varint(p) if isinstance(p, int) else p

    def text(self, s: str) -> None:
        if (b := fn.base58_key(s)) is not None:
            self.put(BASE58, b)
        elif (b := fn.multibase_bytes(s, 32)) is not None:
            self.put(MULTIBASE, b)
        elif (b := fn.cid_digest(s)) is not None:
            self.put(CID, b)
        elif (ms := fn.parse_ms(s)) is not None:
            self.put(TIME, ms)
        elif re.fullmatch(r"0|[1-9]\d{0,15}", s) and int(s) <= fn.SAFE:
            self.put(INTEGER, int(s))
        elif (split := composite(s)) is not None:
            self.put(COMPOSITE, self.name(split[0]), len(split[1]), *[bytes([tag]) + b for tag, b in split[1]])
        else:
            self.put(STRING, self.name(s))

    def value(self, v, depth: int = 0) -> None:
        if depth > DEEPEST:
            raise ContainerError("nested too deeply")
        if v is None or isinstance(v, bool):
            self.put(NULL if v is None else TRUE if v else FALSE)
        elif isinstance(v, float):
            raw = number_text(v).encode()
            self.put(NUMBER, len(raw), raw)
        elif isinstance(v, int):
            self.put(UINT, v) if v >= 0 else self.put(NEGINT, -v)
        elif isinstance(v, str):
            self.text(v)
        elif isinstance(v, list):
            self.put(ARRAY, len(v))
            for x in v:
                self.value(x, depth + 1)
        else:
            self.put(OBJECT, len(v))
            for k, x in v.items():
                self.text(k)
                self.value(x, depth + 1)


def composite(s: str) -> tuple[str, list[tuple[int, bytes]]] | None:
    """A prefix and the keys and digests that end a colon-separated id; None without any."""
    parts, tail = s.split(":"), []
    while len(parts) > 1:
        if (b := fn.base58_key(parts[-1])) is not None:
            tail.insert(0, (BASE58, b))
        elif (b := fn.multibase_bytes(parts[-1], 32)) is not None:
            tail.insert(0, (MULTIBASE, b))
        else:
            break
        parts.pop()
    return (":".join(parts), tail) if tail else None


class _Tokens:
    def __init__(self, data: bytes):
        self.data, self.at, self.names = data, 0, []

    def number(self) -> int:
        try:
            n, self.at = fn.read_varint(self.data, self.at)
        except ValueError as e:
            raise ContainerError(str(e)) from e
        return n

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ContainerError("cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def string(self, tag: int) -> str:
        if tag == STRING:
            return self.named()
        if tag == INTEGER:
            return str(self.number())
        if tag == TIME:
            return fn.format_ms(self.number())
        if tag in (BASE58, MULTIBASE, CID):
            return {BASE58: fn.base58_encode, MULTIBASE: fn.multibase_text, CID: fn.cid_of}[tag](self.take(32))
        if tag == COMPOSITE:
            prefix, n = self.named(), self.number()
            return ":".join([prefix, *(self.key(self.take(1)[0]) for _ in range(n))])
        raise ContainerError("not a string")

    def key(self, tag: int) -> str:
        if tag not in (BASE58, MULTIBASE):
            raise ContainerError("unknown segment")
        return self.string(tag)

    def named(self) -> str:
        n = self.number()
        if n >= len(self.names):
            raise ContainerError("unknown name")
        return self.names[n]

    def value(self, depth: int = 0):
        if depth > DEEPEST:
            raise ContainerError("nested too deeply")
        tag = self.take(1)[0]
        if tag in (NULL, FALSE, TRUE):
            return {NULL: None, FALSE: False, TRUE: True}[tag]
        if tag == UINT:
            return self.number()
        if tag == NEGINT:
            if not (n := self.number()):
                raise ContainerError("negative zero")
            return -n
        if tag == NUMBER:
            return float(self.take(self.number()))
        if tag == ARRAY:
            return [self.value(depth + 1) for _ in range(self.number())]
        if tag == OBJECT:
            return _object([(self.string(self.take(1)[0]), self.value(depth + 1)) for _ in range(self.number())])
        return self.string(tag)


def decode(container: bytes, codec: Codec) -> bytes:
    """The document of a container."""
    if len(container) < 5 or container[:4] != MAGIC or container[4] not in (PLAIN, TYPED):
        raise ContainerError("not a container")
    outer = _Tokens(container)
    outer.at = 5
    n = outer.number()
    if container[4] == PLAIN:
        if len(container) - outer.at != n:
            raise ContainerError("length differs")
        return container[outer.at :]
    payload = codec.decompress(container[outer.at :])
    if len(payload) != n:
        raise ContainerError("length differs")
    inner = _Tokens(payload)
    for _ in range(inner.number()):
        inner.names.append(inner.take(inner.number()).decode())
    value = inner.value()
    if inner.at != len(payload):
        raise ContainerError("trailing bytes")
    return _stringify(value).encode()


def encode(document: bytes, codec: Codec, plain: bool = False) -> bytes:
    """A container of any document; never fails."""
    kept = MAGIC + bytes([PLAIN]) + fn.varint(len(document)) + document
    if plain:
        return kept
    try:
        value = json.loads(document.decode(), object_pairs_hook=_object, parse_int=_integer, parse_constant=_refuse)
        w = _Writer()
        w.value(value)
        names = b"".join(fn.varint(len(raw)) + raw for raw in (s.encode() for s in w.names))
        payload = fn.varint(len(w.names)) + names + bytes(w.out)
        out = MAGIC + bytes([TYPED]) + fn.varint(len(payload)) + codec.compress(payload)
        return out if decode(out, codec) == document else kept
    except (ValueError, RecursionError, OverflowError):
        return kept


def mode(container: Column) -> Column:
    """'plain', 'typed', or null for what is no container."""
    head = F.hex(F.substring(container, 1, 5))
    return F.when(head == (MAGIC + bytes([PLAIN])).hex().upper(), "plain").when(head == (MAGIC + bytes([TYPED])).hex().upper(), "typed")


def transcoded(df: DataFrame, document_col: str, codec: str = "zlib-9", back: bool = False) -> DataFrame:
    """``df`` with the BINARY column ``document_col`` encoded, or decoded with ``back``; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = CODECS[codec]()
        f = decode if back else encode
        for batch in batches:
            out = pa.array([None if b is None else f(b, c) for b in batch.column(document_col).to_pylist()], pa.binary())
            yield batch.set_column(batch.schema.get_field_index(document_col), document_col, out)

    return df.mapInArrow(run, df.schema)

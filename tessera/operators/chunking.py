"""Content-defined and fixed-size chunks of binary values.

The rolling fingerprint at a byte depends on the 32 bytes ending there, so all fingerprints of a value come from
five doubling steps, and cutting is a search in the sorted positions where a mask is zero.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.u32 import words

# The table's seed and by how many bits the two masks differ from the average's.
GEAR_SEED, LEVEL = 0x574B4E54, 2
GEAR = words(GEAR_SEED, 256)
_CHUNK = "array<struct<ord:int,offset:bigint,length:int,bytes:binary>>"


@dataclass(frozen=True)
class ChunkSizes:
    """Smallest, average and largest chunk, in bytes."""

    least: int = 8192
    average: int = 32768
    most: int = 131072

    def __post_init__(self):
        if not all(isinstance(x, int) and x > 0 for x in (self.least, self.average, self.most)):
            raise ValueError("chunk sizes must be positive integers")
        if not self.least < self.average < self.most or not 8 <= self.average <= 1 << 30:
            raise ValueError("chunk sizes must ascend, the average within 8 and 2**30")

    def masks(self) -> tuple[int, int]:
        bits = round(float(np.log2(self.average)))

        def top(n: int) -> int:
            n = max(1, min(32, n))
            return (0xFFFFFFFF << (32 - n)) & 0xFFFFFFFF

        return top(bits + LEVEL), top(bits - LEVEL)


def fingerprints(data: np.ndarray) -> np.ndarray:
    """Of every position the fingerprint of the (up to) 32 bytes ending there."""
    f = GEAR[data].copy()
    for k in (1, 2, 4, 8, 16):
        if len(f) > k:
            f[k:] += f[:-k] << np.uint32(k)  # the right side is evaluated first
    return f


def _scalar(data: bytes, start: int, end: int, sizes: ChunkSizes, strict: int, lax: int) -> int:
    """A chunk's length where the fingerprint depends on where the chunk starts (least size under 33)."""
    room, first, fp = min(sizes.most, end - start), sizes.least - 1, 0
    for i in range(max(0, first - 32), room):
        fp = ((fp << 1) + int(GEAR[data[start + i]])) & 0xFFFFFFFF
        if i >= first and not fp & (strict if i < sizes.average else lax):
            return i + 1
    return room


def cut(data: bytes, sizes: ChunkSizes) -> list[int]:
    """End positions of the chunks; empty for no bytes."""
    n, ends, start = len(data), [], 0
    strict, lax = sizes.masks()
    if sizes.least >= 33:
        f = fingerprints(np.frombuffer(data, np.uint8))
        at_strict, at_lax = np.flatnonzero(f & np.uint32(strict) == 0).tolist(), np.flatnonzero(f & np.uint32(lax) == 0).tolist()
    while start < n:
        if n - start <= sizes.least:
            length = n - start
        elif sizes.least < 33:
            length = _scalar(data, start, n, sizes, strict, lax)
        else:
            room = min(sizes.most, n - start)
            middle = min(sizes.average, room)
            i = bisect.bisect_left(at_strict, start + sizes.least - 1)
            if i < len(at_strict) and at_strict[i] < start + middle:
                length = at_strict[i] - start + 1
            else:
                i = bisect.bisect_left(at_lax, start + middle)
                length = at_lax[i] - start + 1 if i < len(at_lax) and at_lax[i] < start + room else room
        start += length
        ends.append(start)
    return ends


def _exploded(df: DataFrame, content_col: str, ends_of) -> DataFrame:
    kept = [c for c in df.columns if c != content_col]
    clash = {"ord", "offset", "length", "bytes", "digest"} & set(kept)
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}, which the chunks need")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(content_col).to_pylist():
                begin, out = 0, []
                for i, end in enumerate(ends_of(value) if value else ()):
                    out.append({"ord": i, "offset": begin, "length": end - begin, "bytes": value[begin:end]})
                    begin = end
                rows.append(out)
            kind = pa.list_(pa.struct([("ord", pa.int32()), ("offset", pa.int64()), ("length", pa.int32()), ("bytes", pa.binary())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(rows, kind)], names=[*kept, "_chunks"])

    types = dict(df.dtypes)
    out = df.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"_chunks {_CHUNK}"]))
    return out.select(*kept, F.explode("_chunks").alias("_c")).select(*kept, "_c.*").withColumn("digest", F.sha2("bytes", 256))


def content_chunks(df: DataFrame, content_col: str, sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """One row per content-defined chunk: the other columns of ``df``, ord, offset, length, bytes, digest.

    A null or empty value has no chunks.
    """
    return _exploded(df, content_col, lambda value: cut(value, sizes))


def fixed_chunks(df: DataFrame, content_col: str, size: int) -> DataFrame:
    """One row per chunk of ``size`` bytes (the last may be shorter), built-in functions only."""
    if size < 1:
        raise ValueError("size must be at least 1")
    kept = [c for c in df.columns if c != content_col]
    n = F.octet_length(content_col)
    spots = df.filter(n > 0).select(*kept, F.col(content_col).alias("_value"), F.posexplode(F.sequence(F.lit(0), F.expr(f"(octet_length(`{content_col}`) - 1) div {int(size)}").cast("int"))).alias("ord", "_i"))
    part = spots.select(*kept, "ord", (F.col("_i").cast("long") * size).alias("offset"), F.substring(F.col("_value"), F.col("_i") * size + 1, F.lit(size)).alias("bytes"))
    return part.select(*kept, "ord", "offset", F.octet_length("bytes").alias("length"), "bytes", F.sha2("bytes", 256).alias("digest"))

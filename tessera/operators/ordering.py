"""Total positions and digests over ordered rows, without one task that holds them all."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize, tasks_for


def numbered(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """``df`` with its position, from 1, in the order of the columns, which must tell all rows apart.

    Range partitions are numbered in their tasks and shifted by the rows before them: one count per partition is all that meets.
    """
    spark = df.sparkSession
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", _part bigint, _nth bigint"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            nth = np.arange(seen + 1, seen + 1 + batch.num_rows)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part)), pa.array(nth)], names=[*batch.schema.names, "_part", "_nth"])

    rows = df.repartitionByRange(tasks_for(spark, df.count()), *order).sortWithinPartitions(*order).mapInArrow(number, schema)
    rows = materialize(rows, "numbered")
    counts = sorted((r[0], r[1]) for r in rows.groupBy("_part").count().collect())  # a row per partition
    before, shift = {}, 0
    for part, n in counts:
        before[part] = shift
        shift += n
    offsets = spark.createDataFrame([(int(p), int(s)) for p, s in before.items()], "_part long, _before long")
    return rows.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_before") + F.col("_nth")).alias(name))


def list_digests(df: DataFrame, group: str, order: Sequence[str], piece: str) -> DataFrame:
    """(group, n, digest): of each group the multibase SHA-256 of the JSON list of its pieces (JSON texts), in order.

    The hash runs over the sorted rows as they stream by, so a group of any size needs no memory; the order it is defined on makes
    one group one task.
    """
    rows = df.select(F.col(group).cast("string").alias("_g"), *order, F.col(piece).alias("_piece")).repartition("_g").sortWithinPartitions("_g", *order).select("_g", "_piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, state, n = object(), None, 0

        def close() -> None:
            if state is not None:
                state.update(b"]")
                out.append((now, n, "u" + base64.urlsafe_b64encode(state.digest()).rstrip(b"=").decode()))

        for batch in batches:
            for g, p in zip(batch.column("_g").to_pylist(), batch.column("_piece").to_pylist()):
                if g != now or state is None:
                    close()
                    now, state, n = g, hashlib.sha256(b"["), 0
                elif n:
                    state.update(b",")
                state.update(p.encode())
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=[group, "n", "digest"])

    return rows.mapInArrow(run, f"`{group}` string, n bigint, digest string")

"""Keeping one copy of messages that are delivered at least once.

Identifiers are hashed to partitions. A partition keeps, per time bucket, the identifiers that arrived in it
and a Bloom filter over them. Each bucket's identifiers are screened against the filters of the buckets before
it: those in none are new for certain, the others are looked up exactly, and only in the stored buckets whose
filter matched.

Skew: repeats within an Arrow batch are settled before the shuffle and travel without their identifier to a
partition of their own number, so one identifier holding a third of all rows reaches its partition as one row
a batch.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.bloom import Bloom
from tessera.session import discard, materialize, point_at, pointed_at, scratch_path, tasks_for

_ROWS = "route long, h long, id string, arrival long, bucket long"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch, the first arrival of every identifier; the others lose their identifier and are spread."""
    for batch in batches:
        if not batch.num_rows:
            continue
        h, arrival = batch.column("h").to_numpy(), batch.column("arrival").to_numpy()
        ids = batch.column("id").dictionary_encode().indices.to_numpy()
        order = np.lexsort((arrival, ids))
        first = np.zeros(len(ids), bool)
        first[order] = np.append(True, np.diff(ids[order]) != 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(first, h, arrival)), pa.array(h), pc.if_else(pa.array(first), batch.column("id"), pa.scalar(None, pa.string())), pa.array(arrival), batch.column("bucket")],
            names=["route", "h", "id", "arrival", "bucket"],
        )


def _repeats(arrival: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([arrival, pa.nulls(len(arrival), pa.string()), pa.nulls(len(arrival), pa.int64())], names=["arrival", "id", "bucket"])


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition: the arrivals that repeat an identifier, without it, and the first of every identifier."""
    stored: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        known = pc.is_valid(batch.column("id"))
        if repeats := pc.sum(pc.invert(known)).as_py():
            yield _repeats(batch.filter(pc.invert(known)).column("arrival"))
        if repeats == batch.num_rows:
            continue
        batch = batch.filter(known)
        buckets = batch.column("bucket").to_numpy()
        for b in np.unique(buckets):
            stored.setdefault(int(b), []).append(batch.filter(pa.array(buckets == b)))
    filters: dict[int, Bloom] = {}
    shelves: dict[int, tuple[pa.Array, np.ndarray]] = {}
    for b in sorted(stored):
        rows = pa.Table.from_batches(stored.pop(b)).combine_chunks()
        ids, h, arrival = rows.column("id").combine_chunks(), rows.column("h").to_numpy(), rows.column("arrival").to_numpy()
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.chunk(0)
        codes = ids.dictionary_encode()
        order = np.lexsort((arrival, codes.indices.to_numpy()))
        ranked = codes.indices.to_numpy()[order]
        first = np.append(True, ranked[1:] != ranked[:-1])
        if not first.all():
            yield _repeats(pa.array(arrival[order[~first]]))
        keep = np.sort(order[first])
        ids, h, arrival = ids.take(pa.array(keep)), h[keep], arrival[keep].copy()
        fresh = np.ones(len(h), bool)
        for earlier, bloom in filters.items():
            maybe = np.flatnonzero(fresh & bloom.contains(h))
            if not len(maybe):
                continue
            shelf_ids, shelf_arrival = shelves[earlier]
            at = pc.index_in(ids.take(pa.array(maybe)), value_set=shelf_ids)
            hit = pc.is_valid(at).to_numpy(zero_copy_only=False)
            if not hit.any():
                continue
            mine, theirs = maybe[hit], at.filter(pa.array(hit)).to_numpy()
            later = np.maximum(arrival[mine], shelf_arrival[theirs])
            shelf_arrival[theirs] = np.minimum(arrival[mine], shelf_arrival[theirs])
            fresh[mine] = False
            yield _repeats(pa.array(later))
        left = np.flatnonzero(fresh)
        bloom = Bloom(len(left))
        bloom.add(h[left])
        filters[b], shelves[b] = bloom, (ids.take(pa.array(left)), arrival[left])
    for b, (ids, arrival) in shelves.items():
        yield pa.RecordBatch.from_arrays([pa.array(arrival), ids, pa.array(np.full(len(ids), b))], names=["arrival", "id", "bucket"])


def _filter_of(table: pa.Table) -> pa.Table:
    """The filter of one partition's identifiers of one time bucket."""
    h = table.column("h").to_numpy()
    bloom = Bloom(len(h))
    bloom.add(h)
    return pa.table({"part": table.column("part").slice(0, 1), "bucket": table.column("bucket").slice(0, 1), "bits": pa.array([bloom.to_bytes()])})


def _against(new: pa.Table, filters: pa.Table) -> pa.Table:
    """(id, arrival, held): identifiers that a stored time bucket may have; all others are new for certain."""
    h, out = new.column("h").to_numpy(), []
    for held, raw in zip(filters.column("bucket").to_pylist(), filters.column("bits")):
        maybe = np.flatnonzero(Bloom.from_bytes(raw.as_py()).contains(h)) if len(h) else []
        if len(maybe):
            at = pa.array(maybe)
            out.append(pa.table({"id": new.column("id").take(at), "arrival": new.column("arrival").take(at), "held": pa.array(np.full(len(maybe), held))}))
    return pa.concat_tables(out) if out else pa.table({"id": pa.array([], pa.string()), "arrival": pa.array([], pa.int64()), "held": pa.array([], pa.int64())})


class Arrivals:
    """A persistent store of the identifiers that arrived, in a shared folder: one part per time bucket, with its filters.

    A load is settled within itself, screened against the stored filters, and verified against the identifiers of those time
    buckets only whose filter matched; then it adds a segment, which one rename makes current. History is neither reread nor
    shuffled but for the matching buckets.
    """

    def __init__(self, spark: SparkSession, store_dir: str, batches_per_bucket: int = 30, rows_per_part: int = 500_000):
        self.spark, self.dir, self.per_bucket, self.per_part = spark, store_dir, batches_per_bucket, rows_per_part
        lines = (pointed_at(spark, store_dir) or "").split()
        self.parts, self.segments = (int(lines[0]), lines[1:]) if lines else (0, [])

    def _stored(self, name: str) -> DataFrame:
        """The segments' tables; those of identifiers are stored by time bucket, so a filter on it reads those folders only."""
        frames = [self.spark.read.schema(_STORED[name]).parquet(f"{self.dir}/{s}/{name}") for s in self.segments]
        return functools.reduce(DataFrame.unionByName, frames)

    def add(self, df: DataFrame, id_col: str, arrival_col: str, batch_col: str) -> DataFrame:
        """(arrival): what this load shows to be repeats: all but the smallest arrival of each identifier, in it and in the store.

        An arrival that the store kept is named too, once an earlier one of its identifier comes in. See repeated_arrivals for the columns.
        """
        spark = self.spark
        rows = df.count()
        self.parts = self.parts or tasks_for(spark, rows, self.per_part)
        told = materialize(_settled(df, id_col, arrival_col, batch_col, self.per_bucket, tasks_for(spark, rows)), "arrivals")
        out = told.filter("id is null").select("arrival")
        fresh = told.filter("id is not null").withColumn("h", F.xxhash64("id")).withColumn("part", F.pmod(F.col("h"), F.lit(self.parts)))
        if self.segments:
            maybe = fresh.groupBy("part").cogroup(self._stored("filters").groupBy("part")).applyInArrow(_against, "id string, arrival long, held long")
            maybe = materialize(maybe, "maybe")
            hit = [r[0] for r in maybe.select("held").distinct().collect()]  # as many as there are time buckets, at most
            known = self._stored("ids").filter(F.col("bucket").isin(hit)).select("id", F.col("arrival").alias("before"))
            met = materialize(maybe.select("id", "arrival").distinct().join(known, "id").groupBy("id").agg(F.min("arrival").alias("arrival"), F.min("before").alias("before")), "met")
            discard(maybe)
            out = out.unionByName(met.select(F.greatest("arrival", "before").alias("arrival")))
            fresh = fresh.join(met.filter("arrival > before").select("id"), "id", "left_anti")
        segment = f"s{len(self.segments):06d}-{uuid.uuid4().hex}"
        kept = fresh.select("id", "arrival", "h", "part", "bucket")
        kept.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.dir}/{segment}/ids")
        kept.groupBy("part", "bucket").applyInArrow(_filter_of, _STORED["filters"]).write.parquet(f"{self.dir}/{segment}/filters")
        self.segments = [*self.segments, segment]
        point_at(spark, self.dir, " ".join([str(self.parts), *self.segments]))
        return out


_STORED = {"ids": "id string, arrival long, h long, part long, bucket long", "filters": "part long, bucket long, bits binary"}


def _settled(df: DataFrame, id_col: str, arrival_col: str, batch_col: str, per_bucket: int, tasks: int) -> DataFrame:
    """(arrival, id, bucket): repeats within ``df`` with a null id, and the first arrival of every identifier."""
    slim = df.select(F.xxhash64(id_col).alias("h"), F.col(id_col).cast("string").alias("id"), F.col(arrival_col).cast("long").alias("arrival"), F.coalesce(F.floor(F.col(batch_col) / per_bucket), F.lit(-1)).cast("long").alias("bucket")).filter("id is not null and arrival is not null")
    return slim.mapInArrow(_settle, _ROWS).repartition(tasks, "route").mapInArrow(_screen, "arrival long, id string, bucket long")


def repeated_arrivals(df: DataFrame, id_col: str, arrival_col: str, batch_col: str, batches_per_bucket: int = 30, store_dir: str | None = None, loads: int = 2) -> DataFrame:
    """(arrival): the arrivals to remove, all but the smallest ``arrival_col`` of each ``id_col``.

    ``arrival_col`` is a unique BIGINT in order of arrival; ``batch_col`` a BIGINT that counts up with arrival
    and gives the time bucket (null: a bucket before all others). Rows with a null identifier are no repeats.
    Of the other columns none is read. The rows come in as ``loads`` loads of consecutive batches into a store
    (``store_dir``, else a new one). A partition's identifiers are held in its task: their number is bounded
    through the number of partitions. An empty table gives no rows.
    """
    spark = df.sparkSession
    store = Arrivals(spark, store_dir or scratch_path(spark, "arrivals"), batches_per_bucket)
    last = df.agg(F.max(batch_col)).first()[0] or 0
    step, out = max(1, -(-(int(last) + 1) // loads)), []
    load = F.coalesce(F.floor(F.greatest(F.col(batch_col), F.lit(0)) / step), F.lit(0))
    for n in range(loads):
        out.append(store.add(df.filter(load == n), id_col, arrival_col, batch_col))
    return functools.reduce(DataFrame.unionByName, out)

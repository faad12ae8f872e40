"""Session defaults, scratch tables in the shared folder, and atomic publication of a table version."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this package expects; all are runtime SQL settings.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",  # shuffle files go when their execution ends
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": str(4 << 20),  # a filter of at most 8 MB before a large side is shuffled
}


def prepare(spark: SparkSession) -> SparkSession:
    """Sets the SQL settings above on a session; settings for sizes stay the cluster's."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    # Python workers find this package where the driver has it; where no such folder exists this changes nothing.
    home, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [home, env.get("PYTHONPATH", "")]))
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir`` of the session.

    Where that is unset a local master gets a temporary folder of its own; on a cluster that is refused,
    as executors could not share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", base)
    spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path  # for discard()
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables written by materialize() that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "scratch", None):
            fs, p = _fs(df.sparkSession, path)
            fs.delete(p, True)


def tasks_for(spark: SparkSession, rows: int, per_task: int = 500_000) -> int:
    """Partitions for ``rows``: the session's number, more when a task would get over ``per_task``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_task), 1)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def point_at(spark: SparkSession, table_dir: str, version: str) -> None:
    """Makes ``version`` the current one of ``table_dir`` by one rename over the pointer file."""
    fs, pointer = _fs(spark, f"{table_dir}/CURRENT")
    _, staged = _fs(spark, f"{table_dir}/.CURRENT-{uuid.uuid4().hex}")
    stream = fs.create(staged, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(pointer.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(staged, pointer, options)


def pointed_at(spark: SparkSession, table_dir: str) -> str | None:
    """The current version's name, None before the first."""
    return _read_text(spark, f"{table_dir}/CURRENT")


def publish(df: DataFrame, table_dir: str, keep: int = 2) -> DataFrame:
    """Writes a new version of a table, then makes it current by one rename.

    Readers see the old version or the new one, never a mixture; a job that dies before the rename leaves
    the old one current. The ``keep`` newest versions stay for readers that began earlier.
    """
    spark = df.sparkSession
    now = pointed_at(spark, table_dir)
    number = int(now.split("-")[0]) + 1 if now else 1
    version = f"{number}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{table_dir}/v/{version}")
    point_at(spark, table_dir, version)
    fs, versions = _fs(spark, f"{table_dir}/v")
    for old in fs.listStatus(versions):
        if int(old.getPath().getName().split("-")[0]) <= number - keep:
            fs.delete(old.getPath(), True)
    return spark.read.schema(df.schema).parquet(f"{table_dir}/v/{version}")


def published(spark: SparkSession, table_dir: str) -> DataFrame | None:
    """The current version of a published table, None before the first."""
    version = pointed_at(spark, table_dir)
    return spark.read.parquet(f"{table_dir}/v/{version}") if version else None

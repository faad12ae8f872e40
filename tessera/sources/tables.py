"""Reading blobs, and sealing a set of rows as one encrypted snapshot per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import multibase


def blobs_from_files(spark: SparkSession, path: str) -> DataFrame:
    """(blob_id, seq, content) of all files under a path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.col("path").alias("blob_id"), F.xxhash64("path").alias("seq"), "content")


def blobs_from_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(blob_id, seq, content) of a text column; null texts are left out."""
    return df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("blob_id"), F.col(id_col).cast("long").alias("seq"), F.encode(text_col, "UTF-8").alias("content"))


def sealed(df: DataFrame, group: str, order: str, body: Column, key: Column, iv: Column) -> DataFrame:
    """(group, rows, sealed, sealed_hash): each group's bodies in order as one AES-GCM snapshot bound to its group.

    A snapshot is one value by nature; groups are the sets that a snapshot may hold. The initial vector goes
    before cipher text and tag.
    """
    rows = df.groupBy(group).agg(F.count("*").alias("rows"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), body.alias("b")))), lambda x: x["b"]), "\n").alias("plain"))
    out = rows.withColumn("sealed", F.aes_encrypt(F.encode("plain", "UTF-8"), key, F.lit("GCM"), F.lit("DEFAULT"), iv, F.encode(F.col(group).cast("string"), "UTF-8")))
    return out.select(group, "rows", "sealed", multibase(F.unhex(F.sha2("sealed", 256))).alias("sealed_hash"))


def opened(df: DataFrame, group: str, key: Column) -> DataFrame:
    """(group, body): the rows of snapshots whose hash fits and that the key opens; others give none."""
    good = df.filter(multibase(F.unhex(F.sha2("sealed", 256))) == F.col("sealed_hash"))
    plain = F.decode(F.try_aes_decrypt(F.col("sealed"), key, F.lit("GCM"), F.lit("DEFAULT"), F.encode(F.col(group).cast("string"), "UTF-8")), "UTF-8")
    return good.select(group, F.explode(F.split(plain, "\n")).alias("body"))

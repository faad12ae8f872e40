"""Scores of compression, and the schedule by which assets are used again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import numbered

#: Fixed value: assets at most.
ASSETS = 16
#: From this number on the schedule is periodic, as ceil(sqrt(n + 1)) has reached ASSETS.
_EVEN = (ASSETS - 1) ** 2


def ratio(raw: Column, stored: Column) -> Column:
    """Bytes before over bytes after, 1 where nothing is stored."""
    return F.when(stored > 0, raw / stored).otherwise(F.lit(1.0))


def score(ratio: Column, seconds: Column, base_ratio: Column, base_seconds: Column, weight: float = 1.0) -> Column:
    """The Weissman score: the ratio against a standard compressor's, times the logarithms of their times in milliseconds; null for times of at most 1 ms."""
    t, base = seconds * 1000, base_seconds * 1000
    return F.when((t > 1) & (base > 1), F.lit(weight) * (ratio / base_ratio) * (F.ln(base) / F.ln(t)))


def throughput(raw: Column, seconds: Column) -> Column:
    """Bytes before compression per second, null for no time."""
    return F.when(seconds > 0, raw / seconds)


def reuse_schedule(works: DataFrame, key: str) -> DataFrame:
    """(key, n, asset, item): works in order of ``key``, n from 0, take asset n mod min(16, ceil(sqrt(n + 1))), each asset's items counted from 0.

    Up to the 225th work the counts are a table; after it every 16th work has the same asset, so items follow from n alone.
    """
    early, used = [], [0] * ASSETS
    for n in range(_EVEN):
        limit = next(k for k in range(1, ASSETS + 1) if k * k >= n + 1)
        early.append((n, n % limit, used[n % limit]))
        used[n % limit] += 1
    table = works.sparkSession.createDataFrame(early, "n long, asset0 long, item0 long")
    rows = numbered(works.select(key).filter(F.col(key).isNotNull()), [F.col(key)]).select(key, (F.col("pos") - 1).alias("n")).join(F.broadcast(table), "n", "left")
    asset = F.coalesce("asset0", F.col("n") % ASSETS)
    before = F.element_at(F.array(*[F.lit(u) for u in used]), (asset + 1).cast("int"))
    later = before + F.floor((F.col("n") - 1 - asset) / ASSETS) - F.floor((F.lit(_EVEN - 1) - asset) / ASSETS)
    return rows.select(key, "n", asset.alias("asset"), F.coalesce("item0", later).cast("long").alias("item"))

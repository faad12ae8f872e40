"""Limiting how many records a contributor may have, by radix selection.

Quality and identifier become one byte string whose order is the order of preference. Of each contributor over
its limit the cutoff is found digit by digit, two bytes at a time: count the records per contributor and digit, find
the digit at which the limit falls, keep only the records with that digit, go on behind what they have in common.
Once no contributor has more than ``_FEW`` records left, these are ranked. Records are then kept by comparing with
the cutoff. Counts are partial sums, 65,537 values a contributor at most, so a contributor with a third of all
records costs no more than another; no more than ``_FEW`` records of one are ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import discard, materialize


#: Records of a contributor that are ranked when no one has more.
_FEW = 4_096


def _differ(a: Column, b: Column) -> Column:
    """The first place, from 1, at which two different byte strings differ."""
    least = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), least), lambda i: a.substr(i, F.lit(1)) == b.substr(i, F.lit(1)))
    at = F.when(least > 0, F.array_position(same, False).cast("int")).otherwise(0)
    return F.when(at > 0, at).otherwise(least + 1)


def preference_key(score: Column, identifier: Column) -> Column:
    """Bytes that sort by score, highest first and null last, then by identifier, bytewise.

    ``score`` is an INT, ``identifier`` a STRING; a null identifier sorts as an empty one.
    """
    place = F.when(score.isNull(), F.lit(0xFFFFFFFF)).otherwise(F.lit(0x7FFFFFFF) - score.cast("long"))
    return F.concat(F.unhex(F.lpad(F.hex(place.cast("long")), 8, "0")), F.encode(F.coalesce(identifier, F.lit("")), "UTF-8"))


def over_limit(df: DataFrame, group: Column, key: Column, most: int | None = None, share: float | None = None) -> DataFrame:
    """The rows of ``df`` to drop: of each group all but the first ``most`` by ``key``.

    With ``share`` instead, a group keeps at most that share of all rows, and at least one. ``key`` is BINARY,
    ascending by preference; rows of equal key in a group are kept or dropped together (never more than the
    limit is kept unless they are all of equal key). Rows whose group is null are never dropped. The columns of
    ``df`` may have any names and come back as they were. An empty table gives no rows.
    """
    if (most is None) == (share is None) or (most is not None and most < 1):
        raise ValueError("give most, at least 1, or share")
    rows = materialize(df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), group.cast("string").alias("g"), key.alias("key")).filter("g is not null"), "capping")
    keys = rows.select("g", "key")
    limit = F.lit(most).cast("long") if most else F.lit(max(1, int(share * df.count()))).cast("long")
    open_groups = keys.groupBy("g").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).filter(F.col("n") > limit)
    open_groups = materialize(open_groups.select("g", limit.alias("need"), "lo", "hi"), "cutoffs")
    done, active, owned = open_groups.filter("lo = hi").select("g", F.col("hi").alias("cut")), keys, []
    open_groups = open_groups.filter("lo < hi")
    while not open_groups.isEmpty():
        reached = active.join(open_groups.select("g", _differ(F.col("lo"), F.col("hi")).alias("at"), "need"), "g")
        counts = reached.groupBy("g", "need", "at", F.expr("substring(key, at, 2)").alias("digit")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        here = counts.withColumn("upto", F.expr("sum(n) over (partition by g order by digit)")).filter("upto >= need and upto - n < need")
        now = materialize(here.select("g", (F.col("need") - (F.col("upto") - F.col("n"))).alias("need"), "n", "lo", "hi", "at", "digit"), "cutoffs")
        owned.append(now)
        ended = (F.col("n") == F.col("need")) | (F.col("lo") == F.col("hi"))
        done = done.unionByName(now.filter(ended).select("g", F.col("hi").alias("cut")))
        open_groups = now.filter(~ended)
        largest = open_groups.agg(F.max("n")).first()[0]
        if largest is None:
            break
        narrowed = reached.select("g", "key").join(open_groups.select("g", "at", "digit", "need"), "g").filter("substring(key, at, 2) = digit").select("g", "key", "need")
        if largest <= _FEW:
            nth = F.row_number().over(Window.partitionBy("g").orderBy("key"))
            done = done.unionByName(narrowed.withColumn("nth", nth).filter("nth = need").select("g", F.col("key").alias("cut")))
            break
        active = materialize(narrowed.select("g", "key"), "capping")
        owned.append(active)
    cut = materialize(done, "cut")
    discard(*owned)
    return rows.join(cut, "g").filter(F.col("key") > F.col("cut")).select("row.*")

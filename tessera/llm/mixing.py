"""Drawing from several sources so that each contributes its share of the total size.

Per source only the counts of records by exact length are planned. Whole passes over the source come first;
of the rest a proportional part of each length is taken, and what remains of the budget is met by a bounded
knapsack over the lengths left, exactly whenever some choice of records does. Records are then chosen by their
rank within source and length in a seeded order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import ranked
from tessera.session import tasks_for

#: The knapsack is solved over budgets up to this; the proportional and largest-first steps leave no more.
_WINDOW = 1 << 16


def knapsack(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each length so that their sum is the largest not above ``budget``; exact, by bit sets of reachable sums."""
    reach, trail = 1, []
    mask = (1 << (budget + 1)) - 1
    for length in sorted(counts, reverse=True):
        most, chunk = min(counts[length], budget // length), 1
        while most > 0:
            n = min(chunk, most)
            trail.append((length, n, reach))
            reach = (reach | reach << (n * length)) & mask
            most -= n
            chunk *= 2
        if reach >> budget & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, n, before in reversed(trail):
        if not before >> at & 1:
            at -= n * length
            out[length] = out.get(length, 0) + n
    return out


def fit(counts: dict[int, int], budget: int, max_uses: int) -> tuple[int, dict[int, int]]:
    """(passes, extra): use every record ``passes`` times, and ``extra[length]`` records of a length once more."""
    total = sum(n * c for n, c in counts.items())
    if not total or budget <= 0:
        return 0, {}
    passes = min(max_uses, budget // total)
    rest = budget - passes * total
    if passes == max_uses or not rest:
        return passes, {}
    extra = {n: c * rest // total for n, c in counts.items()}
    rest -= sum(n * k for n, k in extra.items())
    for n in sorted(counts, reverse=True):
        if rest <= _WINDOW:
            break
        k = min(counts[n] - extra[n], (rest - _WINDOW) // n + 1, rest // n)
        extra[n] += k
        rest -= k * n
    for n, k in knapsack({n: c - extra[n] for n, c in counts.items() if n <= rest and c > extra[n]}, min(rest, 2 * _WINDOW)).items():
        extra[n] += k
    return passes, {n: k for n, k in extra.items() if k}


def largest_total(sizes: dict[str, int], targets: dict[str, tuple[float, int]]) -> int:
    """The largest total at which every source that has records can still give its share."""
    return int(min((sizes[s] * uses / share for s, (share, uses) in targets.items() if sizes.get(s) and share > 0), default=0))


def mixed(lengths: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7) -> DataFrame:
    """(source_name, id, n_tokens, uses) of the records drawn.

    ``lengths``: id, source, n_tokens; ``targets``: source_name, target_share, max_repeats (a few rows).
    ``total``: size to draw, by default the largest at which all sources that occur can give their share. A
    source without records gives nothing, and the shares of the others keep their ratio. A source too small
    for its share gives all it may. Records of no target source, with a null source or of 0 tokens are not
    drawn.
    """
    spark = lengths.sparkSession
    goal = {r.source_name: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.collect() if r.source_name is not None}
    usable = lengths.filter("n_tokens > 0 and source is not null").join(targets.select(F.col("source_name").alias("source")), "source", "left_semi")
    order = F.xxhash64(F.lit(seed), F.col("id"))
    keyed = usable.withColumn("_class", F.concat(F.col("n_tokens").cast("string"), F.lit(":"), F.col("source")))
    items = ranked(keyed.repartition(tasks_for(spark, lengths.count()), order).sortWithinPartitions(order), "_class", "mixing")
    counts: dict[str, dict[int, int]] = {}
    for r in items.groupBy("source", "n_tokens").agg(F.count("*").alias("n")).collect():  # a row per source and length
        counts.setdefault(r.source, {})[int(r.n_tokens)] = int(r.n)
    sizes = {s: sum(n * c for n, c in by.items()) for s, by in counts.items()}
    size = largest_total(sizes, goal) if total is None else total
    chosen = []
    for s, by in counts.items():
        share, most = goal[s]
        passes, extra = fit(by, round(size * share), most)
        chosen += [(s, n, passes, extra.get(n, 0)) for n in by]
    uses = spark.createDataFrame(chosen, "source string, n_tokens long, passes long, extra long")
    drawn = items.join(uses, ["source", "n_tokens"]).withColumn("uses", F.col("passes") + F.when(F.col("rank") < F.col("extra"), 1).otherwise(0))
    return drawn.filter("uses > 0").select(F.col("source").alias("source_name"), "id", "n_tokens", "uses")


def report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source_name, target_share, reached_share, tokens, documents, most_uses) for every target source."""
    by = drawn.groupBy("source_name").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    whole = by.agg(F.sum("tokens").alias("_all"))
    kept = targets.select("source_name", "target_share").join(by, "source_name", "left").join(F.broadcast(whole))
    zero = F.lit(0).cast("long")
    return kept.select("source_name", "target_share", F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("reached_share"), *[F.coalesce(c, zero).alias(c) for c in ("tokens", "documents", "most_uses")])

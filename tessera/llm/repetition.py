"""Repetition inside a document, and cutoffs on it whose false rejections are bounded.

The share of a document's word runs that equal an earlier run of it is measured with built-in expressions. A
cutoff for rejecting documents is then chosen per stratum from labelled rows: a cutoff is certified when the
exact binomial probability of seeing so few clean documents rejected, if the true rate were ``risk``, is at
most ``error`` divided by the number of tests (strata times cutoffs).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tessera.session import materialize

RUN_WORDS, LEAST_RUNS, LIMIT = 6, 12, 0.3
#: Cutoffs tried, share of clean documents that may be rejected, and probability that any certified cutoff rejects more.
CUTOFFS = tuple(i / 20 for i in range(1, 19))
RISK, ERROR = 0.01, 0.05


def words(text: Column) -> Column:
    """Maximal runs of letters of the lower-cased text; null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def measured(df: DataFrame, text_col: str, run_words: int = RUN_WORDS) -> DataFrame:
    """``df`` with _runs (word runs of the text) and _share (those that equal an earlier one, of all).

    A null, empty or short text has 0 runs and share 0. Whole texts are read; runs compare as strings.
    """
    none = F.array().cast("array<string>")

    def one(w: Column) -> Column:
        n = F.greatest(F.size(w) - (run_words - 1), F.lit(0))
        starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.struct(n.alias("runs"), F.size(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, run_words), " ")))).alias("different"))

    # the words are a lambda's argument, so that they are found once, wherever the optimiser moves the expression
    m = F.transform(F.array(F.coalesce(words(F.col(text_col)), none)), one)[0]
    share = F.when(F.col("_m.runs") > 0, (F.col("_m.runs") - F.col("_m.different")) / F.col("_m.runs")).otherwise(F.lit(0.0))
    return df.withColumn("_m", m).withColumns({"_runs": F.col("_m.runs"), "_share": share}).drop("_m")


def binomial_at_most(k: int, n: int, p: float) -> float:
    """Exact P(X <= k) for X binomial(n, p)."""
    if k >= n:
        return 1.0
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    i = np.arange(k + 1)
    terms = logs[n] - logs[i] - logs[n - i] + i * np.log(p) + (n - i) * np.log1p(-p)
    top = terms.max()
    return float(min(1.0, np.exp(top) * np.exp(terms - top).sum()))


def certified_cutoffs(labelled: DataFrame, cutoffs: Sequence[float] = CUTOFFS, risk: float = RISK, error: float = ERROR, otherwise: float = LIMIT) -> DataFrame:
    """(stratum, cutoff, clean, rejected, repeated, caught, bound, certified) per stratum.

    ``labelled``: stratum STRING, score DOUBLE, clean BOOLEAN. Of the certified cutoffs the one that catches
    most of the rows that are not clean, of several the one nearest to ``otherwise``; without any, ``otherwise`` with certified
    false (too few clean rows, or too many of them rejected at every cutoff). ``bound``: the exact probability of so few rejected
    if the true rate were ``risk``. Rows with a null label are left out, a null score is 0; a null stratum is one of its own.
    """
    known = labelled.filter("clean is not null").select(F.coalesce("stratum", F.lit("")).alias("stratum"), F.coalesce("score", F.lit(0.0)).alias("score"), "clean")
    over = [F.col("score") >= c for c in cutoffs]
    counts = known.groupBy("stratum").agg(F.count_if("clean").alias("clean"), F.count_if(~F.col("clean")).alias("repeated"), F.array(*[F.count_if(F.col("clean") & o) for o in over]).alias("rejected"), F.array(*[F.count_if(~F.col("clean") & o) for o in over]).alias("caught"))
    counts = materialize(counts, "labelled")  # a row per stratum
    tests = max(1, counts.count()) * len(cutoffs)
    grid = list(cutoffs)

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for stratum, clean, repeated, rejected, caught in zip(frame.stratum, frame.clean, frame.repeated, frame.rejected, frame.caught):
                bounds = [binomial_at_most(int(k), int(clean), risk) for k in rejected]
                passed = [i for i in range(len(grid)) if clean and bounds[i] <= error / tests]
                i = min(passed, key=lambda i: (-caught[i], abs(grid[i] - otherwise), grid[i]), default=None)
                out.append((stratum, otherwise, int(clean), 0, int(repeated), 0, 1.0, False) if i is None else (stratum, grid[i], int(clean), int(rejected[i]), int(repeated), int(caught[i]), bounds[i], True))
            yield pd.DataFrame(out, columns=["stratum", "cutoff", "clean", "rejected", "repeated", "caught", "bound", "certified"])

    return counts.mapInPandas(choose, "stratum string, cutoff double, clean long, rejected long, repeated long, caught long, bound double, certified boolean")


def judged(texts: DataFrame, text_col: str) -> DataFrame:
    """``texts`` without the text and with _clean: whether it keeps to the stated rule, told by reading it word by word.

    It shares no code with the score: words are found with another engine, and a run repeats if its words were seen in this order.
    """
    rest = texts.drop(text_col).schema
    kept = rest.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        word = regex.compile(r"\p{L}+")
        for batch in batches:
            clean = []
            for text in batch.column(text_col).to_pylist():
                words, seen, again = word.findall((text or "").lower()), set(), 0
                runs = len(words) - RUN_WORDS + 1
                for i in range(runs):
                    key = tuple(words[i : i + RUN_WORDS])
                    again += key in seen
                    seen.add(key)
                clean.append(runs < LEAST_RUNS or again < LIMIT * runs)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(clean, pa.bool_())], names=[*kept, "_clean"])

    return texts.mapInArrow(run, StructType([*rest.fields, StructField("_clean", BooleanType())]))


def scored_for(df: DataFrame, id_col: str, text_col: str, stratum_col: str, labels: DataFrame | None = None) -> DataFrame:
    """(id, stratum, _runs, _share) of every document; without ``labels`` also _clean, of every document too."""
    scored = measured(df.select(id_col, text_col, stratum_col), text_col)
    return judged(scored, text_col) if labels is None else scored.drop(text_col)


def cutoffs_for(scored: DataFrame, id_col: str, stratum_col: str, labels: DataFrame | None = None, cutoffs: Sequence[float] = CUTOFFS, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Certified cutoffs from ``labels`` (id, clean); without them, from all rows of ``scored``, by their own _clean."""
    told = scored.withColumnRenamed("_clean", "clean") if labels is None else scored.join(labels.select(id_col, "clean"), id_col)
    return certified_cutoffs(told.select(F.col(stratum_col).cast("string").alias("stratum"), F.col("_share").alias("score"), "clean"), cutoffs, risk, error)


def repeating(df: DataFrame, id_col: str, text_col: str, stratum_col: str, labels: DataFrame | None = None, cutoffs: Sequence[float] = CUTOFFS, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Documents that repeat themselves: (id, stratum, _runs, _share, cutoff), those with enough runs at or over their stratum's cutoff.

    The cutoff is certified on labelled rows (see cutoffs_for), so other labels give other documents. Where it can't be certified
    the stated limit holds. Rows with a null id are measured like others but take no label of ``labels``. An empty table gives no rows.
    """
    scored = materialize(scored_for(df, id_col, text_col, stratum_col, labels), "scored")
    limits = cutoffs_for(scored, id_col, stratum_col, labels, cutoffs, risk, error)
    chosen = scored.withColumn("stratum", F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))).join(F.broadcast(limits.select("stratum", "cutoff")), "stratum", "left")
    chosen = chosen.withColumn("cutoff", F.coalesce("cutoff", F.lit(LIMIT)))
    return chosen.filter((F.col("_runs") >= LEAST_RUNS) & (F.col("_share") >= F.col("cutoff"))).select(id_col, "stratum", "_runs", "_share", "cutoff")

"""Scoring items with integer arithmetic and ranking them with a limit on consecutive items of one author."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import time_ms

#: Fixed value: the span over which recency falls from 1000 to 0.
RECENCY_MS = 7 * 24 * 60 * 60 * 1000


@dataclass(frozen=True)
class RankParams:
    """Weights of the four components, affinity per topic, the authors who count as related, and the run limit."""

    as_of: str
    weights: Mapping[str, int] = field(default_factory=lambda: {"recency": 500, "relationship": 900, "evidence": 700, "discovery": 250})
    affinity: Mapping[str, int] = field(default_factory=dict)
    followed: tuple[str, ...] = ()
    consecutive: int = 1
    limit: int = 100

    def __post_init__(self):
        if not 1 <= self.limit <= 500 or self.consecutive < 1 or min(self.weights.values()) < 0:
            raise ValueError("limit must be from 1 to 500, the run limit at least 1, weights not negative")


def scored(items: DataFrame, p: RankParams) -> DataFrame:
    """``items`` (object_id, author_id, created_at, topics, evidence_score) with components and score.

    Null evidence counts 0, an unreadable time as oldest, a null author as not followed, null topics as none.
    """
    age = F.greatest(F.lit(0), F.unix_millis(F.to_timestamp(F.lit(p.as_of))) - time_ms(F.col("created_at")))
    recency = F.coalesce(F.greatest(F.lit(0), F.lit(1000) - F.floor(F.least(age, F.lit(RECENCY_MS)) * 1000 / RECENCY_MS)), F.lit(0)).cast("long")
    related = F.coalesce(F.col("author_id").isin(list(p.followed)), F.lit(False)) if p.followed else F.lit(False)
    liking = F.create_map(*[F.lit(x) for kv in p.affinity.items() for x in kv]) if p.affinity else F.create_map().cast("map<string,int>")
    topics = F.coalesce("topics", F.array().cast("array<string>"))
    liked = F.reduce(topics, F.lit(0).cast("long"), lambda s, t: s + F.coalesce(F.try_element_at(liking, t), F.lit(0)))
    w, total = p.weights, sum(p.weights.values())
    out = items.withColumns({"recency": recency, "relationship": F.when(related, 1000).otherwise(0).cast("long"), "discovery": F.when(related, 0).otherwise(1000).cast("long"), "evidence": F.coalesce("evidence_score", F.lit(0)).cast("long"), "topic": F.floor(liked / F.greatest(F.size(topics), F.lit(1))).cast("long")})
    weighted = sum((F.col(c) * F.lit(w.get(c, 0)) for c in ("recency", "relationship", "evidence", "discovery")), F.lit(0).cast("long"))
    return out.withColumn("score", (F.floor(weighted / total) if total else F.lit(0)).cast("long") + F.col("topic"))


def ranked(scores: DataFrame, p: RankParams) -> DataFrame:
    """(rank, object_id, author_id, score): by score and id, no more than ``consecutive`` of one author in a row while another has any left.

    The result has at most ``limit`` rows, so of each author only the first ``limit`` can appear, and only the
    ``limit`` authors with the best first rows: at most limit**2 rows reach the one task that picks in turn.
    A null author is an author like others.
    """
    order = [F.desc("score"), F.asc("object_id")]
    own = Window.partitionBy("author_id").orderBy(*order)
    near = scores.select("object_id", "author_id", "score").withColumn("nth", F.row_number().over(own)).filter(F.col("nth") <= p.limit)
    best = near.filter("nth = 1").orderBy(*order).limit(p.limit).select("author_id")
    few = near.join(F.broadcast(best), near.author_id.eqNullSafe(best.author_id), "left_semi").drop("nth").coalesce(1).sortWithinPartitions(*order)

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for f in frames for r in f.itertuples(index=False, name=None)]
        out: list[tuple] = []
        while rows and len(out) < p.limit:
            recent = {a for _, a, _ in out[-p.consecutive :]}
            run = len(out) >= p.consecutive and len(recent) == 1
            at = next((i for i, r in enumerate(rows) if r[1] not in recent), 0) if run else 0
            out.append(rows.pop(at))
        yield pd.DataFrame([(i + 1, *r) for i, r in enumerate(out)], columns=["rank", "object_id", "author_id", "score"])

    return few.mapInPandas(pick, "rank long, object_id string, author_id string, score long")

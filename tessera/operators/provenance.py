"""Checks of story histories: forks, links, evidence and disclosed risks, each one set operation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import hierarchy


def distinct_stories(stories: DataFrame) -> DataFrame:
    """One row per story_id, that of the smallest manifest_no."""
    return stories.groupBy("story_id").agg(F.min_by(F.struct(*[c for c in stories.columns if c != "story_id"]), "manifest_no").alias("r")).select("story_id", "r.*")


def forks(stories: DataFrame) -> DataFrame:
    """(previous_story_id, children) of stories with more than one successor."""
    return stories.filter("previous_story_id is not null").groupBy("previous_story_id").agg(F.countDistinct("story_id").alias("children")).filter("children > 1")


def broken_links(stories: DataFrame) -> DataFrame:
    """(story_id, violation): a revision that is not its predecessor's plus one, another root, or an earlier time."""
    before = stories.select(F.col("story_id").alias("previous_story_id"), F.col("revision").alias("r0"), F.coalesce("root_story_id", "story_id").alias("root0"), F.col("published_at").alias("t0"))
    joined = stories.select("story_id", "previous_story_id", "revision", "root_story_id", "published_at").join(before, "previous_story_id")
    found = F.when(~(F.col("revision") == F.col("r0") + 1), "invalid_revision").when(F.col("root_story_id").isNull() | (F.col("root_story_id") != F.col("root0")), "invalid_root").when(F.col("published_at") < F.col("t0"), "invalid_time")
    return joined.withColumn("violation", found).filter("violation is not null").select("story_id", "violation")


def evidence_links(stories: DataFrame) -> DataFrame:
    return stories.select("story_id", F.explode("evidence_receipt_ids").alias("receipt_id")).filter("receipt_id is not null").distinct()


def orphan_evidence(stories: DataFrame, evidence: DataFrame) -> DataFrame:
    """Receipts that no story names."""
    return evidence.select("receipt_id").distinct().join(evidence_links(stories).select("receipt_id"), "receipt_id", "left_anti")


def undisclosed_risks(stories: DataFrame, evidence: DataFrame) -> DataFrame:
    """(story_id, receipt_id, source_risk): linked evidence whose risk the story does not declare."""
    risk = evidence.select("receipt_id", "source_risk").filter("source_risk is not null").distinct()
    declared = stories.select("story_id", F.explode("source_risk_labels").alias("source_risk"))
    return evidence_links(stories).join(risk, "receipt_id").join(declared, ["story_id", "source_risk"], "left_anti").select("story_id", "receipt_id", "source_risk")


def chain_gaps(stories: DataFrame) -> DataFrame:
    """(root_story_id, revision, expected): within a declared root, revisions that do not follow one another."""
    w = Window.partitionBy("root_story_id").orderBy("revision", "story_id")
    expected = F.coalesce(F.lag("revision").over(w) + 1, F.lit(1))
    return stories.filter("root_story_id is not null").select("root_story_id", "story_id", "revision", expected.alias("expected")).filter("revision <> expected")


def chains(stories: DataFrame) -> DataFrame:
    """(story_id, root_id): the chain of every story by its predecessors; ``cycle`` where no order places it."""
    nodes = stories.select(F.col("story_id").alias("node_id"), F.array("previous_story_id").alias("parents"), F.coalesce("root_story_id", "story_id").alias("family"), F.col("manifest_no").alias("nth"))
    return hierarchy.resolve(nodes, ["family", "nth"]).select(F.col("node_id").alias("story_id"), "root_id")


def chain_unions(stories: DataFrame) -> DataFrame:
    """(root_id, stories, evidence, labels): how many stories a chain has, and how many distinct receipts and risk labels in all."""
    own = chains(stories).filter(F.col("root_id") != hierarchy.CYCLE)
    sets = stories.select("story_id", "evidence_receipt_ids", "source_risk_labels").join(own, "story_id")
    every = sets.select("root_id", F.lit("evidence").alias("kind"), F.explode("evidence_receipt_ids").alias("x")).unionByName(sets.select("root_id", F.lit("labels").alias("kind"), F.explode("source_risk_labels").alias("x")))
    counts = every.filter("x is not null").distinct().groupBy("root_id").agg(F.count_if(F.col("kind") == "evidence").alias("evidence"), F.count_if(F.col("kind") == "labels").alias("labels"))
    zero = F.lit(0).cast("long")
    return own.groupBy("root_id").agg(F.count("*").alias("stories")).join(counts, "root_id", "left").select("root_id", "stories", F.coalesce("evidence", zero).alias("evidence"), F.coalesce("labels", zero).alias("labels"))


def verdicts(stories: DataFrame, evidence: DataFrame) -> DataFrame:
    """(story_id, verdict): the first thing wrong with each story of a history, ``valid`` if nothing is.

    In order: cycle, missing_predecessor, fork, the violation of its link, missing_evidence, undisclosed_risk.
    """
    ids = stories.select("story_id", "previous_story_id")
    lost = ids.filter("previous_story_id is not null").join(stories.select(F.col("story_id").alias("previous_story_id")), "previous_story_id", "left_anti").select("story_id", F.lit(True).alias("lost"))
    forked = ids.join(forks(stories), "previous_story_id").select("story_id", F.lit(True).alias("forked"))
    unproven = evidence_links(stories).join(evidence.select("receipt_id"), "receipt_id", "left_anti").select("story_id").distinct().withColumn("unproven", F.lit(True))
    silent = undisclosed_risks(stories, evidence).select("story_id").distinct().withColumn("silent", F.lit(True))
    out = chains(stories)
    for more in (lost, forked, broken_links(stories), unproven, silent):
        out = out.join(more, "story_id", "left")
    code = F.when(F.col("root_id") == hierarchy.CYCLE, "cycle").when(F.col("lost"), "missing_predecessor")
    return out.select("story_id", code.when(F.col("forked"), "fork").when(F.col("violation").isNotNull(), F.col("violation")).when(F.col("unproven"), "missing_evidence").when(F.col("silent"), "undisclosed_risk").otherwise("valid").alias("verdict"))

"""Mixes of labels by era, and how they change from era to era."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Order of patterns, and the bounds that tell them.
PATTERNS = ("Transformation", "Displacement", "Augmentation", "Emergence")
SKILL_SHIFT, DEMAND_DECLINE, DEMAND_BAND, AI_EMERGENCE, AI_RISE = 0.30, -0.10, 0.10, 0.25, 0.05
# Words in labels that tell of AI.
AI_WORDS = ("ai", "gpt", "llm", "copilot", "agent", "prompt", "claude", "openai", "anthropic", "langchain", "langgraph")


def mix(rows: DataFrame, group: str, label: str) -> DataFrame:
    """(group, era, label, share): the share of the group's postings in the era that have the label, to six places.

    `rows` has (group, era, posting_id, label); totals count all its postings.
    """
    totals = rows.groupBy(group, "era").agg(F.count_distinct("posting_id").alias("total"))
    counts = rows.filter(F.col(label).isNotNull()).groupBy(group, "era", label).agg(F.count_distinct("posting_id").alias("n"))
    return counts.join(totals, [group, "era"]).select(group, "era", F.col(label).alias("label"), F.round(F.col("n") / F.col("total"), 6).alias("share"))


def dense_sets(rows: DataFrame, group: str, label: str, eras: list[str]) -> DataFrame:
    """(group, pos, era, labels, postings): every group with every era in order, empty where nothing was seen."""
    sets = rows.groupBy(group, "era").agg(F.collect_set(label).alias("labels"), F.count_distinct("posting_id").alias("postings"))
    grid = rows.select(group).distinct().select(group, F.posexplode(F.array(*[F.lit(e) for e in eras])).alias("pos", "era"))
    out = grid.join(sets, [group, "era"], "left")
    return out.select(group, "pos", "era", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("postings", F.lit(0)).cast("long").alias("postings"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def era_steps(sets: DataFrame, group: str) -> DataFrame:
    """Each step from an era to the next: sizes, what was kept, added and dropped, similarity and demand."""
    w = Window.partitionBy(group).orderBy("pos")
    s = sets.select("*", F.lag("era").over(w).alias("from_era"), F.lag("labels").over(w).alias("before"), F.lag("postings").over(w).alias("postings_from")).filter("pos > 0")
    j = jaccard(F.col("before"), F.col("labels"))
    return s.select(
        group, "from_era", F.col("era").alias("to_era"), "postings_from", F.col("postings").alias("postings_to"), F.size(F.array_intersect("before", "labels")).cast("long").alias("kept"),
        F.size(F.array_except("labels", "before")).cast("long").alias("added"), F.size(F.array_except("before", "labels")).cast("long").alias("dropped"), F.round(j, 6).alias("jaccard"),
        F.round(1 - j, 6).alias("change_ratio"), F.round(F.when(F.col("postings_from") > 0, (F.col("postings") - F.col("postings_from")) / F.col("postings_from")), 6).alias("demand_ratio"),
    )


def top_changes(shares: DataFrame, group: str, eras: list[str], top: int = 5) -> DataFrame:
    """The labels whose share changed most: by net change, then by the largest step, then by name, all descending."""
    grid = shares.select(group, "label").distinct().select(group, "label", F.posexplode(F.array(*[F.lit(e) for e in eras])).alias("pos", "era"))
    dense = grid.join(shares, [group, "label", "era"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    w = Window.partitionBy(group, "label").orderBy("pos")
    steps = dense.withColumn("delta", F.round(F.col("share") - F.lag("share").over(w), 6)).filter("pos > 0")
    per = steps.groupBy(group, "label").agg(F.round(F.sum("delta"), 6).alias("net_change"), F.max_by("delta", F.struct(F.abs("delta"), -F.col("pos"))).alias("max_step"), F.count_if(F.col("delta") != 0).alias("changed_steps"))
    order = Window.partitionBy(group).orderBy(F.desc(F.abs("net_change")), F.desc(F.abs("max_step")), F.desc("label"))
    return per.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).withColumn("direction", F.when(F.col("net_change") > 0, "increasing").when(F.col("net_change") < 0, "decreasing").otherwise("stable"))


def ai_density(mix_map: Column) -> Column:
    """The summed shares of labels with one of the words of AI in them."""
    hit = lambda k: F.lower(k).rlike("|".join(AI_WORDS))
    return F.aggregate(F.filter(F.map_entries(mix_map), lambda e: hit(e["key"])), F.lit(0.0), lambda acc, e: acc + e["value"])


def patterns(skill_shift: Column, demand_change: Column, ai_change: Column, ai_latest: Column, new_ai_tools: Column, narrowed: Column, no_baseline: Column) -> Column:
    """The patterns that a group's measures tell, in a fixed order."""
    automation = (ai_change >= AI_RISE) | new_ai_tools | narrowed
    tests = (skill_shift >= SKILL_SHIFT, (demand_change <= DEMAND_DECLINE) & automation, (demand_change >= -DEMAND_BAND) & new_ai_tools, no_baseline & (ai_latest >= AI_EMERGENCE))
    return F.filter(F.array(*[F.when(t, F.lit(p)) for p, t in zip(PATTERNS, tests)]), lambda x: x.isNotNull())


def restructuring(skill: Column, tool: Column, task: Column, responsibility: Column) -> Column:
    """How much work was rearranged, from 0 to 1; a null counts as zero."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), z(skill) * 0.35 + z(tool) * 0.25 + z(task) * 0.25 + F.least(F.lit(1.0), F.abs(z(responsibility))) * 0.15)), 6)

"""Skill velocity: change of a rolling mean over the weeks that are there."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import finite, trend

# Weeks of history, and weeks of the rolling mean and how many of them must be there.
HISTORY, ROLLING, LEAST = 5, 4, 2


def velocity(weekly: DataFrame, target: dt.date) -> DataFrame:
    """(label, demand_count, change, trend) of every label in the five weeks that end with `target`.

    `weekly` has (label, week_start, posting_count). The mean rolls over the weeks that have any row at all, a label
    counting zero where it has none; if the target week has none, over all five. The change is between the last two
    means; from zero to zero it is no number, from zero to more it is infinite, and both are stored as 0.
    """
    weeks = [target - dt.timedelta(days=7 * i) for i in range(HISTORY - 1, -1, -1)]
    rows = weekly.filter(F.col("week_start").isin(*weeks)).groupBy("label", "week_start").agg(F.sum("posting_count").alias("n"))
    present = rows.agg(F.collect_set("week_start").alias("p"))
    every = F.array(*[F.lit(w) for w in weeks])
    used = present.select(F.when(F.array_contains("p", F.lit(target)), F.array_sort("p")).otherwise(every).alias("weeks"))
    labels = rows.select("label").distinct()
    grid = labels.join(F.broadcast(used), F.lit(True)).select("label", F.posexplode("weeks").alias("i", "week_start"))
    dense = grid.join(rows, ["label", "week_start"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("label").orderBy("i")
    over = w.rowsBetween(-(ROLLING - 1), 0)
    mean = dense.withColumn("m", F.when(F.count("n").over(over) >= LEAST, F.avg("n").over(over))).withColumn("prev", F.lag("m").over(w))
    last = mean.withColumn("__last", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("i")))).filter("__last = 1")
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    change = F.when(F.col("prev").isNull(), nan).when(F.col("prev") == 0, F.when(F.col("m") == 0, nan).otherwise(inf)).otherwise((F.col("m") - F.col("prev")) / F.col("prev"))
    out = last.withColumn("__c", change)
    return out.select("label", F.when(F.col("week_start") == F.lit(target), F.col("n")).otherwise(0).cast("long").alias("demand_count"), finite(F.col("__c")).alias("change"), trend(F.col("__c")).alias("trend"))

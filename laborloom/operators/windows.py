"""Ordered analysis within keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """One row of each key: the latest `ts` (nulls last), then the largest `tie`."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(ts), F.desc(tie))
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def excess(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """Rows that repeat an earlier one of the same key, in the given order; nulls in keys are a value of their own."""
    named = df.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(keys)])
    w = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy(*order)
    return named.withColumn("__rn", F.row_number().over(w)).filter("__rn > 1").drop("__rn", *[f"__k{i}" for i in range(len(keys))])


def top_n(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first `n` rows of each group in the given order, with their `rank`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= n)


def ranked(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """All rows with their `rank` within `by`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def share_of_total(df: DataFrame, value: str, *by: str) -> Column:
    """The value's share of its partition's total; null where the total is zero."""
    return F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*by)))


def last_turns(df: DataFrame, key: str, order: str, text: str, n: int = 5, width: int = 400) -> DataFrame:
    """(key, turns): the last `n` texts of each key, each cut to `width`, the oldest first."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    last = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    turns = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.substring(text, 1, width).alias("t")))), lambda s: s["t"])
    return last.groupBy(key).agg(turns.alias("turns"))

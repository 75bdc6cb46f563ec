"""Keyed writes expressed as frames: the new state of a table, to be written over the old partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _side(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(prefix + c) for c in df.columns], F.lit(True).alias(prefix + "there"))


def latest_wins(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, the source's where the key is in both; of repeated keys in one side, one row."""
    both = target.withColumn("__from", F.lit(0)).unionByName(source.withColumn("__from", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("__from"))
    return both.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__from")


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target, and the source's rows with new keys, once each."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti").dropDuplicates(keys))


def fill_missing(target: DataFrame, source: DataFrame, keys: list[str], new_first: bool = False) -> DataFrame:
    """Rows of both; of a key in both, each column's value from the target, or from the source where that is null.
    With `new_first` the source's value comes first."""
    j = _side(target, keys, "t_").join(_side(source, keys, "s_"), keys, "full")
    first, second = ("s_", "t_") if new_first else ("t_", "s_")
    return j.select(*[F.col(c) if c in keys else F.coalesce(first + c, second + c).alias(c) for c in target.columns])


def update_from(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str], new_first: bool = True) -> DataFrame:
    """The target's rows only, the columns filled from the source as in fill_missing()."""
    s = source.select(*keys, *[F.col(c).alias("s_" + c) for c in columns]).dropDuplicates(keys)
    j = target.join(s, keys, "left")
    pick = lambda c: F.coalesce("s_" + c, c) if new_first else F.coalesce(c, "s_" + c)
    return j.select(*[pick(c).alias(c) if c in columns else F.col(c) for c in target.columns])


def fill_link(target: DataFrame, source: DataFrame, on: Column, link: str, value: Column, key: str) -> tuple[DataFrame, DataFrame]:
    """(the target with its null links filled, a preview: rows, with a link before, filled now). `key` tells the
    target's rows apart; of several matches the smallest value is taken."""
    found = target.filter(F.col(link).isNull()).join(source, on).groupBy(key).agg(F.min(value).alias("__v"))
    out = target.join(found, key, "left")
    preview = out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(link).isNotNull()).alias("had"), F.count_if(F.col(link).isNull() & F.col("__v").isNotNull()).alias("filled"))
    return out.select(*[F.coalesce(link, "__v").alias(link) if c == link else F.col(c) for c in target.columns]), preview


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, rows that break one, with `error_type`, the first broken rule's name)."""
    broken = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    marked = df.withColumn("error_type", broken)
    return marked.filter("error_type IS NULL").drop("error_type"), marked.filter("error_type IS NOT NULL")


def cascade(drop: DataFrame, key: str, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Each table without the rows whose column refers to a dropped key; nulls stay."""
    keys = drop.select(F.col(key).alias("__k")).distinct()
    return {name: t.join(keys, t[c] == F.col("__k"), "left_anti") for name, (t, c) in tables.items()}

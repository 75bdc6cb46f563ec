"""Reconciliation and data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, a, b, differs): both sides' values of every key of either, null where a side lacks it."""
    x, y = a.select(*keys, F.col(value).alias("a")), b.select(*keys, F.col(value).alias("b"))
    return x.join(y, keys, "full").withColumn("differs", ~F.col("a").eqNullSafe(F.col("b")))


def drift(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: keys, keys that differ, and their share."""
    r = reconcile(a, b, keys, value)
    return r.agg(F.count(F.lit(1)).alias("keys"), F.count_if("differs").alias("differing")).withColumn("share", F.try_divide("differing", "keys"))


def null_rates(df: DataFrame) -> DataFrame:
    """(column_name, n_rows, n_null, null_rate) of every column, in one pass; NaN counts as null."""
    missing = lambda c, t: F.col(c).isNull() | F.isnan(c) if t in ("double", "float") else F.col(c).isNull()
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(missing(c, t)).alias(c) for c, t in df.dtypes])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("__n").alias("n_rows"), F.col(c).alias("n_null")) for c in df.columns])
    return one.select(F.explode(rows).alias("x")).select("x.*").withColumn("null_rate", F.round(F.try_divide("n_null", "n_rows"), 6))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """The child's rows whose key is no parent's; rows with a null key are no orphans."""
    return child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("__p")), F.col(child_key) == F.col("__p"), "left_anti")


def alignment(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """One row: keys of both sides, keys of `a` that `b` lacks, and keys of `b` that `a` lacks."""
    j = a.select(F.col(a_key).alias("x")).distinct().join(b.select(F.col(b_key).alias("y")).distinct(), F.col("x") == F.col("y"), "full")
    return j.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("aligned"), F.count_if(F.col("y").isNull()).alias("missing"), F.count_if(F.col("x").isNull()).alias("orphans"))


def cluster_sizes(df: DataFrame, key: str) -> DataFrame:
    """(bucket, clusters, n_rows): how many keys have one row, two, up to five, or more; null keys are left out."""
    n = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    bucket = F.when(F.col("n") == 1, "1").when(F.col("n") == 2, "2").when(F.col("n") <= 5, "3-5").otherwise("6+")
    return n.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("n_rows"))


def missing_rate(df: DataFrame, group: str, column: str, limit: float) -> DataFrame:
    """(group, n, share, alert): the share of rows without a value, and whether it is above the limit."""
    share = F.count_if(F.col(column).isNull()) / F.count(F.lit(1))
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(share, 6).alias("share"), (share > limit).alias("alert"))


def fan_out(child: DataFrame, key: str) -> DataFrame:
    """One row: keys, rows, the mean and largest number of rows of a key, and rows beyond the first of each key."""
    per = child.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.count(F.lit(1)).alias("keys"), F.sum("c").alias("n_rows"), F.round(F.avg("c"), 6).alias("mean_rows"), F.max("c").alias("most_rows"), F.sum(F.col("c") - 1).alias("excess_rows"))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part over whole in percent, null where the whole is zero or null."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits)


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, bin_start, n): equal widths between least and greatest value; the greatest is in a bin of its own after
    the last, as width_bucket has it."""
    rows = df.select(F.col(value).cast("double").alias("v")).dropna()
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    counted = rows.join(F.broadcast(ends), F.lit(True)).select(F.expr(f"width_bucket(v, lo, hi, {bins}L)").alias("bin"), "lo", "hi")
    return counted.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi")).select("bin", F.round(F.col("lo") + (F.col("bin") - 1) * (F.col("hi") - F.col("lo")) / bins, 4).alias("bin_start"), "n")

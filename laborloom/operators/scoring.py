"""Scores of predictions and ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n)."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def class_report(pairs: DataFrame) -> DataFrame:
    """(label, support, precision_, recall_, f1) from confusion(); a ratio over nothing is zero."""
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    t = pairs.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("tp"))
    g = pairs.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("guessed"))
    j = t.join(g, "label", "full").na.fill(0, ["support", "tp", "guessed"])
    p, r = z(F.col("tp"), F.col("guessed")), z(F.col("tp"), F.col("support"))
    return j.select("label", "support", F.round(p, 6).alias("precision_"), F.round(r, 6).alias("recall_"), F.round(z(2 * p * r, p + r), 6).alias("f1"))


def calibration(df: DataFrame, confidence: str, right: Column, bins: int = 10) -> DataFrame:
    """(bin, n, mean_confidence, accuracy): equal widths, one in the last bin; nulls and NaN left out."""
    c = F.col(confidence)
    rows = df.filter(c.isNotNull() & ~F.isnan(c)).select(c.alias("c"), right.cast("double").alias("y"), F.least(F.floor(c * bins), F.lit(bins - 1)).alias("bin"))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean_confidence"), F.avg("y").alias("accuracy"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    """One row: the mean gap between confidence and accuracy, weighted by the bins' sizes."""
    return bins.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / F.sum("n"), 6).alias("ece"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, agreement, kappa): Cohen's, of two ratings; null where chance agreement is one."""
    c = df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left = c.groupBy("a").agg(F.sum("n").alias("na"))
    right = c.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = left.join(right, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("x"))
    both = total.join(F.broadcast(chance), F.lit(True))
    po, pe = F.col("same") / F.col("n"), F.col("x") / (F.col("n") * F.col("n"))
    return both.select("n", F.round(po, 6).alias("agreement"), F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"))


def set_scores(found: Column, truth: Column) -> Column:
    """struct(precision_, recall_, f1) of two sets; two empty sets are a perfect match."""
    tp = F.size(F.array_intersect(found, truth))
    z = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    none = (F.size(found) == 0) & (F.size(truth) == 0)
    p, r = F.when(none, 1.0).otherwise(z(tp, F.size(found))), F.when(none, 1.0).otherwise(z(tp, F.size(truth)))
    return F.struct(F.round(p, 6).alias("precision_"), F.round(r, 6).alias("recall_"), F.round(z(2 * p * r, p + r), 6).alias("f1"))


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """The weighted mean of the parts that are there; null if none is."""
    top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts[1:]), F.coalesce(parts[0][0] * parts[0][1], F.lit(0.0)))
    bottom = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts[1:]), F.when(parts[0][0].isNotNull(), parts[0][1]).otherwise(0.0))
    return F.try_divide(top, F.nullif(bottom, F.lit(0.0)))


def geometric(parts: list[Column]) -> Column:
    """The geometric mean; zero if a part is zero or less, null if one is null."""
    product = F.lit(1.0)
    for c in parts:
        product = product * c
    low = parts[0] <= 0
    for c in parts[1:]:
        low = low | (c <= 0)
    return F.when(low, 0.0).otherwise(F.pow(product, 1.0 / len(parts)))


def divergence(a: DataFrame, b: DataFrame, ids: DataFrame, a_key: str, b_key: str, a_score: str, b_score: str) -> DataFrame:
    """(a_key, b_key, both scores, delta): scores of two raters whose items a map of ids (a_key, b_key) matches."""
    j = a.join(ids, a_key).join(b, b_key)
    return j.select(a_key, b_key, a_score, b_score, F.round(F.abs(F.col(a_score) - F.col(b_score)), 6).alias("delta"))


def gaps(df: DataFrame, a: str, b: str) -> DataFrame:
    """(step, n): how often two scores differ by so many tenths."""
    d = F.floor(F.round(F.abs(F.col(a) - F.col(b)) * 10, 6)).cast("long")
    return df.select(a, b).dropna().groupBy(d.alias("step")).agg(F.count(F.lit(1)).alias("n"))

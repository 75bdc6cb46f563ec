"""Exact quantiles of groups of any size: what one task sorts is a group's different values, not its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantiles(df: DataFrame, groups: list[str], value: str, points: dict[str, float], between: bool = False, mean: str | None = None) -> DataFrame:
    """(groups, row_count, one column for each point, and `mean` where named) of each group; null values are left out.

    A quantile is the least value with that share of rows at or below it, or, with `between`, lies between the two values around
    its place. Rows are counted by group and value first, which combines before the shuffle; then counts are summed in order.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    upto = w.orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counts.withColumns({"__upto": F.sum("__n").over(upto), "__all": F.sum("__n").over(w)})

    def at(place):
        """The value at a place counted from 0."""
        return F.min(F.when(F.col("__upto") > place, F.col("__v")))

    out = []
    for name, q in points.items():
        if between:
            place = F.lit(q) * (F.col("__all") - 1)
            a, b, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
            out.append((a + (b - a) * part).alias(name))
        else:
            out.append(at(F.greatest(F.ceil(F.lit(q) * F.col("__all") - 1e-9) - 1, F.lit(0))).alias(name))
    if mean:
        out.append((F.sum(F.col("__v") * F.col("__n")) / F.sum("__n")).alias(mean))
    return summed.groupBy(*groups).agg(F.sum("__n").alias("row_count"), *out)

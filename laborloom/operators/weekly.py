"""Weekly demand, sectors, pay percentiles, snapshots and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from .quantiles import quantiles
from .windows import top_n


def demand(df: DataFrame, label: Column, posting: str = "posting_id", company: str | None = "company_id", extra: list[Column] | None = None) -> DataFrame:
    """(week_start, label, posting_count, employer_count): postings and employers of each label and week.

    Repeats are dropped on (week, label, posting), a posting's employer being the least it is given; then postings are
    counted by employer and these by label, so that no row is expanded for a second distinct count. Blank labels and null
    postings are left out.
    """
    cols = ["week_start", posting, *([company] if company else [])]
    rows = df.select(*cols, blank_to_null(label).alias("label"), *(extra or [])).filter(F.col("label").isNotNull() & F.col(posting).isNotNull())
    more = [c for c in rows.columns if c not in (*cols, "label")]
    keep = [F.max(c).alias(c) for c in more]
    once = rows.groupBy("week_start", "label", posting).agg(*([F.min(company).alias(company)] if company else [F.lit(1).alias("__one")]), *keep)
    if not company:
        return once.groupBy("week_start", "label").agg(F.count(F.lit(1)).alias("posting_count"), *keep)
    each = once.groupBy("week_start", "label", company).agg(F.count(F.lit(1)).alias("posting_count"), *keep)
    return each.groupBy("week_start", "label").agg(F.sum("posting_count").alias("posting_count"), F.count(company).alias("employer_count"), *keep)


def in_week(df: DataFrame, ts: str, monday) -> DataFrame:
    """Rows of the half-open week from `monday`; a range on the column itself, so that a scan can use it."""
    start = F.lit(monday).cast("timestamp")
    return df.filter((F.col(ts) >= start) & (F.col(ts) < start + F.expr("interval 7 days")))


def percentiles(df: DataFrame, group: Column, value: Column, least: int, points: tuple[int, ...] = (25, 50, 75, 95)) -> DataFrame:
    """(grp, row_count, p25, ...): exact percentiles (a value that occurs) of groups with `least` values or more."""
    rows = df.select(F.trim(group).alias("grp"), value.alias("v")).filter((F.col("grp") != "") & F.col("v").isNotNull())
    return quantiles(rows, ["grp"], "v", {f"p{p}": p / 100 for p in points}).filter(F.col("row_count") >= least)


def sector_summary(base: DataFrame, skills: DataFrame, least: int = 5, top: int = 10) -> DataFrame:
    """(sector, posting_count, employer_count, p50_salary, top_skills): sectors with `least` postings or more.

    `base` has (posting_id, sector, company, salary), `skills` (posting_id, skill). The median is a value that
    occurs; blank sectors are "Unknown"; the skills are counted in small letters, the most frequent first, then by name.
    """
    b = base.withColumn("sector", F.coalesce(blank_to_null(F.col("sector")), F.lit("Unknown")))
    by_company = b.groupBy("sector", blank_to_null(F.col("company")).alias("company")).agg(F.count(F.lit(1)).alias("posting_count"))
    agg = by_company.groupBy("sector").agg(F.sum("posting_count").alias("posting_count"), F.count("company").alias("employer_count")).filter(F.col("posting_count") >= least)
    agg = agg.join(quantiles(b, ["sector"], "salary", {"p50_salary": 0.5}).drop("row_count"), "sector", "left")
    counts = b.select("posting_id", "sector").join(skills.select("posting_id", F.lower(blank_to_null(F.col("skill"))).alias("skill")).dropna(), "posting_id").groupBy("sector", "skill").agg(F.count(F.lit(1)).alias("cnt"))
    best = top_n(counts, "sector", top, F.desc("cnt"), F.asc("skill")).groupBy("sector").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "skill"))), lambda s: s["skill"]).alias("top_skills"))
    return agg.join(best, "sector", "left").withColumn("top_skills", F.coalesce("top_skills", F.array().cast("array<string>")))


def pair_table(df: DataFrame, posting: str, label: str, cap: int | None = 20, top: int | None = 200) -> DataFrame:
    """(skill_a, skill_b, pair_count): unordered pairs of a posting's first `cap` labels in byte order, the `top`
    most frequent ones, ties by name. The cap is part of the measure: it bounds what one posting can add; None is no cap."""
    sets = df.select(posting, label).dropna().groupBy(posting).agg(F.array_sort(F.collect_set(label)).alias("s"))
    sets = sets if cap is None else sets.withColumn("s", F.slice("s", 1, cap))
    left = sets.select("s", F.posexplode("s").alias("i", "skill_a"))
    pairs = left.select("skill_a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("skill_b")).groupBy("skill_a", "skill_b").agg(F.count(F.lit(1)).alias("pair_count"))
    return pairs if top is None else pairs.orderBy(F.desc("pair_count"), "skill_a", "skill_b").limit(top)


def refresh_week(df: DataFrame, path: str, week: str = "week_start") -> None:
    """Replace the weeks that are in `df` in the partitioned table at `path`; a second run changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(week).parquet(path)


def replace_week(df: DataFrame, path: str, monday, week: str = "week_start") -> int:
    """Make `df`, rows of one week, that week's partition of the table at `path`, and none if `df` is empty; how many rows there are now."""
    rows = df.withColumn(week, F.lit(str(monday)))
    if rows.isEmpty():
        clear_week(df.sparkSession, path, monday, week)
        return 0
    refresh_week(rows, path, week)
    return df.sparkSession.read.parquet(path).filter(F.col(week) == F.lit(str(monday))).count()


def clear_week(spark, path: str, monday, week: str = "week_start") -> None:
    """Remove one week of the table at `path`, as for a week whose refresh gives no rows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{week}={monday}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

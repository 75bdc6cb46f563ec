"""Best representative of each duplicate group: votes per field and value, winners by max_by, pivoted back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timestamps import own_store, shape_dictionary, with_instant
from ..runtime import table

#: A vote loses half its weight in so many days, and a rank of trust is worth so many times the next one.
HALF_LIFE_DAYS = 90.0
TRUST_BASE = 2.0
_DAY = 86_400_000


def strip(text: Column) -> Column:
    """The text in lower case without surrounding white space of any kind."""
    return F.lower(F.regexp_replace(text, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", ""))


def group_key(*columns: Column) -> Column:
    """128 bits of the columns taken together; null if one is null."""
    parts = [strip(c) for c in columns]
    some = parts[0].isNotNull()
    for p in parts[1:]:
        some = some & p.isNotNull()
    return F.when(some, F.unhex(F.md5(F.concat_ws("\x01", *parts))))


def unpivot(rows: DataFrame, key: str, rid: str, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Long rows (key, rid, field, value, rank_of_vote): one for each row and field.

    `fields` maps a field's name to its value as text (null: no vote) and to the order of its votes, any orderable
    column of one type for all fields.
    """
    votes = F.array(*[F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"), order.alias("vote")) for name, (value, order) in fields.items()])
    return rows.select(F.col(key).alias("key"), F.col(rid).alias("rid"), F.explode(votes).alias("v")).select("key", "rid", "v.*")


def elect(long: DataFrame, fields: list[str], least: int = 2) -> DataFrame:
    """(key, group_id, n, then each field's winning row, null without a vote), for groups of `least` rows or more.

    The first aggregation is by key and field and combines before the shuffle, so that a group with a third of all
    rows costs one row for each task; the second puts the fields side by side.
    """
    won = long.groupBy("key", "field").agg(
        F.max_by(F.when(F.col("value").isNotNull(), F.col("rid")), F.when(F.col("value").isNotNull(), F.col("vote"))).alias("winner"), F.min("rid").alias("first"), F.count(F.lit(1)).alias("n")
    )
    side = won.groupBy("key").agg(F.min("first").alias("group_id"), F.max("n").alias("n"), *[F.max(F.when(F.col("field") == f, F.col("winner"))).alias(f) for f in fields])
    return side.filter(F.col("n") >= least)


def voted_values(long: DataFrame, fields: list[str], least: int = 2) -> DataFrame:
    """(key, group_id, n, then each field's winning value): votes of equal values are summed, the largest sum wins.

    `long` is as from unpivot(), its `vote` a number. A tie goes to the smaller value in byte order; a field without
    a vote is null.
    """
    sums = long.groupBy("key", "field", "value").agg(F.sum("vote").alias("votes"), F.min("rid").alias("first"), F.count(F.lit(1)).alias("n"))
    best = F.min_by("value", F.when(F.col("value").isNotNull(), F.struct(-F.round("votes", 9), F.col("value"))))
    won = sums.groupBy("key", "field").agg(best.alias("winner"), F.min("first").alias("first"), F.sum("n").alias("n"))
    side = won.groupBy("key").agg(F.min("first").alias("group_id"), F.max("n").alias("n"), *[F.max(F.when(F.col("field") == f, F.col("winner"))).alias(f) for f in fields])
    return side.filter(F.col("n") >= least)


def postings(spark: SparkSession, root: str) -> DataFrame:
    """`job_records` with the group key, trust rank (null sources last) and both instants in milliseconds; rows without an
    id or a part of the key are left out."""
    src = table(spark, root, "job_sources").select(strip(F.col("source")).alias("__src"), "trust_rank", "home_zone", "date_order").dropDuplicates(["__src"])
    jr = table(spark, root, "job_records").select(
        "job_id", group_key(F.col("external_id"), F.col("title"), F.col("company")).alias("key"), strip(F.col("source")).alias("__src"), "salary_min", "date_posted", "date_ingested"
    )
    out = jr.filter(F.col("key").isNotNull() & F.col("job_id").isNotNull()).join(src, "__src", "left").withColumn("__utc", F.lit("UTC"))
    d = shape_dictionary(jr, ["date_ingested", "date_posted"], own_store(spark))
    out = with_instant(out, "date_ingested", "__utc", "date_order", "ingested_ms", dictionary=d)
    out = with_instant(out, "date_posted", "home_zone", "date_order", "__ms", "__age", d)
    out = out.withColumn("posted_ms", F.coalesce("__ms", F.col("ingested_ms") - F.col("__age")))
    return out.withColumn("rank", F.coalesce("trust_rank", F.lit(2**31 - 1)).cast("long")).select("job_id", "key", F.col("__src").alias("source"), "salary_min", "rank", "ingested_ms", "posted_ms")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """For each group of repeated postings the rows that give the survivor its source, pay and date.

    A vote is the tuple of trust, recency and id, in the order that the field asks for, so that the sum of the votes
    of one row is that row's vote and max_by takes the best one. Rows with a null in external_id, title or company
    are in no group; NaN, null, zero and negative pay gets no vote; a field without a vote gives 0.
    """
    p = postings(spark, root)
    low = F.lit(-(2**62))
    trusted = F.struct((-F.col("rank")).alias("a"), F.coalesce("ingested_ms", low).alias("b"), (-F.col("job_id")).alias("c"))
    recent = F.struct(F.coalesce("posted_ms", low).alias("a"), (-F.col("rank")).alias("b"), (-F.col("job_id")).alias("c"))
    paid = F.when((F.col("salary_min") > 0) & ~F.isnan("salary_min"), F.col("salary_min"))
    fields = {"source_job_id": (F.lit("1"), trusted), "salary_job_id": (paid, trusted), "date_job_id": (F.col("posted_ms"), recent)}
    won = elect(unpivot(p, "key", "job_id", fields), list(fields))
    return won.select("group_id", *[F.coalesce(f, F.lit(0)).cast("long").alias(f) for f in fields])


def p1_survivors(spark: SparkSession, root: str) -> DataFrame:
    """For each group of repeated postings one record built field by field, by summed votes of equal values.

    A vote is TRUST_BASE to the power of minus the trust rank, halved for every HALF_LIFE_DAYS of age; as ages are
    compared within a group only, any fixed day will do as day zero.
    """
    p = postings(spark, root)
    age = (F.coalesce("ingested_ms", F.lit(0)) - F.lit(1_735_689_600_000)) / F.lit(_DAY)
    vote = F.pow(F.lit(TRUST_BASE), -F.least("rank", F.lit(60))) * F.pow(F.lit(2.0), age / F.lit(HALF_LIFE_DAYS))
    paid = F.when((F.col("salary_min") > 0) & ~F.isnan("salary_min"), F.col("salary_min"))
    day = F.date_format(F.timestamp_millis("posted_ms"), "yyyy-MM-dd")
    fields = {"source": (F.col("source"), vote), "salary_min": (paid, vote), "date_posted": (day, vote)}
    won = voted_values(unpivot(p, "key", "job_id", fields), list(fields))
    return won.select("group_id", "n", "source", F.col("salary_min").cast("double").alias("salary_min"), "date_posted")

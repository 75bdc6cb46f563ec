"""Stages of the record pipeline as functions of frames: each gives what goes on and what is rejected."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, labels, money, text
from .dedup import batch_survivors, new_rows, with_hashes
from .upserts import fill_missing, insert_missing, quarantine

#: Names of roles are numbered within this namespace.
ROLE_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "laborloom/roles")


@dataclass
class Stage:
    """A stage's output, what it rejected, and a one-row frame of counts."""

    passed: DataFrame
    rejected: DataFrame
    counts: DataFrame


def ingest(batch: DataFrame, stored: DataFrame, priority: Column) -> Stage:
    """Rows of a batch to store: of equal fingerprints the best source's first row, unless its hash is stored."""
    hashed = with_hashes(batch)
    best = batch_survivors(hashed, ["fingerprint"], priority, "arrival")
    fresh = new_rows(best, stored, "storage_hash")
    known = hashed.join(fresh.select("arrival"), "arrival", "left_anti")
    counts = hashed.agg(F.count(F.lit(1)).alias("fetched"), F.count_distinct("fingerprint").alias("distinct_postings"))
    return Stage(fresh, known, counts)


def ingest_all(rows: DataFrame, run: str, priority: Column) -> Stage:
    """As ingest(), for all batches at once: each run of the column `run` against what the runs before it stored.

    A batch's survivors don't depend on what is stored, so the first run with a hash among its survivors stores it.
    """
    hashed = with_hashes(rows)
    best = F.row_number().over(Window.partitionBy(run, "fingerprint").orderBy(priority, "arrival")) == 1
    first = F.row_number().over(Window.partitionBy("storage_hash").orderBy(F.desc("__best"), run, "arrival")) == 1
    marked = hashed.withColumn("__best", best).withColumn("__fresh", F.col("__best") & first)
    counts = hashed.agg(F.count(F.lit(1)).alias("fetched"), F.count_distinct(run, "fingerprint").alias("distinct_postings"))
    drop = lambda df: df.drop("__best", "__fresh")
    return Stage(drop(marked.filter("__fresh")), drop(marked.filter("NOT __fresh")), counts)


def normalise(raw: DataFrame) -> Stage:
    """Clean and typed rows; those without a title or an employer, or with the pay's ends swapped, are rejected."""
    pay = money.parse_pay(F.col("salary_raw"))
    out = raw.withColumn("__p", pay).select(
        *[c for c in raw.columns if c not in ("title", "company", "description", "date_posted", "employment_type", "salary_raw")],
        text.clean_text(F.col("title")).alias("title"), text.squeeze(F.col("company")).alias("company"), text.clean_text(F.col("description")).alias("description"),
        dates.parse_date(F.col("date_posted")).alias("date_posted"), labels.employment_type(F.col("employment_type")).alias("employment_type"),
        F.col("__p.low").alias("salary_min"), F.col("__p.high").alias("salary_max"), F.col("__p.currency").alias("salary_currency"), F.col("__p.period").alias("salary_period"),
    )
    ok, bad = quarantine(out, {"title": F.col("title") != "", "company": F.col("company") != "", "salary": F.coalesce(F.col("salary_max") >= F.col("salary_min"), F.lit(True))})
    return Stage(ok, bad, bad.groupBy("error_type").agg(F.count(F.lit(1)).alias("n")))


def promote(postings: DataFrame, enriched: DataFrame, keys: list[str]) -> DataFrame:
    """The postings with the enriched rows' values where these are there, and with the enriched rows that are new."""
    return fill_missing(insert_missing(postings, enriched.limit(0), keys), enriched, keys, new_first=True)


def promote_all(rows: DataFrame, keys: list[str], run: str) -> DataFrame:
    """As promote(), with one run after another: of each key, each column's last value that is there."""
    rest = [c for c in rows.columns if c not in keys]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(run, "arrival")))
    return rows.groupBy(*keys).agg(*[last(c).alias(c) for c in rest]).select(*rows.columns)


def top_of_role(rows: DataFrame, role: str, label: str, posting: str, known: DataFrame | None = None, top: int = 15) -> DataFrame:
    """(role, label, n, demand_pct): the labels that most of a role's postings name, with the share that do.

    With `known` (one column), only labels in it count, unless a role has none of them.
    """
    total = rows.groupBy(role).agg(F.count_distinct(posting).alias("total"))
    counts = rows.groupBy(role, label).agg(F.count_distinct(posting).alias("n"))
    if known is not None:
        marked = counts.join(known.select(F.col(known.columns[0]).alias(label), F.lit(True).alias("__in")).distinct(), label, "left")
        some = marked.groupBy(role).agg(F.max(F.coalesce("__in", F.lit(False))).alias("__some"))
        counts = marked.join(some, role).filter(F.coalesce("__in", F.lit(False)) | ~F.col("__some")).drop("__in", "__some")
    from .windows import top_n

    shares = counts.join(total, role).select(role, label, "n", F.round(F.col("n") / F.col("total"), 6).alias("demand_pct"))
    return top_n(shares, role, top, F.desc("n"), F.asc(label))


@F.pandas_udf(T.StringType())
def role_id(seed: pd.Series) -> pd.Series:
    """The number of a role's name."""
    return seed.map(lambda s: None if s is None else str(uuid.uuid5(ROLE_NAMESPACE, s)))


def role_ids(clusters: DataFrame) -> DataFrame:
    """Add role_id to (cluster_id, label, top_title, top_skill): from the label alone, or, where several clusters have
    it, from label, titles and skills."""
    name = F.coalesce(F.nullif(F.lower(text.squeeze(F.col("label"))), F.lit("")), F.lit("unlabeled-role"))
    many = F.count(F.lit(1)).over(Window.partitionBy("__l")) > 1
    more = F.concat_ws("|", "__l", F.array_join("top_title", "|"), F.array_join("top_skill", "|"))
    return clusters.withColumn("__l", name).withColumn("role_id", role_id(F.when(many, more).otherwise(F.col("__l")))).drop("__l")

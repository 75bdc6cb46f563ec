"""Mixed timestamp formats and time zones: a dictionary of distinct forms, parsed once, kept, joined back to the rows.

Nearly every text is different from all others, but for its digits there are few. So the dictionary's keys are the texts
with their digits masked; a key is parsed exhaustively once, and the rows' own digits, source zone and order of day and month
fill it in.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import SHAPE, age_of, instant, local_time, minutes_east, number_parts, numbers_of, read_shape, time_shape
from ..runtime import shared_dir, spread, table

#: The dictionary's columns, and the version of how shapes are read, which is part of a store's name.
COLUMNS, VERSION = "shape string, " + ", ".join(f"{k} {t}" for k, t in SHAPE.items()), 1
_NUMPY = {"int": "Int32", "long": "Int64", "boolean": "boolean", "string": "object"}


def posting_times(spark: SparkSession, root: str) -> DataFrame:
    """(job_id, date_posted, date_ingested, home_zone, date_order) of `job_records`.

    The eight sources are joined by their trimmed, lower-cased name; a source that is not listed leaves zone and order null.
    """
    src = table(spark, root, "job_sources").select(F.lower(F.trim("source")).alias("__src"), F.col("home_zone"), F.col("date_order")).dropDuplicates(["__src"])
    jr = table(spark, root, "job_records").select("job_id", F.lower(F.trim(F.regexp_replace("source", r"\s+", " "))).alias("__src"), "date_posted", "date_ingested")
    return jr.join(src, "__src", "left").drop("__src")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = pd.DataFrame([{"shape": s, **read_shape(s)} for s in pdf["shape"]], columns=["shape", *SHAPE])
        yield rows.astype({k: _NUMPY[t] for k, t in SHAPE.items()})


def shape_dictionary(rows: DataFrame, columns: list[str], store: str | None = None) -> DataFrame:
    """COLUMNS rows: how to read every distinct shape of the texts in `columns`. Nulls are left out.

    With `store`, a folder of Parquet files, only shapes that it lacks are parsed, and appended to it; the whole store is
    returned. Two writers at a time may both append a shape; as both read it alike, one is returned.
    """
    shapes = reduce(DataFrame.union, [rows.select(time_shape(F.col(c)).alias("shape")) for c in columns]).dropna().distinct()
    parse = lambda df: spread(df, "shape", per_core=1).mapInPandas(_read, COLUMNS)
    if store is None:
        return parse(shapes)
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    fresh = shapes.join(spark.read.schema(COLUMNS).parquet(store), "shape", "left_anti") if known else shapes
    parse(fresh).write.mode("append").parquet(store)
    return spark.read.schema(COLUMNS).parquet(store).dropDuplicates(["shape"])


def own_store(spark: SparkSession) -> str:
    """The dictionary that this library's queries keep in the shared folder."""
    return f"{shared_dir(spark)}/laborloom/time-shapes-{VERSION}"


def with_instant(df: DataFrame, raw: str, zone: str, order: str, ms: str, age_ms: str | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """Add `ms`, the instant in milliseconds that the text in column `raw` states, null where it states none, as instant() says.

    `zone` and `order` name columns; with `age_ms`, that column gets the age of texts like "3 days ago" (null otherwise). Null,
    empty and unreadable texts give nulls; all rows and their other columns are kept. A shape that a third of all rows have makes
    only the rows' side of the join skewed; AQE broadcasts the small dictionary or splits that side. The steps are columns of their
    own, as one long expression would be more than the compiler takes.
    """
    d = shape_dictionary(df, [raw]) if dictionary is None else dictionary
    how, n, p, local = (F.col(c) for c in ("__how", "__n", "__p", "__local"))
    d = d.select(F.col("shape").alias("__shape"), F.struct(*SHAPE).alias("__how"))
    out = df.withColumn("__shape", time_shape(F.col(raw))).join(d, "__shape", "left")
    out = out.withColumn("__n", numbers_of(F.col(raw))).withColumn("__p", number_parts(n, how)).withColumn("__local", local_time(p, how, F.col(order)))
    out = out.withColumn(ms, instant(local, minutes_east(p, how), n, how, F.col(zone)))
    return (out.withColumn(age_ms, age_of(n, how)) if age_ms else out).drop("__shape", "__how", "__n", "__p", "__local")


def normalise_times(rows: DataFrame, store: str | None = None) -> DataFrame:
    """Add `utc_ms` to rows with raw, zone, date_order and base: the instant, or null where the text states none.

    An age counts back from the instant in `base` (UTC where `base` names no zone). Null or repeated rows stay as
    they are; other columns are kept. The texts in `raw` and `base` are read by one dictionary; an empty zone is no zone.
    """
    spare = [c for c in ("utc_ms",) if c in rows.columns]
    rows = rows.drop(*spare)
    d = shape_dictionary(rows, ["raw", "base"], store)
    out = rows.withColumn("__zone", F.when(F.col("zone") != "", F.col("zone"))).withColumn("__utc", F.lit("UTC"))
    out = with_instant(out, "raw", "__zone", "date_order", "__ms", "__age", d)
    out = with_instant(out, "base", "__utc", "date_order", "__base", dictionary=d)
    return out.withColumn("utc_ms", F.coalesce("__ms", F.col("__base") - F.col("__age"))).drop("__zone", "__utc", "__ms", "__age", "__base")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Every time text of `job_records` that states a real point in time, as one UTC instant.

    Both texts of a row are read side by side, as an age in one counts back from the other.
    """
    rows = posting_times(spark, root).withColumn("__utc", F.lit("UTC"))
    d = shape_dictionary(rows, ["date_posted", "date_ingested"], own_store(spark))
    rows = with_instant(rows, "date_ingested", "__utc", "date_order", "__in", dictionary=d)
    rows = with_instant(rows, "date_posted", "home_zone", "date_order", "__out", "__age", d)
    pair = F.array(
        F.struct(F.lit("date_posted").alias("field_name"), F.coalesce("__out", F.col("__in") - F.col("__age")).alias("utc_ms")),
        F.struct(F.lit("date_ingested").alias("field_name"), F.col("__in").alias("utc_ms")),
    )
    return rows.select("job_id", F.explode(pair).alias("x")).select("job_id", "x.*").filter(F.col("utc_ms").isNotNull())

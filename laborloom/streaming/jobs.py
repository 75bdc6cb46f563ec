"""Streams of events and records: the batch functions, driven by micro-batches."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..functions.dates import week_of

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_files(spark: SparkSession, path: str, schema: T.StructType = EVENTS, files: int = 100) -> DataFrame:
    """A stream of Parquet files, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts and sums of each type and week from Monday; events later than `late` are dropped."""
    w = F.window("ts", "7 days", "7 days", "4 days")
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.to_date("w.start").alias("week_start"), "event_type", "n", "total")


def sliding(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts over 28 days that start each Monday."""
    w = F.window("ts", "28 days", "7 days", "4 days")
    return events.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """A user's events with less than `gap` between them."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "7 days") -> DataFrame:
    """Rows whose key was not seen within `late`; the state is bounded, unlike a unique key in a table."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def valid_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with id, time and a type, the others with a reason)."""
    why = F.when(F.col("event_id").isNull(), "no id").when(F.col("ts").isNull(), "no time").when(F.trim(F.coalesce("event_type", F.lit(""))) == "", "no type")
    marked = events.withColumn("reason", why)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


class Routes:
    """Handlers by type of event. Types of failures and alerts may be taken by the orchestrator only."""

    def __init__(self) -> None:
        self.handlers: dict[str, list[tuple[str, Callable[[DataFrame, int], None]]]] = {}

    def subscribe(self, event_type: str, subscriber: str, handler: Callable[[DataFrame, int], None]) -> None:
        if event_type.endswith(("Failed", "Alert")) and subscriber != "orchestrator":
            raise PermissionError(f"{subscriber} may not take {event_type}")
        self.handlers.setdefault(event_type, []).append((subscriber, handler))

    def deliver(self, batch: DataFrame, batch_id: int) -> None:
        """Give each handler the batch's rows of its type. A handler that raises fails the batch, which is then given
        again from the checkpoint, so handlers must bear a repeated batch id."""
        batch.persist()
        try:
            for event_type, handlers in self.handlers.items():
                rows = batch.filter(F.col("event_type") == event_type)
                for _, handler in handlers:
                    handler(rows, batch_id)
        finally:
            batch.unpersist()


def start(df: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> DataStreamWriter:
    """Start a stream into a handler of (batch, id): all that is there, or every 10 seconds."""
    w = df.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")).start()


def recompute_weeks(history: Callable[[], DataFrame], build: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A handler that rebuilds, from all rows, every week that a batch touches: late rows correct their week, and a
    repeated batch changes nothing."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        weeks = batch.select(week_of(F.col("ts")).alias("week_start")).dropna().distinct()
        ends = weeks.agg(F.min("week_start").alias("a"), F.max("week_start").alias("b")).first()
        if ends["a"] is None:
            return
        # a range of the time itself, which the scan of the history can use, then the weeks in it that were touched
        a, b = (dt.datetime.combine(d, dt.time()) for d in (ends["a"], ends["b"] + dt.timedelta(days=7)))
        near = history().filter((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b)))
        rows = near.withColumn("week_start", week_of(F.col("ts"))).join(weeks, "week_start", "left_semi")
        build(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week_start").parquet(path)

    return handle


def keyed(events: DataFrame, key: Column, *order: str) -> DataFrame:
    """(key, value) rows for a log that keeps the order of equal keys: all of a key in one partition, in the given order."""
    rows = events.withColumn("__key", key.cast("string")).repartition("__key").sortWithinPartitions("__key", *order)
    return rows.select(F.col("__key").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))


class Counters:
    """Counts of batches: rows published, delivered and failed, and the largest number in flight."""

    def __init__(self) -> None:
        self.published = self.delivered = self.failures = self.in_flight = self.peak = 0
        self.seen: set[int] = set()

    def around(self, handler: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """The handler with its batches counted; a batch given again after a failure is published once."""

        def handle(batch: DataFrame, batch_id: int) -> None:
            n = batch.count()
            if batch_id not in self.seen:
                self.seen.add(batch_id)
                self.published += n
            self.in_flight += n
            self.peak = max(self.peak, self.in_flight)
            try:
                handler(batch, batch_id)
                self.delivered += n
            except Exception:
                self.failures += 1
                raise
            finally:
                self.in_flight -= n

        return handle


def one_by_one(apply: Callable[[list], None], order: str, done: dict) -> Callable[[DataFrame, int], None]:
    """A handler that gives rows one at a time, in order, and remembers in `done` the last one that was applied.

    The first failure ends the batch; when it is given again, rows up to the last applied one are skipped, so that the log goes on where
    it stopped. For control events, which are few: all rows pass through the driver.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        last = done.get("last")
        rows = batch if last is None else batch.filter(F.col(order) > F.lit(last))
        for row in rows.orderBy(order).toLocalIterator():
            apply(row)
            done["last"] = row[order]

    return handle


def crash_and_replay(stream: Callable[[], DataFrame], handler: Callable[[DataFrame, int], None], checkpoint: str, crashes: int = 1) -> int:
    """Run a stream to its end though its handler dies `crashes` times in the middle of a batch, after its work was done but before the
    batch was noted as done; how often batches were handled. What the handler has written must be the same as without a crash."""
    state = {"handled": 0, "left": crashes}

    def dying(batch: DataFrame, batch_id: int) -> None:
        handler(batch, batch_id)
        state["handled"] += 1
        if state["left"] > 0:
            state["left"] -= 1
            raise RuntimeError("stopped on purpose")

    for _ in range(crashes + 1):
        try:
            start(stream(), dying, checkpoint).awaitTermination()
        except Exception as e:
            if "stopped on purpose" not in str(e):
                raise
    return state["handled"]


def synthetic(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """`n` events that depend on the seed only."""
    ids = spark.range(n).withColumnRenamed("id", "event_id")
    r = F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(1_000_000))
    kinds = F.array(*[F.lit(k) for k in ("IngestBatch", "NormalizationComplete", "SourceFailed", "StaleAlert")])
    return ids.select("event_id", (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=r.cast("int"))).alias("ts"), F.pmod(r, F.lit(50)).alias("user_id"), F.get(kinds, F.pmod(r, F.lit(4)).cast("int")).alias("event_type"),
                      (r / 1000.0).alias("value"), F.concat(F.lit('{"k": '), F.pmod(r, F.lit(100)), F.lit("}")).alias("props"))


def stale(tables: dict[str, dt.datetime], now: dt.datetime, minutes: int = 15) -> list[dict]:
    """An alert for each table computed more than `minutes` ago."""
    return [{"table": t, "age_minutes": round((now - at).total_seconds() / 60, 3)} for t, at in sorted(tables.items()) if (now - at) > dt.timedelta(minutes=minutes)]

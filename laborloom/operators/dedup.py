"""Repeats within a batch and against what is stored, and near-repeats with the choice of a survivor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digest
from ..runtime import materialize, parts_for
from .components import classes
from .similarity import NEAR, WINDOW_DAYS, earlier_neighbours


def with_hashes(df: DataFrame) -> DataFrame:
    """Add fingerprint (id, title, company: the same for all sources) and storage_hash (with the source)."""
    same = [F.col("external_id"), F.col("title"), F.col("company")]
    return df.withColumn("fingerprint", digest(*same)).withColumn("storage_hash", digest(F.col("source"), *same))


def batch_survivors(df: DataFrame, keys: list[str], priority: Column, arrival: str) -> DataFrame:
    """One row of each key: the best priority (smallest), then the first to arrive."""
    w = Window.partitionBy(*keys).orderBy(priority, F.col(arrival))
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def new_rows(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't stored yet; rows with a null key are new."""
    return df.join(stored.select(F.col(key).alias("__s")).dropna().distinct(), F.col(key) == F.col("__s"), "left_anti")


def sequential_survivors(df: DataFrame, block: str, threshold: float = NEAR, days: int = WINDOW_DAYS) -> DataFrame:
    """(key, survivor, similarity) replayed in order of date and key within each block, as rows arrive one by one.

    `df` has (block, key, ts, vector, filled). A row is compared with the survivors of the last `days` before it; if
    the most similar one is above the threshold, the fuller of the two survives, the newer one of equals, and the
    other one points to it. Only rows that such links join, directly or through others, bear on each other, so these
    classes are replayed one by one, however many rows a block has.
    """
    near = earlier_neighbours(df.select(block, "key", "ts", "vector", "filled").dropna(), block, "key", "ts", "vector", days).filter(F.col("similarity") > threshold - 1e-9)
    linked = classes(materialize(near.select(F.col("key").alias("a"), F.col("other").alias("b")), "near"))
    df = df.join(linked.select(F.col("node").alias("key"), F.col("root").alias("__class")), "key")

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, alive = None, []  # survivors of the window: (ts, key, filled, vector)
        for pdf in batches:
            out = []
            for b, key, ts, vector, full in zip(pdf["block"], pdf["key"], pdf["ts"], pdf["vector"], pdf["filled"]):
                if b != at:
                    at, alive = b, []
                v = np.asarray(vector, float)
                v = v / max(float(np.linalg.norm(v)), 1e-12)
                alive = [s for s in alive if s[0] >= ts - days * 86400]
                best = max(((float(v @ s[3]), -i) for i, s in enumerate(alive) if s[0] < ts), default=None)
                if best is None or best[0] <= threshold:
                    alive.append((ts, key, full, v))
                    continue
                other = alive[-best[1]]
                if full >= other[2]:
                    out.append((other[1], key, best[0]))
                    alive[-best[1]] = (ts, key, full, v)
                else:
                    out.append((key, other[1], best[0]))
            yield pd.DataFrame(out, columns=["key", "survivor", "similarity"])

    rows = df.select(F.col("__class").cast("string").alias("block"), F.col("key").cast("long").alias("key"), F.unix_timestamp("ts").alias("ts"), "vector", F.col("filled").cast("int").alias("filled")).dropna()
    n = parts_for(df)
    return rows.repartition(n, "block").sortWithinPartitions("block", "ts", "key").mapInPandas(replay, "key long, survivor long, similarity double")


def follow(links: DataFrame, most: int = 40) -> DataFrame:
    """(key, survivor) with each chain of (key, survivor) followed to its end, in a number of rounds that grows as the
    logarithm of the longest chain."""
    cur = materialize(links.select("key", "survivor"), "chain")
    for _ in range(most):
        up = cur.select(F.col("key").alias("survivor"), F.col("survivor").alias("up"))
        new = materialize(cur.join(up, "survivor", "left").select("key", F.coalesce("up", "survivor").alias("survivor"), F.col("up").isNotNull().alias("moved")), "chain")
        cur = new.select("key", "survivor")
        if new.filter("moved").isEmpty():
            return cur
    raise RuntimeError("a chain of survivors does not end")

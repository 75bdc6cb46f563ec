"""Vectors: blocked neighbours, nearest neighbours, thresholds and centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import groups
from ..functions.vectors import dot, unit
from ..runtime import parts_for

# A pair is a repeat above this cosine, if it was posted in so many days before.
NEAR, WINDOW_DAYS = 0.92, 30
#: Queries of a nearest-neighbour search go to every task, so there may be so many.
MOST_QUERIES = 10_000


def earlier_in_window(df: DataFrame, block: str, key: str, ts: str, days: int = WINDOW_DAYS, more: tuple[str, ...] = ()) -> DataFrame:
    """(block, key, ts, other, other_ts, and the columns `more` of both, the other's as other_...): rows of one block with an earlier one
    of the last `days` (the first day included, the row's own instant not). Rows are bucketed by date, so that a block is
    many small joins and no pair is met twice."""
    v = df.select(block, F.col(key).alias("key"), F.col(ts).alias("ts"), *more)
    bucket = F.floor(F.unix_timestamp("ts") / (86400 * days))
    a = v.withColumn("bucket", bucket)
    b = v.select(F.col(block), F.col("key").alias("other"), F.col("ts").alias("other_ts"), *[F.col(c).alias(f"other_{c}") for c in more], F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    near = (F.col("other_ts") < F.col("ts")) & (F.col("other_ts") >= F.col("ts") - F.expr(f"interval {days} days")) & (F.col("key") != F.col("other"))
    return a.join(b, [block, "bucket"]).filter(near).drop("bucket")


def earlier_neighbours(df: DataFrame, block: str, key: str, ts: str, vector: str, days: int = WINDOW_DAYS) -> DataFrame:
    """(key, other, other_ts, similarity) of the pairs of earlier_in_window()."""
    near = earlier_in_window(df.withColumn("__v", unit(F.col(vector))), block, key, ts, days, ("__v",))
    return near.select("key", "other", "other_ts", dot(F.col("__v"), F.col("other___v")).alias("similarity"))


def nearest_earlier(pairs: DataFrame, threshold: float = NEAR) -> DataFrame:
    """(key, other, similarity): each row's most similar earlier one, if it is above (not at) the threshold; of equal
    ones the smallest key."""
    best = pairs.groupBy("key").agg(F.max_by(F.struct("other", "similarity"), F.struct("similarity", -F.col("other"))).alias("b"))
    return best.select("key", "b.*").filter(F.col("similarity") > threshold)


def pairs_in_block(df: DataFrame, block: str, key: str, vector: str, threshold: float, chunk: int = 2_000) -> DataFrame:
    """(a, b, similarity) of keys a < b in one block whose cosine is above the threshold.

    A block is divided into chunks of about `chunk` rows; each two chunks are one matrix product, so that a block with
    a third of all rows is spread over the cluster, and only pairs above the threshold leave a task.
    """
    sizes = df.groupBy(block).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("m"))
    rows = df.select(F.col(block).alias("block"), F.col(key).cast("long").alias("key"), F.col(vector).alias("v")).dropna()
    rows = rows.join(sizes.select(F.col(block).alias("block"), "m"), "block").withColumn("c", F.pmod(F.xxhash64("key"), F.col("m")).cast("int"))
    both = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    work = both.withColumn("task", F.concat_ws("/", F.col("block").cast("string"), F.least("c", "k"), F.greatest("c", "k"))).select("task", "key", "v", "c", (F.col("c") == F.col("k")).alias("own"))

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for task, g in groups(batches, "task"):
            _, i, j = task.rsplit("/", 2)
            m = np.stack(g["v"].to_numpy()).astype(float)
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            keys = g["key"].to_numpy()
            left, right = (np.flatnonzero(g["c"].to_numpy() == int(x)) for x in (i, j))
            sim = m[left] @ m[right].T
            at = np.argwhere(sim > threshold)
            a, b = keys[left[at[:, 0]]], keys[right[at[:, 1]]]
            keep = a < b if i == j else a != b
            yield pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": sim[at[:, 0], at[:, 1]][keep]})

    n = parts_for(df)
    return work.repartition(n, "task").sortWithinPartitions("task").mapInPandas(product, "a long, b long, similarity double")


def sweep_pairs(df: DataFrame, key: str, vector: str, label: str, thresholds: list[float], chunk: int = 2_000) -> DataFrame:
    """threshold_sweep() over all pairs of rows, "similar above the threshold" against "same label".

    Every pair is compared once, in tiles of two chunks; a tile gives its counts only, so that what is shuffled is the rows of the
    tiles and a few numbers. Rows without a vector or label are left out.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"), F.xxhash64(label).alias("label")).where(F.col(vector).isNotNull() & F.col(label).isNotNull())
    chunks = max(1, -(-rows.count() // chunk))
    c = F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda o: F.concat_ws("-", F.least("c", o), F.greatest("c", o)))
    work = rows.withColumn("c", c).withColumn("task", F.explode(tiles))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for task, g in groups(batches, "task"):
            i, j = (int(x) for x in task.split("-"))
            m = np.stack(g["v"].to_numpy()).astype(float)
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            keys, names, at = g["key"].to_numpy(), g["label"].to_numpy(), g["c"].to_numpy()
            left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
            sim = m[left] @ m[right].T
            pair = keys[left][:, None] < keys[right][None, :] if i == j else np.ones(sim.shape, bool)
            same = (names[left][:, None] == names[right][None, :]) & pair
            other = pair & ~same
            for t in thresholds:
                above = sim > t
                yield pd.DataFrame([[float(t), int((above & same).sum()), int((above & other).sum()), int((~above & same).sum()), int((~above & other).sum())]], columns=["threshold", "tp", "fp", "fn", "tn"])

    found = work.repartition(parts_for(df), "task").sortWithinPartitions("task").mapInPandas(count, "threshold double, tp long, fp long, fn long, tn long")
    out = found.groupBy("threshold").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn", "tn")])
    return with_ratios(out)


def with_ratios(out: DataFrame) -> DataFrame:
    """Add precision_ and recall_ to counts of decisions."""
    ratio: Column = F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6)
    return out.withColumn("precision_", ratio).withColumn("recall_", F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6))


def knn(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, most: int = MOST_QUERIES) -> DataFrame:
    """(query_id, key, similarity, rank): the k most similar rows of each query, itself left out, ties by key.

    `queries` (query_id, vector) are compared with all rows by matrix product, `most` at a time, as these go to every task; each task
    keeps its best k over all its batches, so that what is shuffled is k rows for each query and task.
    """
    n = queries.count()
    rounds = max(1, -(-n // max(most // 2, 1))) if n > most else 1
    found = None
    for r in range(rounds):
        some = queries if rounds == 1 else queries.filter(F.pmod(F.xxhash64(F.col(queries.columns[0])), F.lit(rounds)) == r)
        one = _knn_round(df, key, vector, some.collect(), k)
        found = one if found is None else found.union(one)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), F.asc(key))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _knn_round(df: DataFrame, key: str, vector: str, rows: list, k: int) -> DataFrame:
    ids = np.array([r[0] for r in rows], np.int64)
    q = np.array([r[1] for r in rows], float).reshape(len(rows), -1)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)

    def best(sim: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of each row, and all that tie with the last of them, cut by key."""
        if sim.shape[1] <= k:
            return sim, keys
        order = np.lexsort((keys, -np.round(sim, 9)), axis=1)[:, :k]
        return np.take_along_axis(sim, order, 1), np.take_along_axis(keys, order, 1)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sims, keys = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for pdf in batches:
            if not len(pdf) or not len(ids):
                continue
            m = np.stack(pdf[vector].to_numpy()).astype(float)
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            mine = pdf[key].to_numpy()
            sim = q @ m.T
            sim[ids[:, None] == mine[None, :]] = -np.inf
            at = np.broadcast_to(mine, sim.shape)
            if sim.shape[1] > 4 * k:  # all that reach the k-th best, by selection; ties are kept
                cut = -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k] - 1e-9
                wide = int((sim >= cut).sum(1).max())
                top = np.argpartition(-sim, min(wide, sim.shape[1] - 1), axis=1)[:, :wide]
                sim, at = np.take_along_axis(sim, top, 1), np.take_along_axis(at, top, 1)
            sims, keys = best(np.concatenate([sims, sim], 1), np.concatenate([keys, at], 1))
        if sims.size:
            rows = pd.DataFrame({"query_id": np.repeat(ids, sims.shape[1]), key: keys.ravel(), "similarity": sims.ravel()})
            yield rows[np.isfinite(rows["similarity"])]

    return df.select(key, vector).dropna().mapInPandas(task, f"query_id long, {key} long, similarity double")


def nearest_centroid(df: DataFrame, key: str, vector: str, centres: DataFrame, most: int = MOST_QUERIES) -> DataFrame:
    """(key, label, similarity): each row's most similar centroid, ties to the smaller label.

    `centres` (label, centroid), one row for each label, go to every task and are compared by matrix product; more than `most` raise.
    """
    rows = sorted(centres.select("label", "centroid").limit(most + 1).collect())
    if len(rows) > most:
        raise ValueError(f"more than {most} centroids")
    names = np.array([r[0] for r in rows])
    c = np.array([r[1] for r in rows], float).reshape(len(rows), -1)
    c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) and len(rows):
                m = np.stack(pdf[vector].to_numpy()).astype(float)
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                sim = np.round(m @ c.T, 9)
                at = sim.argmax(1)  # the first of equal ones, which are in order of labels
                yield pd.DataFrame({key: pdf[key], "label": names[at], "similarity": sim[np.arange(len(at)), at]})

    kinds = dict(df.dtypes) | dict(centres.dtypes)
    return df.select(key, vector).dropna().mapInPandas(task, f"{key} {kinds[key]}, label {kinds['label']}, similarity double")


def threshold_sweep(scored: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, tn, precision_, recall_): decisions "score above threshold" against the truth."""
    t = scored.select(F.col(score).alias("s"), F.col(truth).alias("y"), F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold"))
    yes = F.col("s") > F.col("threshold")
    return with_ratios(t.groupBy("threshold").agg(F.count_if(yes & F.col("y")).alias("tp"), F.count_if(yes & ~F.col("y")).alias("fp"), F.count_if(~yes & F.col("y")).alias("fn"), F.count_if(~yes & ~F.col("y")).alias("tn")))

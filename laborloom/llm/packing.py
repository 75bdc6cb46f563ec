"""Filling fixed-capacity containers with items: vector best-fit on tokens, documents and attention cost."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, parts_for, scanned, table
from .stream import groups

#: The tokenizer's file, which every executor needs in the same place, as it does the module that reads it.
TOKENIZER = os.environ.get("LABORLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: A window takes one piece for so many of its tokens, a few at least. Attention is computed in tiles of TILE tokens on a side
#: (a 16th of short windows), each piece's own square, so a piece costs its length in whole tiles, squared; a window may cost
#: what one piece that fills it costs.
PER_PIECE, FEW, TILE = 32, 4, 32
#: Weights of what is left of tokens, pieces and cost.
WEIGHTS = (1.0, 0.02, 0.05)
#: Pieces of one shard, which one task packs.
SHARD = 20_000


def encoder(path: str = TOKENIZER):
    """The public tokenizer in `path`, a file of ranks; it is read, never trained."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every row of `docs` (doc_id, text); null and empty texts have none.

    The tokenizer gets every text whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]}).astype({"doc_id": "int64", "n_tokens": "int64"})

    return scanned(docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())).mapInPandas(run, "doc_id long, n_tokens long")


def most_pieces(capacity: int) -> int:
    """How many pieces a window takes."""
    return max(FEW, capacity // PER_PIECE)


def cost_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The attention cost of pieces in windows of this capacity, in tokens squared."""
    tile = max(1, min(TILE, capacity // 16))
    return (np.ceil(np.asarray(sizes, float) / tile) * tile) ** 2


def best_fit(sizes: np.ndarray, capacity: int, most: int | None = None, cost: float | None = None, weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """The window of each piece, for pieces in any order, none longer than the capacity.

    `most` pieces and `cost` are the window's other capacities, by default most_pieces() and what one full piece costs.
    The longest piece goes first. Of the open windows with room in all three dimensions (tokens, pieces, cost), it
    gets the one whose weighted residual norm is least after it is in; ties go to the older window. A window closes
    when it is full. Pieces of no tokens only take a place.
    """
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    out = np.empty(len(sizes), np.int64)
    room = np.array([capacity, most_pieces(capacity) if most is None else most, cost_of(capacity, capacity) if cost is None else cost], float)
    each = cost_of(sizes, capacity)
    wt, wp, wc = (w / r**2 for w, r in zip(weights, room))
    tokens, places, costs, number = (np.zeros(1024) for _ in range(4))
    n = made = 0
    cheapest = each.min() if len(each) else 0.0
    for i in order:
        s = float(sizes[i])
        c = each[i]
        if n:
            t, p, a = tokens[:n] - s, places[:n] - 1, costs[:n] - c
            norm = np.where((t >= 0) & (p >= 0) & (a >= 0), wt * t * t + wp * p * p + wc * a * a, np.inf)
            k = int(np.argmin(norm))
        if n and norm[k] < np.inf:
            tokens[k], places[k], costs[k] = t[k], p[k], a[k]
            out[i] = number[k]
            if (tokens[k] <= 0 and s > 0) or places[k] <= 0 or costs[k] < cheapest:
                n -= 1
                for x in (tokens, places, costs, number):
                    x[k:n] = x[k + 1 : n + 1]
        else:
            out[i] = made
            if s < capacity and room[1] > 1 and room[2] - c >= cheapest:
                if n == len(tokens):
                    tokens, places, costs, number = (np.append(x, np.zeros(n)) for x in (tokens, places, costs, number))
                tokens[n], places[n], costs[n], number[n] = capacity - s, room[1] - 1, room[2] - c, made
                n += 1
            made += 1
    return out


def pieces_of(counted: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, part, start_token, n_tokens): a document in one piece, or, if it alone exceeds the capacity, in full
    windows and a rest."""
    full = F.greatest(F.floor((F.col("n_tokens") - 1) / capacity), F.lit(0))
    parts = counted.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), full.cast("long"))).alias("part"))
    start = F.col("part") * capacity
    return parts.select("doc_id", "part", start.alias("start_token"), F.least(F.lit(capacity), F.col("n_tokens") - start).cast("long").alias("n_tokens"))


def pack(counted: DataFrame, capacity: int, shard: int = SHARD) -> DataFrame:
    """(window_id, doc_id, part, start_token, n_tokens) for every piece of `counted` (doc_id, n_tokens), repeated rows
    taken once.

    Pieces are spread by hash over shards of about `shard` pieces, each packed in one task, those of a long document too. A shard leaves a few windows with room, so the loss is a few windows in thousands. A window's number is
    the shard's and its own within the shard.
    """
    counted = counted.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    pieces = pieces_of(counted, capacity)
    number = counted.agg(F.sum(F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-int(number) // shard))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, g in groups(batches, "shard"):
            g = g.sort_values(["doc_id", "part"], ignore_index=True)
            yield g.assign(window_id=best_fit(g["n_tokens"].to_numpy(), capacity) + int(key) * 2**32)[["window_id", "doc_id", "part", "start_token", "n_tokens"]]

    n = max(1, min(shards, parts_for(counted)))
    return pieces.repartition(n, "shard").sortWithinPartitions("shard").mapInPandas(run, "window_id long, doc_id long, part long, start_token long, n_tokens long")


def p8_windows(spark: SparkSession, root: str) -> DataFrame:
    """An assignment of all documents to the windows of each capacity in `context_windows`."""
    counted = materialize(count_tokens(table(spark, root, "documents")), "tokens")
    sizes = table(spark, root, "context_windows").select("window_name", "capacity_tokens").dropna().distinct().limit(1_001).collect()
    if len(sizes) > 1_000:
        raise ValueError("more than 1,000 capacities")
    out = None
    for name, capacity in sorted(tuple(r) for r in sizes if r["capacity_tokens"] > 0):
        one = pack(counted, int(capacity)).select(F.lit(name).alias("window_name"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "window_name string, window_id long, doc_id long, part long, start_token long, n_tokens long")
    return out

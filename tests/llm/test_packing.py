import random

import numpy as np
import pytest

from laborloom.llm.packing import best_fit, cost_of, count_tokens, encoder, most_pieces, p8_windows, pack
from tests.llm.tables import folder


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_constraints_and_fill(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(rng.lognormal(4, 1, 3000).astype(int), 512)
    w = best_fit(sizes, 512, most=20)
    load, count = np.bincount(w, sizes), np.bincount(w)
    assert load.max() <= 512 and count.max() <= 20 and count.min() >= 1
    assert len(load) <= np.ceil(sizes.sum() / 512) * 1.03 + 1  # the last windows are full of short pieces by their number
    assert best_fit(sizes, 512, most=10_000, cost=1e9).max() + 1 <= np.ceil(sizes.sum() / 512) * 1.005 + 1
    w = best_fit(sizes, 512, cost=0.25 * 512**2)
    assert np.bincount(w, cost_of(sizes, 512))[np.bincount(w) > 1].max() <= 0.25 * 512**2


def test_every_capacity_binds():
    # a piece that takes all tiles leaves no room for the cost of another, though tokens and number would fit
    assert best_fit(np.array([481, 31]), 512).max() == 1 and best_fit(np.array([480, 32]), 512).max() == 0
    assert np.bincount(best_fit(np.full(9, 161), 512, cost=2.9 * cost_of(161, 512))).max() == 2
    # many tiny pieces with a tile as small as they are: their number binds
    many = best_fit(np.full(64, 2), 512, cost=1e9)
    assert np.bincount(many).max() == most_pieces(512) == 16
    # pieces of whole tiles: tokens bind
    assert np.bincount(best_fit(np.full(12, 128), 512)).tolist() == [4, 4, 4]


def test_production_windows_keep_all_capacities(spark, tmp_path):
    rng = random.Random(6)
    docs = [(i, "word " * rng.choice([3, 20, 60, 200, 600])) for i in range(500)]
    path = folder(spark, tmp_path, documents=docs, context_windows=[("a", 512), ("b", 2048)])
    windows, full = {}, {"a": 512, "b": 2048}
    for r in p8_windows(spark, path).collect():
        windows.setdefault((r["window_name"], r["window_id"]), []).append(r["n_tokens"])
    for (name, _), sizes in windows.items():
        assert sum(sizes) <= full[name] and len(sizes) <= most_pieces(full[name]) and cost_of(sizes, full[name]).sum() <= cost_of(full[name], full[name])
    for name, capacity in full.items():
        used = [sum(s) for (n, _), s in windows.items() if n == name]
        assert sum(used) >= 0.95 * capacity * (len(used) - 1)


def test_ties_and_nothing():
    assert best_fit(np.array([], int), 10).tolist() == []
    assert best_fit(np.array([0, 0, 10]), 10, most=3).max() <= 1
    assert best_fit(np.array([5, 5, 5, 5]), 10).tolist() == [0, 0, 1, 1]


def test_round_trip(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice([0, 1, 7, 300, 1024, 1025, 5000])) for i in range(400)]
    df = spark.createDataFrame(docs + docs[:9], "doc_id long, n_tokens long")
    for shard in (50, 20_000):
        got = pack(df, 1024, shard).collect()
        spans = {}
        for r in got:
            spans.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
        assert set(spans) == {i for i, _ in docs}
        for i, n in docs:
            parts = sorted(spans[i])
            assert sum(x for _, x in parts) == n and [s for s, _ in parts] == list(range(0, max(n, 1), 1024))
            assert n > 1024 or len(parts) == 1  # split only if it alone exceeds the capacity
        load = {}
        for r in got:
            load[r["window_id"]] = load.get(r["window_id"], 0) + r["n_tokens"]
        assert max(load.values()) <= 1024


def test_query(spark, tmp_path):
    text = "Hello world. " * 700
    path = folder(spark, tmp_path, True, documents=[(1, text), (2, None), (3, ""), (4, "word"), (4, "word")], context_windows=[("a", 512), ("b", 8192), ("c", None), ("d", 0)])
    got = p8_windows(spark, path).collect()
    n = len(encoder().encode_ordinary(text))
    assert {r["window_name"] for r in got} == {"a", "b"}
    assert sum(r["n_tokens"] for r in got if r["window_name"] == "a" and r["doc_id"] == 1) == n
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4}
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(spark.read.parquet(f"{path}/documents.parquet")).collect()}[2] == 0
    assert p8_windows(spark, folder(spark, tmp_path / "e", documents=[], context_windows=[("a", 512)])).count() == 0

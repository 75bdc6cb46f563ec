import random

import pytest

from pyspark.sql import functions as F

from laborloom.llm import history, segments
from laborloom.llm.history import first_rows
from laborloom.llm.segments import History
from tests.llm.tables import SCHEMAS, folder
from tests.llm.test_history import advert, reword, row


def frame(spark, rows):
    names = [c.split()[0] for c in SCHEMAS["raw_ingested_jobs"].split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMAS["raw_ingested_jobs"])


@pytest.mark.parametrize("fan", [2])
def test_batch_by_batch_equals_all_at_once(spark, tmp_path, fan):
    rng = random.Random(fan)
    rows, kept = [], []
    for i in range(80):
        if kept and rng.random() < 0.45:
            old = rng.choice(kept)
            words = old["description"].split()
            new = row(i, " ".join(reword(rng, words) if rng.random() < 0.5 else words), ext=old["external_id"])
            if rng.random() < 0.2:
                new["city"] = None
        else:
            new = row(i, " ".join(advert(rng)), city=rng.choice(["Mesa", "Yuma"]) if rng.random() > 0.1 else None)
            kept.append(new)
        if new["city"] is not None and new not in kept:
            new["city"] = next(k["city"] for k in kept if k["external_id"] == new["external_id"]) or "Mesa"
        rows.append(new)
    want = {r["id"]: r["first_id"] for r in first_rows(frame(spark, rows)).collect()}
    h = History(spark, f"file://{tmp_path}/h", fan=fan)
    got = {}
    for at in range(0, 80, 20):
        got.update((r["id"], r["first_id"]) for r in h.append(frame(spark, rows[at : at + 20])).collect())
    assert got == want
    assert sum(map(len, h.segments().values())) <= 3
    assert h.append(frame(spark, [])).count() == 0


def test_writers_exclude_each_other_and_unfinished_batches_are_not_seen(spark, tmp_path):
    h = History(spark, f"file://{tmp_path}/h")
    h.append(frame(spark, [row(1, "a b c d e f g h")]))
    before, version = h.parts(), h._version()
    h._write(0, 1, spark.createDataFrame([], "block binary, text binary, first_id long"), spark.createDataFrame([], "board binary, first_id long, lost boolean"), spark.createDataFrame([], "block long, gid long, first_id long, words array<int>"))
    assert h.parts() == before  # files without a list are nothing
    h._commit(before, version + 1)
    with pytest.raises(RuntimeError):
        h._commit(before, version + 1)
    assert [tuple(r) for r in h.append(frame(spark, [row(2, "A b c d e f g h!")])).collect()] == [(2, 1)]


def test_a_batch_reads_its_own_buckets_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "PER_BUCKET", 8)
    rng = random.Random(3)
    h = History(spark, f"file://{tmp_path}/h", fan=100)
    texts = {c: " ".join(advert(rng)) for c in (f"city{i}" for i in range(60))}
    h.append(frame(spark, [row(i, t, city=c) for i, (c, t) in enumerate(texts.items())]))
    part = h.parts()[0]
    assert part.bits >= 3
    keyed = history.with_keys(frame(spark, [row(900, texts["city7"], city="city7")]))
    touched = h._touched(keyed.select(F.xxhash64("block").alias("h")), [part])
    read = h._read(part, "arrays", touched)
    assert len(read.inputFiles()) > 0 and sum(len(r["gid"]) for r in read.collect()) < 25
    reworded = reword(rng, texts["city7"].split())
    got = h.append(frame(spark, [row(900, " ".join(reworded), city="city7"), row(901, " ".join(reworded), city="city8")])).collect()
    assert {tuple(r) for r in got} == {(900, 7), (901, 901)}


def test_batches_equal_one_pass(spark, tmp_path):
    rng = random.Random(5)
    rows, texts = [], [advert(rng) for _ in range(15)]
    for i in range(60):
        t = rng.choice(texts)
        rows.append(row(i, " ".join(reword(rng, t) if rng.random() < 0.5 else t), run=f"r{i // 12}"))
    path = folder(spark, tmp_path, raw_ingested_jobs=rows)
    one, steps = (sorted(tuple(r) for r in f(spark, path).collect()) for f in (history.p6_found, segments.p6_batches))
    assert one and one == steps
    assert segments.p6_batches(spark, folder(spark, tmp_path / "e", raw_ingested_jobs=[])).count() == 0

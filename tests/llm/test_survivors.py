import random

import pytest

from laborloom.llm.survivors import p1_found, p1_survivors
from tests.llm.tables import SOURCES, folder


def row(i, ext="e", title="t", company="c", source="alpha", pay=None, posted=None, ingested="2024-01-01"):
    return {"job_id": i, "external_id": ext, "title": title, "company": company, "source": source, "salary_min": pay, "date_posted": posted, "date_ingested": ingested}


def found(spark, path, rows, extra=False):
    return sorted(tuple(r) for r in p1_found(spark, folder(spark, path, extra, job_records=rows, job_sources=SOURCES)).collect())


def test_rules(spark, tmp_path):
    rows = [
        row(5, source=" Alpha ", ingested="2024-01-02"),
        row(6, source="ALPHA", ingested="2024-01-03"),
        row(7, ext=" E ", title="T", company="C\t", source="beta", ingested="2024-02-01", pay=10.0, posted="2024-01-05"),
        row(8, source="alpha", ingested="2023-01-01", pay=float("nan"), posted="5 days ago"),
        row(9, ext="alone"), row(10, ext=None), row(11, ext=None), row(None),
    ]
    assert found(spark, tmp_path, rows) == [(5, 6, 7, 7)]


def test_nothing_readable_and_ties(spark, tmp_path):
    rows = [row(2, source=None, pay=0.0, posted="ASAP", ingested=None), row(1, source="nobody", pay=-1.0, ingested="x"), row(1, source="nobody", pay=-1.0, ingested="x")]
    assert found(spark, tmp_path, rows, extra=True) == [(1, 1, 0, 0)]


def test_empty(spark, tmp_path):
    path = folder(spark, tmp_path, job_records=[], job_sources=[])
    assert p1_found(spark, path).count() == 0 and p1_survivors(spark, path).count() == 0


def brute(rows):
    rank = {s: r for s, r, *_ in SOURCES}
    groups = {}
    for r in rows:
        groups.setdefault(r["external_id"], []).append(r)
    out = []
    for g in groups.values():
        if len(g) > 1:
            order = sorted(g, key=lambda r: (rank.get(r["source"], 99), [-ord(c) for c in r["date_ingested"]], r["job_id"]))
            pay = [r["job_id"] for r in order if r["salary_min"]]
            dated = sorted((r for r in g if r["date_posted"]), key=lambda r: ([-ord(c) for c in r["date_posted"]], rank.get(r["source"], 99), r["job_id"]))
            out.append((min(r["job_id"] for r in g), order[0]["job_id"], pay[0] if pay else 0, dated[0]["job_id"] if dated else 0))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    day = lambda: f"2024-01-{rng.randint(1, 9):02d}"
    rows = [row(i, ext=f"e{0 if rng.random() < 0.3 else rng.randint(1, 40)}", source=rng.choice(["alpha", "none"]), pay=rng.choice([None, 5.0]), posted=rng.choice([None, day() + "T00:00:00Z"]), ingested=day()) for i in range(150)]
    assert found(spark, tmp_path, rows) == brute(rows)


def test_votes_are_summed(spark, tmp_path):
    rows = [row(1, source="alpha", pay=1.0), row(2, source="beta", pay=2.0), row(3, source="beta", pay=2.0), row(4, source="beta", pay=2.0)]
    r = p1_survivors(spark, folder(spark, tmp_path, job_records=rows, job_sources=SOURCES)).collect()[0]
    assert (r["group_id"], r["n"], r["source"], r["salary_min"]) == (1, 4, "beta", 2.0)  # three votes of a quarter beat one of a half

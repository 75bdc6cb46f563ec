import datetime as dt
import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from laborloom.functions import dates, labels, money, text, vectors
from laborloom.plans import evidence


def one(spark, values, schema, expr):
    return [r["o"] for r in spark.createDataFrame(values, schema).select(expr.alias("o")).collect()]


def test_text(spark):
    assert one(spark, [("<p>a</p>b  c ",), (None,)], "x string", text.clean_text(F.col("x"))) == ["ab c", ""]
    assert one(spark, [("<p>a</p>b",)], "x string", text.tags_to_blanks(F.col("x"))) == ["a b"]
    assert one(spark, [("Acme Corp., Inc.",), ("Foo Co",), ("Inc",)], "x string", text.company_key(F.col("x"))) == ["acme", "foo", "inc"]
    assert one(spark, [("Ｆｕｌｌ  Ａ",)], "x string", text.normal_label(F.col("x"))) == ["full a"]
    assert one(spark, [("Ciudad  Juárez",)], "x string", text.fold_accents(F.col("x"))) == ["ciudad juarez"]
    want = hashlib.sha256(b"a|none|b").hexdigest()
    assert one(spark, [(" A ", None, "B")], "x string, y string, z string", text.digest(F.col("x"), F.col("y"), F.col("z"))) == [want]
    assert one(spark, [(["b", "A", "a", " "],)], "x array<string>", text.stable_unique(F.col("x"))) == [["A", "b"]]


def test_money(spark):
    mid = money.midpoint(F.col("a"), F.col("b"))
    assert one(spark, [(1.0, 3.0), (None, 3.0), (1.0, None), (float("nan"), None)], "a double, b double", mid) == [2.0, 3.0, 1.0, None]
    y = money.yearly(F.col("a"), F.col("p"))
    assert one(spark, [(10.0, "Hourly "), (1.0, "mo"), (5.0, None), (-1.0, "yr"), (0.0, None)], "a double, p string", y) == [20800.0, 12.0, 5.0, None, None]
    p = [tuple(r) if r else None for r in one(spark, [("$120k - $160k",), ("$50/hr",), ("€80-90 per year",), ("",), (None,), ("DOE",)], "x string", money.parse_pay(F.col("x")))]
    assert p[0] == (120000.0, 160000.0, "USD", "annual")
    assert p[1] == (50.0, 50.0, "USD", "hourly")
    assert p[2] == (80000.0, 90000.0, "EUR", "annual")
    assert p[3] is None and p[4] is None and p[5] == (None, None, None, None)


def test_dates(spark):
    days = [(dt.datetime(2022, 11, 30, 23),), (dt.datetime(2022, 12, 1),), (dt.datetime(2023, 3, 31),), (dt.datetime(2023, 4, 1),), (dt.datetime(2024, 5, 31),), (dt.datetime(2024, 6, 1),), (None,)]
    assert one(spark, days, "x timestamp", dates.era_of(F.col("x"))) == ["pre_chatgpt", "early_genai", "early_genai", "post_gpt4", "post_gpt4", "agentic_era", None]
    assert one(spark, [(30,), (31,), (90,), (91,), (None,)], "x int", dates.freshness(F.col("x"))) == ["fresh", "stale", "stale", "expired", None]
    changes = [(float("nan"),), (float("inf"),), (float("-inf"),), (0.2,), (-0.2,), (0.03,), (0.10,), (None,)]
    assert one(spark, changes, "x double", dates.trend(F.col("x"))) == ["emerging", "accelerating", "declining", "accelerating", "declining", "stable", "volatile", "emerging"]
    assert one(spark, changes[:3], "x double", dates.finite(F.col("x"))) == [0.0, 0.0, 0.0]
    assert dates.default_week(dt.date(2026, 4, 22)) == dt.date(2026, 4, 13)
    assert dates.as_week("2026-04-15", dt.date(2026, 5, 1)) == dt.date(2026, 4, 13)
    assert dates.as_week("rubbish", dt.date(2026, 4, 22)) == dt.date(2026, 4, 13)


def test_labels(spark):
    assert one(spark, [("N'full-time'",), ("Term",), (" FT ",), ("other",), ("intermittent",)], "x string", labels.employment_type(F.col("x"))) == ["full_time", "temporary", "full_time", "unknown", "part_time"]
    assert one(spark, [(0.699,), (0.7,), (0.9,), (0.901,)], "x double", labels.spam_tier(F.col("x"))["tier"]) == ["clean", "flagged", "flagged", "rejected"]
    s = labels.seniority(F.col("l"), F.col("t"), F.lit(None).cast("string"))
    assert one(spark, [("ASSOCIATE", "x"), (None, "Sr. Cook"), (None, "Data Analyst"), (None, "Cook"), (None, "VP of Sales")], "l string, t string", s) == ["junior", "senior", "mid", "unknown", "executive"]
    sub = labels.subregion(F.col("c"), F.col("s"), F.col("n"), F.col("r"))
    places = [("El Paso", "TX", "US", None), ("El Paso", "TX", "US", True), ("Ciudad Juárez", None, "Mexico", False), ("El Paso", None, None, None), ("Las Cruces", "New Mexico", "", None)]
    assert one(spark, places, "c string, s string, n string, r boolean", sub) == ["el_paso", "regional", "ciudad_juarez", "regional", "las_cruces"]


def test_vectors(spark):
    df = [([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])]
    assert one(spark, df, "a array<double>, b array<double>", F.round(vectors.cosine(F.col("a"), F.col("b")), 9)) == [1.0, 0.0, 0.0]
    assert one(spark, [("[1, 2.5]",), ("no",)], "x string", vectors.parse_vector(F.col("x"))) == [[1.0, 2.5], None]


def test_evidence():
    assert evidence.volume([{"posting_count": 3}, {"posting_count": 7}]) == 7
    assert evidence.volume([]) is None and evidence.sufficiency(0) == "no_data" and evidence.sufficiency(30) == "adequate"
    assert evidence.confidence(0.4, 100, 1.0) == 0.4
    assert evidence.ordered_periods(["2025-Q1", "2024-12", "2024"]) == ["2024", "2024-12", "2025-Q1"]
    assert evidence.ungrounded("About 1,003 jobs, 57 new", "1000 jobs") == ["57"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="0123456789-WwQq ", max_size=10), max_size=6))
def test_periods_never_fail(periods):
    assert sorted(evidence.ordered_periods(periods)) == sorted(set(periods))

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from laborloom.functions.temporal import read_shape
from laborloom.operators.timestamps import normalise_times, p4_found, shape_dictionary, with_instant

UTC = dt.timezone.utc


def ms(*a, zone="UTC", fold=0, cut=0):
    return int(dt.datetime(*a, tzinfo=ZoneInfo(zone), fold=fold).timestamp()) * 1000 + cut


CASES = [
    ("2024-01-31T10:57:50Z", None, None, ms(2024, 1, 31, 10, 57, 50)),
    ("2024-01-31 10:57:50.123999 UTC", None, None, ms(2024, 1, 31, 10, 57, 50, cut=123)),
    ("2024-01-14T21:16:18-07:00[America/Denver]", None, None, ms(2024, 1, 15, 4, 16, 18)),
    ("2024-04-27T18:54:11-0530", None, None, ms(2024, 4, 28, 0, 24, 11)),
    ("Tue, 23 Sep 2025 21:53:14 -0600", None, None, ms(2025, 9, 24, 3, 53, 14)),
    ("1757591578", None, None, 1757591578000),
    ("1746514027815", None, None, 1746514027815),
    ("11/15/2024 5:05 P.M.", "America/Chicago", "mdy", ms(2024, 11, 15, 23, 5)),
    ("01/09/2025 12:09 am", "UTC", "mdy", ms(2025, 1, 9, 0, 9)),
    ("31/03/2023 13:36", "Europe/London", "dmy", ms(2023, 3, 31, 12, 36)),
    ("05-04-25", "UTC", "dmy", ms(2025, 4, 5)),
    ("05-04-25", "UTC", "mdy", ms(2025, 5, 4)),
    ("12.10.2023 17:55", "Europe/Berlin", "dmy", ms(2023, 10, 12, 15, 55)),
    ("25 de noviembre de 2024", "America/Bogota", "dmy", ms(2024, 11, 25, 5)),
    ("30. März 2025", "Europe/Berlin", "dmy", ms(2025, 3, 29, 23)),
    ("September 17, 2025", "America/New_York", "mdy", ms(2025, 9, 17, 4)),
    ("16 Nov 2025, 7:27 pm MST", "Asia/Kolkata", "dmy", ms(2025, 11, 17, 2, 27)),
    ("2024-08-09 04:31 IST", "Europe/London", "dmy", ms(2024, 8, 8, 23, 1)),
    ("2024-03-23 04:53 GMT-5", "UTC", "dmy", ms(2024, 3, 23, 9, 53)),
    # a local time that occurs twice means the first, one that was skipped is read with the offset before the change
    ("2024-11-03 01:30:00", "America/New_York", "mdy", ms(2024, 11, 3, 5, 30)),
    ("2024-03-10 02:30:00", "America/New_York", "mdy", ms(2024, 3, 10, 7, 30)),
    ("2024-10-27 02:30", "Europe/Berlin", "dmy", ms(2024, 10, 27, 0, 30)),
    *[(x, "UTC", "mdy", None) for x in ("13/32/2024", "2024-02-30", "0000-00-00", "", "  ", "N/A", "ASAP", "13/04/2024", "2024-01-01 25:00", "01/01/2024 13:00 pm", None)],
    ("2024-01-01", None, None, None),
]


def test_forms(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, raw string, zone string, order string")
    got = {r["i"]: r["ms"] for r in with_instant(df, "raw", "zone", "order", "ms", "age").collect()}
    wrong = [(c, got[i]) for i, c in enumerate(CASES) if got[i] != c[3]]
    assert not wrong


def test_ages(spark):
    texts = ["3 days ago", "Posted 17 days ago", "4d ago", "34 hours ago", "1 hour ago", "5 minutes ago", "recently"]
    df = spark.createDataFrame([(t, "UTC", "mdy") for t in texts], "raw string, zone string, order string")
    got = {r["raw"]: r["age"] for r in with_instant(df, "raw", "zone", "order", "ms", "age").collect()}
    assert [got[t] for t in texts] == [259_200_000, 1_468_800_000, 345_600_000, 122_400_000, 3_600_000, 300_000, None]


def rows(spark, data):
    return spark.createDataFrame(data, "job_id long, raw string, zone string, date_order string, base string, utc_ms string")


def test_normalise_keeps_rows_and_reads_ages(spark):
    data = [(1, "2 days ago", "UTC", "mdy", "2024-01-03T00:00:00", "x"), (1, "2 days ago", "UTC", "mdy", "2024-01-03T00:00:00", "x"), (2, None, "UTC", "mdy", None, "x"), (3, "nonsense", "", "", None, "x"), (4, "2 days ago", "UTC", "mdy", None, "x")]
    got = sorted(((r["job_id"], r["utc_ms"]) for r in normalise_times(rows(spark, data)).collect()), key=str)
    day = ms(2024, 1, 1)
    assert got == sorted([(1, day), (1, day), (2, None), (3, None), (4, None)], key=str)
    assert normalise_times(rows(spark, [])).count() == 0


def test_dictionary_grows(spark, tmp_path):
    store = str(tmp_path / "d")
    a = rows(spark, [(1, "2024-01-01", "UTC", "mdy", None, None), (2, "1999-12-31", "", "dmy", None, None)])
    b = rows(spark, [(1, "2024-01-01", "UTC", "mdy", None, None), (2, "3 days ago", "UTC", "mdy", "2024-01-01 10:00", None)])
    assert shape_dictionary(a, ["raw", "base"], store).count() == 1
    assert shape_dictionary(b, ["raw", "base"], store).count() == 3
    assert spark.read.parquet(store).groupBy("shape").count().filter("count > 1").count() == 0
    assert sorted(r["utc_ms"] for r in normalise_times(b, store).collect()) == [ms(2023, 12, 29, 10), ms(2024, 1, 1)]


def test_shapes():
    assert read_shape("9999-99-99t99:99:99.999+9999")["packed"] and read_shape("99.99.9999")["either"] is False
    assert read_shape("nonsense")["kind"] is None and read_shape("")["kind"] is None
    assert read_shape("9 weeks ago")["unit"] == 604_800_000 and read_shape("9" * 13)["kind"] == "epoch"


def test_plan_is_compiled(spark):
    plan = p4_found(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 60_000  # the expression once grew beyond what the compiler takes


def test_query(spark):
    out = p4_found(spark, "/root/testdata/sf0.001")
    assert out.dtypes == [("job_id", "bigint"), ("field_name", "string"), ("utc_ms", "bigint")]
    assert out.filter(F.col("field_name") == "date_ingested").count() == 200


@pytest.mark.parametrize("year", [2023, 2025])
def test_against_zoneinfo(spark, year):
    zones = ["America/New_York", "Europe/London", "Asia/Kolkata", "America/Phoenix"]
    data = []
    for z in zones:
        t = dt.datetime(year, 1, 1)
        while t.year == year:
            data.append((t.strftime("%Y-%m-%d %H:%M:%S"), z, "mdy", int(t.replace(tzinfo=ZoneInfo(z)).timestamp() * 1000)))
            t += dt.timedelta(hours=37, minutes=13)
    df = spark.createDataFrame(data, "raw string, zone string, order string, want long")
    assert with_instant(df, "raw", "zone", "order", "ms").filter(~F.col("ms").eqNullSafe(F.col("want"))).count() == 0

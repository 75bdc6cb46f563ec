import pytest

from laborloom.operators.units import PER_YEAR, decimal_mark, p2_found, read_shape, segment, to_common_unit

RATES = [("USD", 1.0), ("EUR", 1.1), ("GBP", 1.25), ("CAD", 0.75), ("INR", 0.012), ("COP", 0.00025)]
CASES = [
    ("$ 315 USD per day", None, None, 315 * 260, 315 * 260),
    ("£11.68-£14.37", None, "hourly", 11.68 * 2080 * 1.25, 14.37 * 2080 * 1.25),
    ("€ 80.500 – € 99.500", None, "p.a.", 80500 * 1.1, 99500 * 1.1),
    ("1,800 to 2,150", "usd", "bi-weekly", 1800 * 26, 2150 * 26),
    ("COP $4.400.000 mensuales", None, None, 4.4e6 * 12 * 0.00025, 4.4e6 * 12 * 0.00025),
    ("₹22.8 Lacs p.a.", None, None, 2.28e6 * 0.012, 2.28e6 * 0.012),
    ("67-79.5k/yr", "USD", None, 67000, 79500),
    ("$141k", None, "yr", 141000, 141000),
    ("106 – 109k", "US Dollar", "annual", 106000, 109000),
    ("2 700 - 2 850 € mtl.", None, None, 2700 * 12 * 1.1, 2850 * 12 * 1.1),
    ("$57,500 – $70,000 p.a. (sign-on bonus $2,000)", None, None, 57500, 70000),
    ("98.500 – 121.000 € p. a. + 401k", None, None, 98500 * 1.1, 121000 * 1.1),
    ("$27 p/h", "CAD", None, 27 * 2080 * 0.75, 27 * 2080 * 0.75),
    ("1,80,000", "₹", "MONTH", 180000 * 12 * 0.012, 180000 * 12 * 0.012),
    ("13.85 bis 16.40 €", None, "hr", 13.85 * 2080 * 1.1, 16.4 * 2080 * 1.1),
    ("COP 2,7-3,3 millones", None, "mensual", 2.7e6 * 12 * 0.00025, 3.3e6 * 12 * 0.00025),
    ("Up To $9,300 pcm", None, None, 9300 * 12, 9300 * 12),
    ("$21.500 por hora", "Pesos (CO)", None, 21500 * 2080 * 0.00025, 21500 * 2080 * 0.00025),
    ("99kusd/year", None, None, 99000, 99000), ("99 kusd per year", None, None, 99000, 99000), ("99 teur p.a.", None, None, 99000 * 1.1, 99000 * 1.1), ("80-99k€ / yr", None, None, 80000 * 1.1, 99000 * 1.1),
    ("900 usd / 2 weeks", None, None, 900 * 26, 900 * 26), ("1,200 eur per 3 months", None, None, 1200 * 4 * 1.1, 1200 * 4 * 1.1), ("99 usd h^-1", None, None, 99 * 2080, 99 * 2080), ("usd 20-30 h⁻¹", None, None, 20 * 2080, 30 * 2080),
    ("between 20 and 30 usd hourly", None, None, 20 * 2080, 30 * 2080), ("99 usd / 0 weeks", None, None, None, None),
    *[(x, c, p, None, None) for x, c, p in (("DOE", "USD", "hr"), ("Great pay & 401(k) match", "USD", "yr"), ("Up to 15% bonus", "USD", "yr"), ("$13.75", None, None), ("13.75", None, "hr"), (None, "USD", "yr"), ("", "USD", "yr"), ("$$$", "USD", "yr"))],
]


def test_cases(spark):
    df = spark.createDataFrame([(i, *c[:3], "z") for i, c in enumerate(CASES)], "i int, raw string, cur string, per string, low string")
    out = to_common_unit(df.withColumnRenamed("low", "other"), spark.createDataFrame(RATES, "currency string, usd_per_unit double"), "raw", "cur", "per", "low", "high").collect()
    got = {r["i"]: (r["low"], r["high"]) for r in out}
    assert len(out) == len(CASES)
    for i, (text, _, _, low, high) in enumerate(CASES):
        want = (None, None) if low is None else (round(low), round(high))
        assert got[i] == want, text


def test_empty_and_unknown_currency(spark):
    df = spark.createDataFrame([], "raw string, cur string, per string")
    rates = spark.createDataFrame([("EUR", 1.1)], "currency string, usd_per_unit double")
    assert to_common_unit(df, rates, "raw", "cur", "per", "l", "h").count() == 0
    one = spark.createDataFrame([("$5 an hour", None, None)], "raw string, cur string, per string")
    assert to_common_unit(one, rates, "raw", "cur", "per", "l", "h").collect()[0]["l"] is None


def test_segmentation_prefers_the_field():
    assert [p[1] for p in segment("h", {"time": 1.5, "money": 0.2})] == ["hour"]
    assert [p[0] for p in segment("12k/yr", {"money": 1, "time": 1, "scale": 1, "joint": 1})] == ["number", "scale", "joint", "time"]


@pytest.mark.parametrize(("number", "scaled", "mark"), [("80.500", False, None), ("13.85", False, "."), ("13,2", False, ","), ("1.234,56", False, ","), ("1,234.5", False, "."), ("1,80,000", False, None), ("2.125", True, "."), ("7", False, None)])
def test_decimal_marks(number, scaled, mark):
    assert decimal_mark(number, scaled) == mark


def test_periods_are_complete():
    assert PER_YEAR == {"hour": 2080, "day": 260, "week": 52, "fortnight": 26, "month": 12, "year": 1}
    assert read_shape("9" * 5000 + " $")["currency"] == "$"


def test_query(spark):
    out = p2_found(spark, "/root/testdata/sf0.001")
    assert out.dtypes == [("job_id", "bigint"), ("usd_year_low", "bigint"), ("usd_year_high", "bigint")]
    assert out.filter("usd_year_low > usd_year_high").count() == 0
    assert out.count() > 50

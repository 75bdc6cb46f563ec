"""Quantities in different units and scales: unit strings segmented over tries, values converted to one unit.

A text's *shape* is the text with every digit replaced by 9, so that shapes are few however many rows there are.
Each distinct shape is segmented once, in Python; the numbers of the rows are converted in built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, table

#: Hours and other periods in a year of 2,080 hours.
PER_YEAR = {"hour": 2080.0, "day": 260.0, "week": 52.0, "fortnight": 26.0, "month": 12.0, "year": 1.0}

# The written forms of each root, by dimension and meaning.
ROOTS = {
    ("money", "USD"): "usd|us dollar|us dollars|us$|dollars us",
    ("money", "$"): "$|dollar|dollars",
    ("money", "EUR"): "eur|euro|euros|€",
    ("money", "GBP"): "gbp|£|pound|pounds|pound sterling|pounds sterling",
    ("money", "CAD"): "cad|c$|ca$|cdn$|canadian dollar|canadian dollars",
    ("money", "INR"): "inr|₹|rs|rs.|rupee|rupees",
    ("money", "COP"): "cop|col$|pesos (co)|peso colombiano|pesos colombianos",
    ("time", "hour"): "h|hr|hrs|hour|hours|hourly|p/h|hora|horas|stunde|std|std.|stündlich|heure",
    ("time", "day"): "d|day|days|daily|diem|per diem|día|dia|diario|tag|tagessatz|täglich|jour",
    ("time", "week"): "w|wk|wks|week|weeks|weekly|semana|semanal|woche|wöchentlich|semaine",
    ("time", "fortnight"): "bi-weekly|biweekly|fortnight|fortnightly|every two weeks|every 2 weeks|quincenal|quincena",
    ("time", "month"): "m|mo|mos|mon|month|months|monthly|pcm|mensual|mensuales|mes|monat|monatlich|mtl|mtl.|mois",
    ("time", "year"): "y|yr|yrs|year|years|yearly|annual|annually|annum|p.a.|p. a.|pa|año|anual|anuales|jahr|jährlich|jahrlich|an|anno",
}
# Prefixes of scale. They multiply the number that they follow, or, glued to a root, that root.
SCALES = {1e3: "k|thousand|mil|tausend|tsd|tsd.", 1e5: "l|lakh|lakhs|lac|lacs", 1e6: "m|mm|mio|mio.|million|millions|millón|millones|millionen", 1e7: "cr|crore|crores"}
#: Prefixes that stand only glued to a root, as in "teur".
GLUED = {1e3: "t", 1e6: "m"}
# Exponents after a root.
EXPONENTS = {-1: "⁻¹|^-1"}
# Joints of a unit; "per" turns the exponent of what follows to -1.
JOINTS = {"per": "/|per|a|an|pro|por|al|à|je|par|each", "range": "-|–|—|to|bis|a|hasta|until|through|y|und|and", "none": "from|up to|upto|ab|bis zu|desde|hasta|base pay|base|pay|salary|:|ca.|approx.|brutto|gross|plus|+|benefits|and|&|,|~"}

_NUMBER = r"\d{1,3}(?:[.,' ]\d{2,3})+(?:[.,]\d{1,2})?(?!\d)|\d+(?:[.,]\d+)?"
_EXTRAS = re.compile(r"\([^()]*(?:bonus|sign|extra|prämie|bono)[^()]*\)|[+&]\s*pension\b.*$|\bpension(?:\s*match)?|(?:up to\s*)?\d+(?:[.,]\d+)?\s*%(?:\s*bonus)?|plus (?:benefits|bonus)\b", re.I)


class Trie:
    """Character trie; every entry has (kind, meaning) pairs."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, kind: str, meaning) -> None:
        node = self.root
        for ch in word:
            node = node.setdefault(ch, {})
        node.setdefault("", []).append((kind, meaning))

    def from_(self, text: str, i: int) -> Iterator[tuple[int, str, object]]:
        """(end, kind, meaning) of every entry that starts at text[i]."""
        node = self.root
        for j in range(i, len(text)):
            node = node.get(text[j])
            if node is None:
                return
            for kind, meaning in node.get("", ()):
                yield j + 1, kind, meaning


@lru_cache(1)
def unit_trie() -> Trie:
    t = Trie()
    for (dimension, meaning), words in ROOTS.items():
        for w in words.split("|"):
            t.add(w, dimension, meaning)
    for factor, words in SCALES.items():
        for w in words.split("|"):
            t.add(w, "scale", factor)
    for factor, words in GLUED.items():
        for w in words.split("|"):
            t.add(w, "glued", factor)
    for power, words in EXPONENTS.items():
        for w in words.split("|"):
            t.add(w, "exponent", power)
    for what, words in JOINTS.items():
        for w in words.split("|"):
            t.add(w, "joint", what)
    return t


def segment(text: str, prior: dict[str, float], trie: Trie | None = None) -> list[tuple[str, object, int, int]]:
    """The best division of `text` into numbers, prefixes, roots, exponents and joints, by dynamic programming.

    Parts are (kind, meaning, start, end), kind "number", "scale", "money", "time", "exponent" or "joint". A part's score is
    its length times its dimension's prior in this field; letters that no entry covers cost one each. A word must end at
    a word's boundary, except for a prefix right after a number and a prefix glued to a root of money; a prefix that isn't
    glued must follow a number, an exponent a root, and a unit of one letter must follow "per" or a number, or have an exponent,
    unless it is the whole text. Ties go to the longer part.
    """
    trie = trie or unit_trie()
    s = text.lower()
    n = len(s)
    numbers = {m.start(): m.end() for m in re.finditer(_NUMBER, s)}
    #: best[i][state]: score and parts of s[:i]; the state says what came last: number, per, range, prefix, time, or anything else.
    best: list[dict[str, tuple[float, tuple]]] = [{} for _ in range(n + 1)]
    best[0]["other"] = (0.0, ())

    def put(i: int, state: str, score: float, parts: tuple) -> None:
        old = best[i].get(state)
        if old is None or score > old[0] + 1e-9 or (abs(score - old[0]) <= 1e-9 and len(parts) < len(old[1])):
            best[i][state] = (score, parts)

    def powered(i: int) -> bool:
        return any(kind == "exponent" for _, kind, _ in trie.from_(s, i))

    def ends_word(end: int) -> bool:
        return not (s[end - 1].isalpha() and end < n and s[end].isalpha())

    for i in range(n):
        for state, (score, parts) in list(best[i].items()):
            if state == "prefix":  # only the root that it is glued to may follow
                for end, kind, meaning in trie.from_(s, i):
                    if kind == "money" and ends_word(end):
                        put(end, "other", score + (end - i) * prior.get("money", 0.5), (*parts, (kind, meaning, i, end)))
                continue
            if s[i].isspace():
                put(i + 1, state, score, parts)
                continue
            if i in numbers:
                put(numbers[i], "number", score + 2.0 + (0.5 if state == "range" else 0.0), (*parts, ("number", None, i, numbers[i])))
                continue
            if s[i].isdigit():
                put(i + 1, "other", score, parts)
                continue
            put(i + 1, "other", score - 1.0 * s[i].isalpha(), parts)
            inside = i > 0 and s[i - 1].isalpha() and s[i].isalpha()
            for end, kind, meaning in trie.from_(s, i):
                size = end - i
                if kind == "exponent":
                    if state == "time":
                        put(end, "other", score + size * prior.get("time", 0.5) + 1.0, (*parts, (kind, meaning, i, end)))
                    continue
                if inside:
                    continue
                if kind in ("scale", "glued") and end < n and s[end].isalpha() and s[end - 1].isalpha():
                    put(end, "prefix", score + size * prior.get("scale", 0.5) + 0.25, (*parts, ("scale", meaning, i, end)))
                    continue
                if kind == "glued" or not ends_word(end) or (kind == "scale" and state != "number"):
                    continue
                if kind == "time" and size == 1 and not (state == "per" or (size == n and i == 0) or powered(end)):
                    continue
                joint = meaning if kind == "joint" else None
                after = "number" if kind == "money" and state == "number" else "time" if kind == "time" else joint if joint in ("per", "range") else "other"
                gain = size * prior.get(kind, 0.5) + (0.5 if state == "per" and kind == "time" else 0.0) + (0.25 if kind == "scale" else 0.0)
                put(end, after, score + gain, parts if joint == "none" else (*parts, (kind, meaning, i, end)))
    ends = {k: v for k, v in best[n].items() if k != "prefix"}
    return list(max(ends.values(), key=lambda x: (x[0], -len(x[1])))[1]) if ends else []


#: Priors of the dimensions by field: how likely a unit of that dimension is to stand there.
PRIORS = {
    "raw": {"money": 1.2, "time": 1.1, "scale": 1.1, "joint": 0.9},
    "currency": {"money": 1.5, "time": 0.2, "scale": 0.1, "joint": 0.2},
    "period": {"money": 0.2, "time": 1.5, "scale": 0.1, "joint": 0.9},
}


def decimal_mark(number: str, scaled: bool) -> str | None:
    """The decimal mark of a number as written: "." or "," or None; the other marks and spaces group digits.

    One mark before exactly three digits groups, several of a kind group, and of two kinds the last is decimal;
    before a word of scale a single mark is decimal.
    """
    marks = re.findall(r"[.,]", number)
    tail = re.search(r"[.,](\d+)$", number)
    if not marks or not tail:
        return None
    last = marks[-1]
    if len(set(marks)) == 2:
        return last if marks.count(last) == 1 else None
    if len(marks) > 1:
        return None
    return last if len(tail[1]) != 3 or (scaled and len(number.split(last)[0]) == 1) else None


def read_shape(text: str) -> dict:
    """What a pay text's shape says: which of its numbers are the pay's ends, their marks and scales, and the unit.

    Keys low, high: number's index from 0, or None without pay; low_mark, high_mark; low_scale, high_scale;
    currency ("$" for a bare dollar sign), period, and periods, the index of the number of them ("every 2 weeks"). Extras such
    as bonuses are masked first, and a number that no word of money, time, scale or range ties to the first one doesn't count.
    """
    none = {"low": None, "high": None, "low_mark": None, "high_mark": None, "low_scale": 1.0, "high_scale": 1.0, "currency": None, "period": None, "periods": None}
    positions = [m.start() for m in re.finditer(_NUMBER, text)]
    masked = _EXTRAS.sub(lambda m: "\x00" * len(m[0]), text)
    parts = segment(masked, PRIORS["raw"])
    out = dict(none)
    money = [p[1] for p in parts if p[0] == "money"]
    named = [m for m in money if m != "$"]
    out["currency"] = named[0] if named else "$" if money else None
    time = next((k for k, p in enumerate(parts) if p[0] == "time"), None)
    out["period"] = parts[time][1] if time is not None else None
    counts = set()  # numbers of periods, as in "per 2 weeks", are no amounts
    if time is not None and time > 1 and parts[time - 1][0] == "number" and parts[time - 2][:2] == ("joint", "per"):
        counts.add(time - 1)
        out["periods"] = positions.index(parts[time - 1][2])
    numbers = [k for k, p in enumerate(parts) if p[0] == "number" and k not in counts]
    if not numbers:
        return out

    def scale_of(k: int) -> float:
        for kind, meaning, *_ in parts[k + 1 :]:
            if kind == "scale":
                return meaning
            if kind in ("number", "time"):
                return 1.0
        return 1.0

    first = numbers[0]
    ranged = len(numbers) > 1 and any(p[:2] == ("joint", "range") for p in parts[first + 1 : numbers[1]])
    second = numbers[1] if ranged else None
    a_scale, b_scale = scale_of(first), scale_of(second) if second is not None else 1.0
    if second is not None and a_scale == 1.0:
        a_scale = b_scale
    last = first if second is None else second
    a, b = (masked[parts[k][2] : parts[k][3]] for k in (first, last))
    out |= {
        "low": positions.index(parts[first][2]), "high": positions.index(parts[last][2]),
        "low_mark": decimal_mark(a, a_scale > 1), "high_mark": decimal_mark(b, (b_scale if second is not None else a_scale) > 1),
        "low_scale": a_scale, "high_scale": b_scale if second is not None else a_scale,
    }
    return out


SHAPE_SCHEMA = "kind string, shape string, low int, high int, low_mark string, high_mark string, low_scale double, high_scale double, currency string, period string, periods int"


def _read_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in SHAPE_SCHEMA.split(", ")]
    for pdf in batches:
        rows = []
        for kind, shape in zip(pdf["kind"], pdf["shape"]):
            if kind == "raw":
                x = read_shape(shape)
            else:
                x = dict.fromkeys(names) | {p[0]: p[1] for p in reversed(segment(shape, PRIORS[kind]))}
                x["currency"], x["period"] = x.get("money"), x.get("time")
            rows.append([kind, shape, *(x[c] for c in names[2:])])
        yield pd.DataFrame(rows, columns=names).astype({"low": "Int32", "high": "Int32", "periods": "Int32"})


def shape_of(text: Column) -> Column:
    """The text with white space made plain and single and its digits replaced by 9."""
    return F.regexp_replace(plain(text), r"\d", "9")


def plain(text: Column) -> Column:
    """The text with plain white space and apostrophes, exponents in raised digits, and the name of a pension plan, whose
    number is no amount, as a word."""
    text = F.regexp_replace(text, r"(?:\^|\*\*)\(?[-−]1\)?", "⁻¹")
    text = F.regexp_replace(text, r"(?i)\b401 ?\(?k\)?(?![\p{L}\d])", "pension")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\s    ]+", " "), r"[’´`]", "'"))


def unit_dictionary(rows: DataFrame, raw: str, currency: str, period: str) -> DataFrame:
    """SHAPE_SCHEMA rows: every distinct shape in the three columns, segmented once."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), shape_of(F.col(c)).alias("shape")) for k, c in (("raw", raw), ("currency", currency), ("period", period))])
    shapes = rows.select(F.explode(kinds).alias("x")).select("x.kind", "x.shape").filter("shape <> ''").distinct()
    return spread(shapes, "shape", per_core=1).mapInPandas(_read_all, SHAPE_SCHEMA)


def _value(numbers: Column, index: Column, mark: Column, scale: Column) -> Column:
    text = F.get(numbers, index)
    digits = (
        F.when(mark == ",", F.translate(F.regexp_replace(text, r"[. ']", ""), ",", "."))
        .when(mark == ".", F.regexp_replace(text, r"[, ']", ""))
        .otherwise(F.regexp_replace(text, r"[., ']", ""))
    )
    return digits.try_cast("decimal(24,4)").cast("double") * scale


def to_common_unit(rows: DataFrame, rates: DataFrame, raw: str, currency: str, period: str, low: str, high: str) -> DataFrame:
    """Add `low` and `high`: the pay in `raw` as whole US dollars a year, null where it can't be told.

    The unit comes from the text, else from the columns `currency` and `period`; a bare "$" is the column's
    currency, else USD. `rates` has currency and usd_per_unit. Null or empty texts, texts without a base amount
    ("DOE", "401k"), without a currency or a period, or with an unknown currency give nulls; all rows and their
    other columns are kept.
    """
    d = unit_dictionary(rows, raw, currency, period)
    of = lambda k, *cols: d.filter(F.col("kind") == k).select(F.col("shape").alias(f"__{k}"), *cols)
    out = rows
    for k, c in (("raw", raw), ("currency", currency), ("period", period)):
        out = out.withColumn(f"__{k}", shape_of(F.col(c)))
    fields = ["low", "high", "low_mark", "high_mark", "low_scale", "high_scale"]
    out = out.join(of("raw", F.struct(*fields, "periods").alias("__f"), F.col("currency").alias("__c0"), F.col("period").alias("__p0")), "__raw", "left")
    out = out.join(of("currency", F.col("currency").alias("__c1")), "__currency", "left")
    out = out.join(of("period", F.col("period").alias("__p1")), "__period", "left")
    unit = F.when(F.col("__c0") == "$", F.coalesce(F.when(F.col("__c1") != "$", F.col("__c1")), F.lit("USD"))).otherwise(
        F.coalesce("__c0", F.when(F.col("__c1") == "$", F.lit("USD")).otherwise(F.col("__c1")))
    )
    out = out.withColumn("__unit", unit).withColumn("__n", F.regexp_extract_all(plain(F.col(raw)), F.lit(f"({_NUMBER})"), F.lit(1)))
    rate = rates.select(F.col("currency").alias("__unit"), F.col("usd_per_unit").alias("__rate")).dropna().dropDuplicates(["__unit"])
    out = out.join(rate, "__unit", "left")
    factor = F.create_map(*[F.lit(x) for kv in PER_YEAR.items() for x in kv])[F.coalesce("__p0", "__p1")] * F.col("__rate")
    many = F.when(F.col("__f.periods").isNotNull(), F.get("__n", F.col("__f.periods")).try_cast("double"))
    factor = F.when(F.col("__f.periods").isNull(), factor).otherwise(F.try_divide(factor, many))
    a = _value(F.col("__n"), F.col("__f.low"), F.col("__f.low_mark"), F.col("__f.low_scale")) * factor
    b = _value(F.col("__n"), F.col("__f.high"), F.col("__f.high_mark"), F.col("__f.high_scale")) * factor
    spare = ["__raw", "__currency", "__period", "__f", "__c0", "__p0", "__c1", "__p1", "__unit", "__n", "__rate"]
    return out.withColumn("__a", a).withColumn("__b", b).withColumn(low, F.round(F.least("__a", "__b")).cast("long")).withColumn(high, F.round(F.greatest("__a", "__b")).cast("long")).drop(*spare, "__a", "__b")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Every readable pay of `job_records` as US dollars a year."""
    rows = table(spark, root, "job_records").select("job_id", "salary_raw", "salary_currency", "salary_period").filter(F.col("salary_raw").rlike(r"\d"))
    rates = table(spark, root, "fx_rates")
    out = to_common_unit(rows, rates, "salary_raw", "salary_currency", "salary_period", "usd_year_low", "usd_year_high")
    return out.filter(F.col("usd_year_low").isNotNull()).select("job_id", "usd_year_low", "usd_year_high")

"""Text cleaning, keys and hashes."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Legal suffixes of employers' names.
LEGAL_SUFFIXES = ("corporation", "incorporated", "limited", "llc", "llp", "corp", "inc", "ltd", "lp", "co")
# Characters of the text that go into the text of a near-copy search.
DEDUP_BODY_CHARS = 500


def squeeze(text: Column) -> Column:
    """Single blanks for all white space, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_html(text: Column) -> Column:
    """The text without tags, nothing in their place; null gives an empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", "")


def clean_text(text: Column) -> Column:
    """strip_html, then squeeze."""
    return squeeze(strip_html(text))


def tags_to_blanks(text: Column) -> Column:
    """The text with a blank for each tag, squeezed; used where words must not run together."""
    return squeeze(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " "))


def blank_to_null(text: Column) -> Column:
    """The trimmed text, null where nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


@F.pandas_udf(T.StringType())
def normal_label(s: pd.Series) -> pd.Series:
    """NFKC, small letters, single blanks; there is no such function among the built-in ones."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).lower().split()))


@F.pandas_udf(T.StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    """NFKD without combining marks, small letters, single blanks."""
    return s.map(lambda x: None if x is None else " ".join("".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower().split()))


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


def company_key(name: Column) -> Column:
    """The name in small letters without legal suffixes at its end, however many."""
    tail = r"((,\s*|\s+)(" + "|".join(LEGAL_SUFFIXES) + r")\.?[ ,]*)+$"
    return F.trim(F.regexp_replace(F.lower(squeeze(name)), tail, ""))


def location_key(text: Column) -> Column:
    """Small letters, digits and commas with single blanks."""
    return squeeze(F.regexp_replace(F.lower(text), r"[^a-z0-9,\s]+", " "))


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts, trimmed and in small letters, with bars between; a null counts as the word "none"."""
    return F.sha2(F.concat_ws("|", *[F.lower(F.trim(F.coalesce(p.cast("string"), F.lit("none")))) for p in parts]), 256)


def dedup_text(title: Column, company: Column, body: Column) -> Column:
    """Title, company and the start of the body with bars between, empty parts left out."""
    parts = [blank_to_null(tags_to_blanks(title)), blank_to_null(tags_to_blanks(company)), blank_to_null(F.substring(tags_to_blanks(body), 1, DEDUP_BODY_CHARS))]
    return F.concat_ws(" | ", *parts)


def stable_unique(values: Column) -> Column:
    """The array's texts without blanks and repeats (whatever the case), sorted by their small letters."""
    low = F.transform(F.filter(values, lambda v: F.trim(v) != ""), lambda v: F.struct(F.lower(F.trim(v)).alias("k"), F.trim(v).alias("v")))
    ordered = F.array_sort(low)
    first = F.aggregate(
        ordered,
        F.array().cast("array<struct<k:string,v:string>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.transform(first, lambda x: x["v"])


def cluster_text(title: Column, sections: dict[str, Column]) -> Column:
    """A title and named lists of texts as one text, for embedding; empty lists are left out."""
    parts = [F.concat(F.lit("title: "), blank_to_null(tags_to_blanks(title)))]
    for name, values in sections.items():
        joined = F.array_join(stable_unique(values), ", ")
        parts.append(F.when(joined != "", F.concat(F.lit(f"{name}: "), joined)))
    return F.concat_ws(" | ", *parts)


def json_array(value: Column) -> Column:
    """The items of a JSON array as texts, null for any other JSON value."""
    return F.when(F.ltrim(value).startswith("["), F.from_json(value, "array<string>"))


def clean_location(place: Column) -> Column:
    """The place squeezed, empty for null; "Remote - Remote" and what follows it is "Remote"."""
    s = squeeze(F.coalesce(place, F.lit("")))
    return F.when(F.lower(s).startswith("remote - remote"), "Remote").otherwise(s)


def flat_corpus(*lists: Column) -> Column:
    """The texts of all lists with blanks between; null lists and blank texts are left out."""
    every = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    return F.trim(F.array_join(F.filter(every, lambda x: F.trim(x) != ""), " "))


def any_like(columns: list[Column], terms: list[str], most: int) -> Column:
    """True where one of the columns contains one of the first `most` terms, whatever the case; wildcards in terms
    keep their meaning."""
    tests = [c.ilike(f"%{t}%") for c in columns for t in terms[:most] if t.strip()]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)

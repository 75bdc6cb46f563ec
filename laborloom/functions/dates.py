"""Weeks, eras, ages and trends."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats of dates in raw records, in the order in which they are tried.
FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd",
    "M/d/yyyy", "M-d-yyyy", "d/M/yyyy", "MMMM d, yyyy", "MMM d, yyyy",
)
# First days of the eras after the first one.
ERAS = (("pre_chatgpt", None), ("early_genai", dt.date(2022, 12, 1)), ("post_gpt4", dt.date(2023, 4, 1)), ("agentic_era", dt.date(2024, 6, 1)))
# Days up to which a posting is fresh, and up to which it is stale.
FRESH_DAYS, STALE_DAYS = 30, 90
# Bounds of trends.
ACCELERATING, DECLINING, STABLE = 0.15, -0.15, 0.05


def parse_date(raw: Column) -> Column:
    """The first format that reads the text, as an instant in UTC; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(raw), F.lit(f)) for f in FORMATS])


def week_of(ts: Column) -> Column:
    """The Monday of the week, in the session's zone, which is UTC."""
    return F.to_date(F.date_trunc("week", ts))


def era_of(ts: Column, eras: tuple = ERAS) -> Column:
    """The era of an instant's UTC day; null for null."""
    day = F.to_date(ts)
    out = F.when(day.isNull(), F.lit(None).cast("string"))
    for (name, _), (_, until) in zip(eras, eras[1:]):
        out = out.when(day < F.lit(until), name)
    return out.otherwise(eras[-1][0])


def whole_days(start: Column, end: Column) -> Column:
    """Full days of 24 hours from start to end, not below zero."""
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 86400)).cast("int")


def freshness(days: Column) -> Column:
    return F.when(days <= FRESH_DAYS, "fresh").when(days <= STALE_DAYS, "stale").when(days.isNotNull(), "expired")


def seen_span(first: Column, last: Column, age_days: Column, now: Column) -> Column:
    """struct(first_seen, last_seen, duration_days): a missing end is `now`, a missing start the end less the age in days."""
    age = F.greatest(F.coalesce(age_days, F.lit(0)), F.lit(0))
    end = F.coalesce(last, now)
    start = F.coalesce(first, end - F.make_dt_interval(age))
    return F.struct(start.alias("first_seen"), end.alias("last_seen"), whole_days(start, end).alias("duration_days"))


def trajectory(delta: Column) -> Column:
    return F.when(delta > 0, "rising").when(delta < 0, "declining").otherwise("stable")


def trend(change: Column) -> Column:
    """The trend of a relative change: null and NaN are emerging, infinite ones accelerate or decline."""
    inf = F.lit(float("inf"))
    return (
        F.when(change.isNull() | F.isnan(change), "emerging").when(change == inf, "accelerating").when(change == -inf, "declining")
        .when(change > ACCELERATING, "accelerating").when(change < DECLINING, "declining").when(F.abs(change) <= STABLE, "stable").otherwise("volatile")
    )


def finite(change: Column) -> Column:
    """The change, or 0 where it is null, NaN or infinite."""
    return F.when(change.isNull() | F.isnan(change) | (F.abs(change) == float("inf")), 0.0).otherwise(change)


def default_week(today: dt.date) -> dt.date:
    """The Monday of the week before `today`."""
    return today - dt.timedelta(days=today.weekday() + 7)


def as_week(value: object, today: dt.date) -> dt.date:
    """A week given as a date, a text or nothing, as its Monday; what can't be read gives the default week."""
    if isinstance(value, str):
        try:
            value = dt.date.fromisoformat(value[:10])
        except ValueError:
            value = None
    if isinstance(value, dt.datetime):
        value = value.date()
    return value - dt.timedelta(days=value.weekday()) if isinstance(value, dt.date) else default_week(today)

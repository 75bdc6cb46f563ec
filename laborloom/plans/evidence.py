"""Measures of an answer's evidence, over its few rows in the driver."""

from __future__ import annotations

import datetime as dt
import math
import re

# Postings from which a volume is enough, and the confidence below which nothing raises it.
ENOUGH, TRANSPARENT = 30, 0.5
_NUMBER = re.compile(r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?|\b\d+(?:\.\d+)?")


def volume(rows: list[dict], distinct: int | None = None) -> int | None:
    """The number of postings behind rows: as given, else the largest count in a row, as rows may overlap."""
    if distinct is not None:
        return distinct
    counts = [int(v) for r in rows for k, v in r.items() if k.lower().endswith("count") and isinstance(v, (int, float)) and not isinstance(v, bool) and v >= 0 and math.isfinite(v)]
    return max(counts, default=None)


def sufficiency(n: int | None) -> str:
    return "sparse" if n is None else "no_data" if n <= 0 else "sparse" if n < ENOUGH else "adequate"


def volume_score(n: int | None) -> float:
    return 0.65 if n is None else 0.0 if n <= 0 else 0.2 if n < 10 else 0.5 if n < ENOUGH else 1.0


def completeness(gaps: bool, unknown_period: bool, partial_period: bool, truncated: bool) -> float:
    return max(0.0, round(1.0 - 0.25 * gaps - 0.1 * unknown_period - 0.15 * partial_period - 0.1 * truncated, 3))


def confidence(classified: float, n: int | None, complete: float) -> float:
    mixed = 0.6 * classified + 0.25 * volume_score(n) + 0.15 * complete
    return round(max(0.0, min(1.0, min(mixed, classified) if classified < TRANSPARENT else mixed)), 3)


def period_ordinal(period: str) -> int | None:
    """A period's first day as a number: a day, an ISO week, a quarter, a month or a year."""
    p = (period or "").strip()
    try:
        return dt.datetime.fromisoformat(p.replace("Z", "+00:00")).toordinal() if len(p) >= 10 else _short_period(p)
    except ValueError:
        return None


def _short_period(p: str) -> int | None:
    try:
        if m := re.fullmatch(r"(\d{4})-[Ww](\d{1,2})", p):
            return dt.date.fromisocalendar(int(m[1]), int(m[2]), 1).toordinal()
        if m := re.fullmatch(r"(\d{4})-[Qq]([1-4])", p):
            return dt.date(int(m[1]), 3 * int(m[2]) - 2, 1).toordinal()
        if m := re.fullmatch(r"(\d{4})(?:-(\d{2}))?", p):
            return dt.date(int(m[1]), int(m[2] or 1), 1).toordinal()
    except ValueError:
        pass
    return None


def ordered_periods(periods: list[str]) -> list[str]:
    """Different periods in the order of time, or as given if one can't be read."""
    once = list(dict.fromkeys(periods))
    return sorted(once, key=period_ordinal) if all(period_ordinal(p) is not None for p in once) else once


def ungrounded(answer: str, facts: str, relative: float = 0.005, absolute: float = 1.0) -> list[str]:
    """Numbers in an answer that no number of the facts is near to, within half a percent or one."""
    known = [float(m[0].replace(",", "")) for m in _NUMBER.finditer(facts)]
    near = lambda x: any(abs(x - y) <= max(absolute, relative * max(abs(x), abs(y), 1.0)) for y in known)
    return [m[0] for m in _NUMBER.finditer(answer or "") if not near(float(m[0].replace(",", "")))]


def pretty(key: str, value) -> str:
    """A cell as words: the name without underscores, numbers with separators, nothing for null."""
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return ""
    shown = f"{value:,.0f}" if isinstance(value, (int, float)) and not isinstance(value, bool) and float(value).is_integer() else f"{value:,.2f}" if isinstance(value, float) else str(value)
    return f"{key.replace('_', ' ')}: {shown}"

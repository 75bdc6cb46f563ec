"""Registry of the core queries: name -> (spark, folder) -> DataFrame, and their SQL."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from .operators.timestamps import p4_found
from .operators.units import p2_found
from .plans import aggregates, measures, records, router


def dates_as_text(f):
    """The query with its dates as texts, so that any client compares them alike."""

    @wraps(f)
    def run(spark, root):
        df = f(spark, root)
        return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"})

    return run


def sql_dates_as_text(sql: str) -> str:
    return f"SELECT * REPLACE (CAST(week_start AS VARCHAR) AS week_start) FROM ({sql})"


_WEEKS = ("skill_demand_weekly", "tool_demand_weekly", "geo_demand_weekly", "role_snapshot_weekly", "demand_share_by_region", *router.WEEKS)
QUERIES = {"p2_found": p2_found, "p4_found": p4_found} | {n: dates_as_text(f) for n, f in {**aggregates.QUERIES, **records.QUERIES, **router.QUERIES, **measures.QUERIES}.items()}
SQL: dict[str, str] = {n: sql_dates_as_text(s) if n in _WEEKS else s for n, s in {**aggregates.SQL, **records.SQL, **router.SQL, **measures.SQL}.items()}

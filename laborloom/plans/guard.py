"""Checks of SQL texts before they run: one SELECT over allowed tables and functions, at most so many rows, in a bounded time."""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of an answer, length of a text, and the tables that a text may name.
MAX_ROWS, MAX_CHARS = 100, 20_000
TABLES = frozenset(
    "skill_demand_weekly tool_demand_weekly role_snapshot_weekly sector_summary_weekly geo_demand_weekly skill_velocity skill_co_occurrence posting_freshness trajectory_map "
    "analytics_pipeline_state cohort_gap_cache canonical_roles".split()
)
# The tables of questions about single postings, intents whose questions must leave out mislabelled
# roles, and that label.
ASK_TABLES = frozenset(
    "skill_demand_weekly tool_demand_weekly role_snapshot_weekly sector_summary_weekly geo_demand_weekly skill_velocity skill_co_occurrence posting_freshness canonical_roles employer_profiles companies "
    "industry_sectors job_postings normalized_jobs extracted_intelligence postal_geo_data company_addresses technology_areas analytics_aggregates skills raw_ingested_jobs".split()
)
ROLE_INTENTS, NO_ROLE = frozenset(("employer", "curriculum", "workflow")), "N/A Not an IT role"
#: Plan nodes of a query; any other node is a command or a write. Relations come as UnresolvedRelation.
_QUERY_NODES = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except Join SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedHaving UnresolvedSubqueryColumnAliases "
    "OneRowRelation Window WithWindowDefinition UnresolvedInlineTable LocalRelation Generate LateralJoin Deduplicate WithCTE Pivot Unpivot UnresolvedOrdinal UnresolvedGroupingSets".split()
)
#: Functions that a text may call; what isn't here, such as calls into Java or about the session, is refused.
FUNCTIONS = frozenset(
    "abs any_value array array_contains avg cast ceil ceiling char_length coalesce concat concat_ws contains corr count count_if cume_dist current_date current_timestamp date date_add date_diff "
    "date_format date_sub date_trunc datediff day dayofmonth dayofweek dayofyear dense_rank element_at endswith every exp explode explode_outer extract first first_value float floor from_json "
    "get_json_object greatest if ifnull initcap int isnan isnotnull isnull lag last last_day last_value lead least left length levenshtein like ln locate log log10 log2 lower lpad ltrim make_date max "
    "max_by mean median min min_by mod month months_between now ntile nullif nvl percent_rank percentile percentile_approx percentile_cont percentile_disc position posexplode pow power quarter rank regexp "
    "regexp_extract regexp_like regexp_replace replace right round row_number rpad rtrim sign signum size some split split_part sqrt startswith std stddev stddev_pop stddev_samp string substr substring "
    "sum timestamp to_date to_timestamp translate trim trunc try_cast try_divide upper var_pop var_samp variance weekofyear when year".split()
)
#: Expressions besides calls that reach beyond the tables.
_ODD_EXPRESSIONS = frozenset("UnresolvedDeserializer ScalaUDF PythonUDF CallMethodViaReflection Invoke StaticInvoke NewInstance InputFileName".split())
_CALL = re.compile(r"Unresolved(Function|Generator|TableValuedFunction)")


@dataclass(frozen=True)
class Verdict:
    ok: bool
    reason: str | None
    tables: tuple[str, ...] = ()


def _walk(plan, found: list) -> None:
    """All nodes of a parsed plan, those of common table expressions and of subqueries in expressions too."""
    found.append(plan)
    name = plan.nodeName()
    if name == "UnresolvedWith":
        ctes = plan.cteRelations()
        for i in range(ctes.length()):
            _walk(ctes.apply(i)._2(), found)
    subs = plan.subqueries()
    for i in range(subs.length()):
        _walk(subs.apply(i), found)
    children = plan.children()
    for i in range(children.length()):
        _walk(children.apply(i), found)


def _odd_call(nodes: list) -> str | None:
    """The first function in the nodes' expressions that is not allowed, at any depth, or None.

    Subqueries are nodes of their own. A name with a schema before it is refused.
    """
    for n in nodes:
        seq = n.expressions()
        todo = [seq.apply(i) for i in range(seq.length())]
        while todo:
            e = todo.pop()
            name = e.getClass().getSimpleName()
            if _CALL.match(name):
                parts = e.nameParts() if name == "UnresolvedFunction" else None
                if parts is None:
                    called = e.name().funcName().lower() if name == "UnresolvedGenerator" and e.name().database().isEmpty() else name
                else:
                    called = parts.apply(0).lower() if parts.length() == 1 else ".".join(parts.apply(i) for i in range(parts.length()))
                if called not in FUNCTIONS:
                    return called
            elif name in _ODD_EXPRESSIONS:
                return name
            kids = e.children()
            todo.extend(kids.apply(i) for i in range(kids.length()))
    return None


def _cte_names(nodes: list) -> set[str]:
    out = set()
    for n in nodes:
        if n.nodeName() == "UnresolvedWith":
            rel = n.cteRelations()
            out |= {rel.apply(i)._1().lower() for i in range(rel.length())}
    return out


def check(spark: SparkSession, text: str, allowed: frozenset[str] = TABLES) -> Verdict:
    """Whether a text is a single query over allowed tables, told by Spark's own parser before anything is analysed.

    Refused: empty and overlong texts, several statements, commands and writes, tables that aren't allowed, tables
    with a catalog or another schema than dbo, table functions, and functions that aren't in FUNCTIONS. A LIMIT above
    MAX_ROWS or none is fine, as run() sets one.
    """
    raw = (text or "").strip().rstrip(";").strip()
    if not raw:
        return Verdict(False, "empty")
    if len(raw) > MAX_CHARS:
        return Verdict(False, "too long")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(raw)
    except Exception:
        return Verdict(False, "not one readable statement")
    nodes: list = []
    _walk(plan, nodes)
    names = [n.nodeName() for n in nodes]
    odd = next((n for n in names if n not in _QUERY_NODES), None)
    if odd:
        return Verdict(False, f"{odd} is not allowed")
    call = _odd_call(nodes)
    if call:
        return Verdict(False, f"function {call} is not allowed")
    ctes = _cte_names(nodes)
    tables = set()
    for n in nodes:
        if n.nodeName() == "UnresolvedRelation":
            parts = n.multipartIdentifier()
            ids = [parts.apply(i).lower() for i in range(parts.length())]
            if len(ids) > 2 or (len(ids) == 2 and ids[0] != "dbo"):
                return Verdict(False, f"table {'.'.join(ids)} is not allowed")
            if ids[-1] in ctes and len(ids) == 1:
                continue
            if ids[-1] not in allowed:
                return Verdict(False, f"table {ids[-1]} is not allowed")
            tables.add(ids[-1])
    return Verdict(True, None, tuple(sorted(tables)))


def role_rule(text: str, intent: str, tables: tuple[str, ...]) -> dict[str, Column]:
    """The filter of `job_postings` that a text of this intent needs if it reads role_classification and doesn't name
    the label of mislabelled roles itself; for run()'s `where`. Empty where no rule applies."""
    if intent.strip().lower() not in ROLE_INTENTS or "job_postings" not in tables or NO_ROLE in text or not re.search(r"\brole_classification\b", text, re.I):
        return {}
    return {"job_postings": F.col("role_classification") != NO_ROLE}


def run(spark: SparkSession, text: str, views: dict[str, DataFrame], allowed: frozenset[str] = TABLES, rows: int = MAX_ROWS, seconds: float = 30.0, where: dict[str, Column] | None = None) -> list[dict]:
    """The rows of a checked text over `views`, `rows` at most, ended after `seconds`.

    `where` filters views before the text sees them, so that a rule holds however the text is written.
    """
    verdict = check(spark, text, allowed)
    if not verdict.ok:
        raise ValueError(verdict.reason)
    for name in verdict.tables:
        df = views[name]
        (df.filter(where[name]) if where and name in where else df).createOrReplaceTempView(name)
    group = f"guard-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    body = re.sub(r"\bdbo\.", "", text.strip().rstrip(";"))
    sc.setJobGroup(group, "checked query", interruptOnCancel=True)
    timer = threading.Timer(seconds, lambda: sc.cancelJobGroup(group))
    timer.start()
    try:
        return [r.asDict() for r in spark.sql(body).limit(rows).collect()]
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)

"""The query surface: intents with parameters, dispatched to frames over the weekly tables."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import postings
from ..functions.text import any_like
from ..operators.gates import entitled, strict_gate
from ..operators.velocity import velocity
from . import sql
from .aggregates import TARGET, role_snapshot_weekly, skill_co_occurrence_top200, weekly_skills

# Rows of an answer, terms of a filter, words of a role, and the days in a phrase of time.
LIMIT, MOST_TERMS, MOST_WORDS = 100, 5, 10
SPAN_WEEKS = {"week": 1, "month": 4, "quarter": 13, "year": 52}
INTENTS = ("trend", "role_evolution", "disruption", "emergence", "curriculum", "employer", "workflow", "geographic", "comparison", "other")
_HINTS = (
    ("comparison", r"\b(compare|versus|vs\.?|difference between)\b"), ("disruption", r"\b(declin|disrupt|replac|at risk|shrinking)"), ("emergence", r"\b(emerging|new skills?|rising|fastest growing)\b"),
    ("curriculum", r"\b(curricul|course|syllabus|teach|training program)"), ("employer", r"\b(employers?|compan(y|ies)|who is hiring)\b"), ("workflow", r"\b(workflow|process|tasks? of|day to day)\b"),
    ("role_evolution", r"\b(evol|changed over|history of)"), ("geographic", r"\b(where|region|city|county|near)\b"), ("trend", r"\b(trend|demand|popular|top skills?)\b"),
)


@dataclass
class Request:
    intent: str
    skills: list[str] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    places: list[str] = field(default_factory=list)
    spans: list[str] = field(default_factory=list)


@dataclass
class Answer:
    intent: str
    routed: bool
    columns: list[str]
    rows: list[dict]
    is_partial: bool
    error: str | None = None


def guess_intent(question: str) -> str:
    """The first intent whose words are in the question; "other" if none."""
    q = question.lower()
    return next((name for name, words in _HINTS if re.search(words, q)), "other")


def weeks_back(spans: list[str], default: int = 12) -> int:
    """The weeks that phrases such as "last 3 months" mean; the longest one counts."""
    found = [int(m[1] or 1) * SPAN_WEEKS[m[2]] for s in spans for m in re.finditer(r"(?:(\d+)\s+)?(week|month|quarter|year)s?", s.lower())]
    return max(found, default=default)


def week_floor(spans: list[str], target: dt.date) -> dt.date:
    return target - dt.timedelta(days=7 * weeks_back(spans))


def role_words(roles: list[str]) -> list[str]:
    """Different words of role names with three letters or more, ten at most."""
    words = [w for r in roles for w in re.findall(r"[^\W\d_]{3,}", r.lower())]
    return list(dict.fromkeys(words))[:MOST_WORDS]


class Router:
    """Builds an answer's frame for each intent. `tenant` is the list of places it may see, None for all."""

    def __init__(self, spark: SparkSession, root: str, target: dt.date = TARGET, tenant: list[str] | None = None) -> None:
        self.spark, self.root, self.target, self.tenant = spark, root, target, tenant

    def weekly(self) -> DataFrame:
        """The weekly table of what the tenant may see, from its own postings."""
        return weekly_skills(self.spark, self.root, self.tenant)

    def velocity(self) -> DataFrame:
        return velocity(self.weekly(), self.target).withColumn("change", F.round("change", 6))

    def postings(self) -> DataFrame:
        return entitled(postings(self.spark, self.root), "subregion", self.tenant)

    def trend(self, r: Request) -> DataFrame:
        w = self.weekly().filter(F.col("week_start") >= F.lit(week_floor(r.spans, self.target)))
        w = w.filter(any_like([F.col("label")], r.skills, MOST_TERMS)) if r.skills else w
        return w.orderBy(F.desc("week_start"), F.desc("posting_count"), "label").limit(LIMIT)

    def curriculum(self, r: Request) -> DataFrame:
        w = self.weekly().filter(F.col("week_start") >= F.lit(week_floor(r.spans, self.target)))
        w = w.filter(any_like([F.col("label")], r.skills, MOST_TERMS)) if r.skills else w
        return w.orderBy(F.desc("posting_count"), F.desc("week_start"), "label").limit(LIMIT)

    def disruption(self, r: Request) -> DataFrame:
        v = self.velocity().filter(F.col("trend").isin("declining", "volatile"))
        return v.orderBy("change", "label").limit(LIMIT)

    def emergence(self, r: Request) -> DataFrame:
        v = self.velocity().filter(F.col("trend").isin("emerging", "accelerating"))
        return v.orderBy(F.desc("change"), "label").limit(LIMIT)

    def role_evolution(self, r: Request) -> DataFrame:
        words = role_words(r.roles)
        p = self.postings()
        p = p.filter(reduce(lambda a, b: a | b, [F.col("seniority").ilike(f"%{w}%") for w in words])) if words else p
        g = p.groupBy(F.year("date_posted").alias("year"), "subregion", "seniority").agg(F.count_distinct("posting_id").alias("posting_count"), F.count_distinct("company_id").alias("employer_count"))
        return g.orderBy(F.desc("posting_count"), "year", "subregion", "seniority").limit(LIMIT)

    def employer(self, r: Request) -> DataFrame:
        p = self.postings()
        p = p.filter(any_like([F.col("company")], r.roles, MOST_TERMS)) if r.roles else p
        p = p.filter(any_like([F.col("subregion"), F.col("market"), F.col("sector")], r.places, MOST_TERMS)) if r.places else p
        g = p.groupBy("company", "sector", "subregion").agg(F.count(F.lit(1)).alias("posting_count"))
        return g.orderBy(F.desc("posting_count"), "company").limit(LIMIT)

    def workflow(self, r: Request) -> DataFrame:
        from ..adapters import elements

        e = elements(self.spark, self.root)
        e = e.filter(any_like([F.col("task")], r.roles + r.skills, MOST_TERMS)) if r.roles or r.skills else e
        return e.groupBy("task", "tool").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "task", "tool").limit(LIMIT)

    def geographic(self, r: Request) -> DataFrame:
        p = self.postings()
        p = p.filter(any_like([F.col("subregion"), F.col("market")], r.places, MOST_TERMS)) if r.places else p
        return p.groupBy("week_start", "subregion").agg(F.count(F.lit(1)).alias("posting_count")).orderBy(F.desc("week_start"), F.desc("posting_count"), "subregion").limit(LIMIT)

    def geographic_list(self, r: Request) -> DataFrame:
        p = strict_gate(self.postings())
        p = p.filter(any_like([F.col("subregion"), F.col("market")], r.places, MOST_TERMS)) if r.places else p
        return p.select("posting_id", "company", "sector", "subregion", "date_posted", "salary").orderBy(F.desc_nulls_last("date_posted"), F.desc("posting_id")).limit(LIMIT)

    def comparison(self, r: Request) -> DataFrame:
        w = self.weekly().filter(F.lower("label").isin(*[s.lower() for s in r.skills])) if r.skills else self.weekly().limit(0)
        return w.orderBy(F.desc("week_start"), "label").limit(LIMIT)

    def other(self, r: Request) -> DataFrame:
        return self.spark.createDataFrame([], "label string")

    def known_skills(self, skills: list[str]) -> bool:
        """Whether every named skill is a label, whatever the case."""
        names = {s.lower() for s in skills}
        return self.weekly().select(F.lower("label").alias("l")).filter(F.col("l").isin(*names)).distinct().count() == len(names) if names else True

    def answer(self, r: Request) -> Answer:
        """The rows of an intent; a failure is an answer with an error, and an unknown intent is not routed."""
        build = getattr(self, r.intent, None) if r.intent in INTENTS or r.intent == "geographic_list" else None
        if build is None or r.intent == "other":
            return Answer(r.intent, False, [], [], False)
        try:
            df = build(r)
            rows = [x.asDict() for x in df.collect()]  # LIMIT rows at most
            return Answer(r.intent, True, df.columns, rows, len(rows) >= LIMIT)
        except Exception as e:  # the surface reports failures
            return Answer(r.intent, True, [], [], False, str(e)[:500])


class Cache:
    """Answers by a hash of their parameters, for a day; kept in the driver, the oldest go first."""

    def __init__(self, hours: float = 24, most: int = 1_000, clock=time.time) -> None:
        self.seconds, self.most, self.clock, self.kept = hours * 3600, most, clock, {}

    @staticmethod
    def key(kind: str, params: dict) -> str:
        return hashlib.sha256(f"{kind}|{json.dumps(params, sort_keys=True, default=str)}".encode()).hexdigest()

    def get(self, kind: str, params: dict, make):
        k = self.key(kind, params)
        hit = self.kept.get(k)
        if hit and self.clock() - hit[0] < self.seconds:
            return hit[1]
        value = make()
        self.kept[k] = (self.clock(), value)
        while len(self.kept) > self.most:
            self.kept.pop(min(self.kept, key=lambda x: self.kept[x][0]))
        return value


def _router(f):
    return lambda spark, root: f(Router(spark, root))


def emerging_limit_then_filter(spark, root):
    """The 50 strongest changes first, then those with demand enough: the filter comes after the limit."""
    v = Router(spark, root).velocity().orderBy(F.desc_nulls_last("change"), "label").limit(50)
    return v.filter("demand_count >= 5")


def history_last_k_weeks(spark, root, k: int = 6):
    """All rows of the labels that lead the target week, over the last k weeks that have rows."""
    w = weekly_skills(spark, root).filter(F.col("week_start") <= F.lit(TARGET))
    weeks = w.select("week_start").distinct().orderBy(F.desc("week_start")).limit(k)
    top = w.filter(F.col("week_start") == F.lit(TARGET)).orderBy(F.desc("posting_count"), "label").limit(10).select("label")
    return w.join(F.broadcast(weeks), "week_start", "left_semi").join(F.broadcast(top), "label", "left_semi")


def dashboard_top20(spark, root):
    return weekly_skills(spark, root).filter(F.col("week_start") == F.lit(TARGET)).orderBy(F.desc("posting_count"), "label").limit(20)


def dashboard_velocity(spark, root):
    return Router(spark, root).velocity().orderBy(F.desc(F.abs("change")), "label").limit(100)


def dashboard_roles(spark, root):
    return role_snapshot_weekly(spark, root).filter(F.col("week_start") == F.lit(TARGET)).orderBy(F.desc("posting_count"), "role").select("role", "posting_count", "p50").limit(30)


def co_occurrence_matrix(spark, root, n: int = 8):
    """The pair table of the most frequent labels as a symmetric matrix, zero where a pair isn't in it."""
    p = skill_co_occurrence_top200(spark, root)
    both = p.union(p.select(F.col("skill_b").alias("skill_a"), F.col("skill_a").alias("skill_b"), "pair_count"))
    names = [r[0] for r in both.groupBy("skill_a").agg(F.sum("pair_count").alias("s")).orderBy(F.desc("s"), "skill_a").limit(n).collect()]
    kept = both.filter(F.col("skill_a").isin(*names) & F.col("skill_b").isin(*names))
    out = kept.groupBy("skill_a").pivot("skill_b", sorted(names)).agg(F.sum("pair_count"))
    return out.select("skill_a", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(f"c{i}") for i, x in enumerate(sorted(names))])


QUERIES = {
    "router_trend": _router(lambda r: r.trend(Request("trend", skills=["brand#1", "brand#2"]))),
    "router_curriculum": _router(lambda r: r.curriculum(Request("curriculum", spans=["last 2 quarters"]))),
    "router_disruption": _router(lambda r: r.disruption(Request("disruption"))),
    "router_emergence": _router(lambda r: r.emergence(Request("emergence"))),
    "router_role_evolution": _router(lambda r: r.role_evolution(Request("role_evolution", roles=["Urgent High"]))),
    "router_employer": _router(lambda r: r.employer(Request("employer", places=["NATION_1"]))),
    "router_workflow": _router(lambda r: r.workflow(Request("workflow"))),
    "router_geographic": _router(lambda r: r.geographic(Request("geographic", places=["asia"]))),
    "router_list": _router(lambda r: r.geographic_list(Request("geographic_list", places=["europe"]))),
    "router_comparison": _router(lambda r: r.comparison(Request("comparison", skills=["Brand#11", "brand#22"]))),
    "router_tenant": lambda spark, root: Router(spark, root, tenant=["NATION_3", "NATION_7"]).geographic(Request("geographic")),
    "emerging_limit_then_filter": emerging_limit_then_filter,
    "history_last_k_weeks": history_last_k_weeks,
    "dashboard_top20": dashboard_top20,
    "dashboard_velocity": dashboard_velocity,
    "dashboard_roles": dashboard_roles,
    "co_occurrence_matrix": co_occurrence_matrix,
}
_MATRIX = f"""WITH {sql.ROWS}, d AS (SELECT DISTINCT posting_id, skill FROM skill_rows), r AS (SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY skill) AS rn FROM d), c AS (SELECT * FROM r WHERE rn <= 20),
p AS (SELECT a.skill AS x, b.skill AS y, count(*) AS n FROM c a JOIN c b ON a.posting_id = b.posting_id AND a.skill < b.skill GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 200), q AS (SELECT * FROM p UNION ALL SELECT y, x, n FROM p),
t AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT x FROM q GROUP BY x ORDER BY sum(n) DESC, x LIMIT 8))
SELECT q.x AS skill_a, """ + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE u.i = {i}), 0) AS BIGINT) AS c{i}" for i in range(8)) + " FROM q JOIN t ON q.x = t.x JOIN t u ON q.y = u.x GROUP BY 1"
_FLOOR = f"DATE '{TARGET}' - INTERVAL 84 DAY"
_VEL = sql.velocity(str(TARGET))
SQL = {
    "co_occurrence_matrix": _MATRIX,
    "router_trend": f"WITH {sql.WEEKLY} SELECT * FROM weekly WHERE week_start >= {_FLOOR} AND (label ILIKE '%brand#1%' OR label ILIKE '%brand#2%') ORDER BY week_start DESC, posting_count DESC, label LIMIT 100",
    "router_curriculum": f"WITH {sql.WEEKLY} SELECT * FROM weekly WHERE week_start >= DATE '{TARGET}' - INTERVAL 182 DAY ORDER BY posting_count DESC, week_start DESC, label LIMIT 100",
    "router_disruption": f"WITH {_VEL} SELECT * FROM vel WHERE trend IN ('declining', 'volatile') ORDER BY change, label LIMIT 100",
    "router_emergence": f"WITH {_VEL} SELECT * FROM vel WHERE trend IN ('emerging', 'accelerating') ORDER BY change DESC, label LIMIT 100",
    "router_role_evolution": f"""WITH {sql.POST} SELECT CAST(year(date_posted) AS INTEGER) AS year, subregion, seniority, count(DISTINCT posting_id) AS posting_count, count(DISTINCT company_id) AS employer_count FROM post
WHERE seniority ILIKE '%urgent%' OR seniority ILIKE '%high%' GROUP BY ALL ORDER BY posting_count DESC, year, subregion, seniority LIMIT 100""",
    "router_employer": f"""WITH {sql.POST} SELECT company, sector, subregion, count(*) AS posting_count FROM post WHERE subregion ILIKE '%nation_1%' OR market ILIKE '%nation_1%' OR sector ILIKE '%nation_1%' GROUP BY ALL ORDER BY posting_count DESC, company LIMIT 100""",
    "router_workflow": f"WITH {sql.ELEM} SELECT task, tool, count(*) AS n FROM elem GROUP BY ALL ORDER BY n DESC, task, tool LIMIT 100",
    "router_geographic": f"WITH {sql.POST} SELECT week_start, subregion, count(*) AS posting_count FROM post WHERE subregion ILIKE '%asia%' OR market ILIKE '%asia%' GROUP BY ALL ORDER BY week_start DESC, posting_count DESC, subregion LIMIT 100",
    "router_list": f"WITH {sql.POST} SELECT posting_id, company, sector, subregion, date_posted, salary FROM post WHERE status = 'O' AND (subregion ILIKE '%europe%' OR market ILIKE '%europe%') ORDER BY date_posted DESC NULLS LAST, posting_id DESC LIMIT 100",
    "router_comparison": f"WITH {sql.WEEKLY} SELECT * FROM weekly WHERE lower(label) IN ('brand#11', 'brand#22') ORDER BY week_start DESC, label LIMIT 100",
    "router_tenant": f"WITH {sql.POST} SELECT week_start, subregion, count(*) AS posting_count FROM post WHERE subregion IN ('NATION_3', 'NATION_7') GROUP BY ALL ORDER BY week_start DESC, posting_count DESC, subregion LIMIT 100",
    "emerging_limit_then_filter": f"WITH {_VEL} SELECT * FROM (SELECT * FROM vel ORDER BY change DESC NULLS LAST, label LIMIT 50) WHERE demand_count >= 5",
    "history_last_k_weeks": f"""WITH {sql.WEEKLY}, w AS (SELECT * FROM weekly WHERE week_start <= DATE '{TARGET}') SELECT * FROM w WHERE week_start IN (SELECT DISTINCT week_start FROM w ORDER BY 1 DESC LIMIT 6)
AND label IN (SELECT label FROM w WHERE week_start = DATE '{TARGET}' ORDER BY posting_count DESC, label LIMIT 10)""",
    "dashboard_top20": f"WITH {sql.WEEKLY} SELECT * FROM weekly WHERE week_start = DATE '{TARGET}' ORDER BY posting_count DESC, label LIMIT 20",
    "dashboard_velocity": f"WITH {_VEL} SELECT * FROM vel ORDER BY abs(change) DESC, label LIMIT 100",
    "dashboard_roles": f"WITH {sql.POST} SELECT seniority AS role, count(*) AS posting_count, quantile_disc(salary, 0.5) AS p50 FROM post WHERE week_start = DATE '{TARGET}' GROUP BY ALL ORDER BY posting_count DESC, role LIMIT 30",
}
#: Queries whose result has the week as a column.
WEEKS = ("router_trend", "router_curriculum", "router_geographic", "router_comparison", "router_tenant", "history_last_k_weeks", "dashboard_top20")

"""Queries: weekly aggregates, pairs, velocity, eras and windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..adapters import elements, postings, skill_rows
from ..functions.dates import era_of
from ..functions.money import midpoint, yearly
from ..operators import checks, eras, windows
from ..operators.gates import analytics_gate, entitled
from ..operators.velocity import velocity
from ..operators.quantiles import quantiles
from ..operators.weekly import demand, in_week, pair_table, percentiles, sector_summary
from ..runtime import table
from . import sql

#: The weeks that the queries report on, and the eras of the order dates.
WEEK, TARGET = dt.date(1998, 6, 1), dt.date(1998, 6, 29)
ORDER_ERAS = (("first", None), ("second", dt.date(1996, 7, 1)), ("third", dt.date(1998, 1, 1)), ("fourth", dt.date(1999, 10, 1)))
ERA_NAMES = [n for n, _ in ORDER_ERAS]
_ERA_SQL = "CASE WHEN date_posted < DATE '1996-07-01' THEN 'first' WHEN date_posted < DATE '1998-01-01' THEN 'second' WHEN date_posted < DATE '1999-10-01' THEN 'third' ELSE 'fourth' END"
_ERA_ROWS = f"{sql.ROWS}, era_rows AS (SELECT *, {_ERA_SQL} AS era FROM skill_rows)"


def weekly_skills(spark, root, tenant: list[str] | None = None):
    """(week_start, label, posting_count, employer_count), of the places that a tenant may see."""
    return demand(entitled(skill_rows(spark, root), "subregion", tenant), F.col("skill"))


def skill_demand_weekly(spark, root):
    return weekly_skills(spark, root).withColumnRenamed("label", "skill_label")


def tool_demand_weekly(spark, root):
    return demand(skill_rows(spark, root), F.col("tool"), company=None).withColumnRenamed("label", "tool_label")


def geo_demand_weekly(spark, root):
    return analytics_gate(postings(spark, root)).groupBy("week_start", F.trim("subregion").alias("subregion")).agg(F.count(F.lit(1)).alias("posting_count"))


def geo_demand_one_week(spark, root):
    return in_week(postings(spark, root), "date_posted", WEEK).groupBy("subregion").agg(F.count(F.lit(1)).alias("posting_count"))


def sector_summary_all(spark, root):
    out = sector_summary(postings(spark, root), elements(spark, root).select("posting_id", "skill"))
    return out.withColumn("top_skills", F.array_join("top_skills", ","))


def salary_percentiles_by_sector(spark, root):
    return percentiles(postings(spark, root), F.col("sector"), F.col("salary"), 50)


def salary_percentiles_by_source(spark, root):
    jr = table(spark, root, "job_records")
    pay = yearly(midpoint(F.col("salary_min"), F.col("salary_max")), F.col("salary_period"))
    return percentiles(jr, F.lower(F.trim(F.regexp_replace("source", r"\s+", " "))), pay, 20)


def role_snapshot_weekly(spark, root):
    p = postings(spark, root)
    p = p.select("week_start", F.col("seniority").alias("role"), "salary")
    points = {f"p{int(q * 100)}": q for q in (0.25, 0.5, 0.75, 0.95)}
    q = quantiles(p, ["week_start", "role"], "salary", points, mean="mean")
    return q.select("week_start", "role", F.col("row_count").alias("posting_count"), F.round(F.col("mean") + 1e-7, 4).alias("avg_salary"), *points)


def skill_co_occurrence_top200(spark, root):
    return pair_table(skill_rows(spark, root), "posting_id", "skill")


def tool_supplier_pairs(spark, root):
    e = elements(spark, root).filter(~F.col("failed"))
    n = table(spark, root, "supplier").join(table(spark, root, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("supplier_id"), F.col("n_name").alias("responsibility"))
    return e.join(n, "supplier_id").groupBy("tool", "responsibility").agg(F.count(F.lit(1)).alias("pair_count")).orderBy(F.desc("pair_count"), "tool", "responsibility").limit(20)


def skill_velocity(spark, root):
    return velocity(weekly_skills(spark, root), TARGET).withColumn("change", F.round("change", 6))


def role_evolution_eras(spark, root):
    p = postings(spark, root).withColumn("era", era_of(F.col("date_posted"), ORDER_ERAS))
    return p.groupBy("era", "subregion", "seniority").agg(F.count_distinct("posting_id").alias("posting_count"), F.count_distinct("company_id").alias("employer_count"))


def _era_rows(spark, root):
    return skill_rows(spark, root).withColumn("era", era_of(F.col("date_posted"), ORDER_ERAS))


def era_mix(spark, root):
    return eras.mix(_era_rows(spark, root), "seniority", "skill")


def era_tool_sets(spark, root):
    """Steps between eras of the tools of each company."""
    return eras.era_steps(eras.dense_sets(_era_rows(spark, root), "company_id", "tool", ERA_NAMES), "company_id")


def era_aggregates(spark, root):
    """Postings of each era, the mean quantity above 25, and the mean number of elements over 20, cut to 0 to 1."""
    rows = _era_rows(spark, root)
    per = rows.groupBy("seniority", "era", "posting_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("quantity") > 25, F.col("quantity"))).alias("q"))
    return per.groupBy("seniority", "era").agg(F.count_distinct("posting_id").alias("posting_count"), F.round(F.avg("q"), 4).alias("mean_quantity"), F.round(F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("n") / 20.0))), 6).alias("density"))


def era_top_changes(spark, root):
    return eras.top_changes(era_mix(spark, root), "seniority", ERA_NAMES).select("seniority", "rank", "label", "direction", "net_change", "max_step", "changed_steps")


def era_patterns(spark, root):
    """How many companies show each pattern of change, by tools, demand and a tool class that stands for AI."""
    rows = _era_rows(spark, root)
    s = eras.era_steps(eras.dense_sets(rows, "company_id", "skill", ERA_NAMES), "company_id")
    shift = s.groupBy("company_id").agg(F.round(F.avg("change_ratio"), 6).alias("shift"))
    seen = rows.groupBy("company_id", "era").agg(F.count_distinct("posting_id").alias("n"), F.round(F.avg((F.col("tool") == "PROMO").cast("double")), 6).alias("ai"))
    seen = seen.withColumn("pos", F.array_position(F.array(*[F.lit(e) for e in ERA_NAMES]), F.col("era")))
    ends = seen.groupBy("company_id").agg(
        F.min_by("n", "pos").alias("n0"), F.max_by("n", "pos").alias("n1"), F.min_by("ai", "pos").alias("a0"), F.max_by("ai", "pos").alias("a1"), F.min("pos").alias("first"),
    )
    j = ends.join(shift, "company_id")
    labels = eras.patterns(F.col("shift"), (F.col("n1") - F.col("n0")) / F.col("n0"), F.col("a1") - F.col("a0"), F.col("a1"), (F.col("a0") == 0) & (F.col("a1") > 0), F.lit(False), F.col("first") > 1)
    return j.select("company_id", F.explode(labels).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("companies"))


def demand_share_by_region(spark, root):
    g = postings(spark, root).groupBy("week_start", "market").agg(F.count(F.lit(1)).alias("posting_count"))
    return g.withColumn("share", F.round(windows.share_of_total(g, "posting_count", "week_start"), 6))


def region_week_pivot(spark, root):
    p = postings(spark, root).filter((F.col("week_start") >= F.lit(WEEK)) & (F.col("week_start") <= F.lit(TARGET)))
    weeks = [WEEK + dt.timedelta(days=7 * i) for i in range(5)]
    out = p.groupBy("subregion").pivot("week_start", weeks).agg(F.count(F.lit(1)))
    return out.select("subregion", *[F.coalesce(F.col(str(w)), F.lit(0)).alias(f"w{i}") for i, w in enumerate(weeks)])


def sector_top3_sellers(spark, root):
    g = postings(spark, root).groupBy("sector", "company").agg(F.count(F.lit(1)).alias("n"))
    return windows.top_n(g, "sector", 3, F.desc("n"), F.asc("company"))


def latest_order_per_customer(spark, root):
    return windows.latest_per_key(table(spark, root, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


def latest_extraction_per_posting(spark, root):
    e = table(spark, root, "extracted_intelligence").filter(F.col("normalized_job_id").isNotNull()).dropDuplicates(["id"])
    return windows.latest_per_key(e, ["normalized_job_id"], "extracted_at", "id").select("normalized_job_id", "id", "extraction_version")


def last5_events_per_user(spark, root):
    e = table(spark, root, "events").select("user_id", "event_id", "event_type")
    return windows.last_turns(e, "user_id", "event_id", "event_type").select("user_id", F.array_join("turns", ",").alias("turns"))


def next_turn_index(spark, root):
    return table(spark, root, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("turns"), (F.max("event_id") + 1).alias("next_index"))


QUERIES = {f.__name__: f for f in (
    skill_demand_weekly, tool_demand_weekly, geo_demand_weekly, geo_demand_one_week, salary_percentiles_by_sector, salary_percentiles_by_source, role_snapshot_weekly, skill_co_occurrence_top200,
    tool_supplier_pairs, skill_velocity, role_evolution_eras, era_mix, era_tool_sets, era_aggregates, era_top_changes, era_patterns, demand_share_by_region, region_week_pivot, sector_top3_sellers,
    latest_order_per_customer, latest_extraction_per_posting, last5_events_per_user, next_turn_index,
)} | {"sector_summary_weekly": sector_summary_all}

_NUM = "CASE WHEN isnan({0}) THEN NULL ELSE {0} END"
_MID = f"""CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a + b) / 2 ELSE coalesce(b, a) END"""
_MIX = f"""{_ERA_ROWS}, totals AS (SELECT seniority, era, count(DISTINCT posting_id) AS total FROM era_rows GROUP BY ALL),
mix AS (SELECT seniority, era, skill AS label, round(count(DISTINCT posting_id) / any_value(total), 6) AS share FROM era_rows JOIN totals USING (seniority, era) GROUP BY seniority, era, skill)"""
_ERA_LIST = "(VALUES (0, 'first'), (1, 'second'), (2, 'third'), (3, 'fourth')) AS e(pos, era)"

SQL = {
    "skill_demand_weekly": f"WITH {sql.WEEKLY} SELECT week_start, label AS skill_label, posting_count, employer_count FROM weekly",
    "tool_demand_weekly": f"WITH {sql.ROWS} SELECT week_start, tool AS tool_label, count(DISTINCT posting_id) AS posting_count FROM skill_rows GROUP BY ALL",
    "geo_demand_weekly": f"WITH {sql.POST} SELECT week_start, trim(subregion) AS subregion, count(*) AS posting_count FROM post WHERE status <> 'P' GROUP BY ALL",
    "geo_demand_one_week": f"WITH {sql.POST} SELECT subregion, count(*) AS posting_count FROM post WHERE date_posted >= TIMESTAMP '{WEEK}' AND date_posted < TIMESTAMP '{WEEK}' + INTERVAL 7 DAY GROUP BY ALL",
    "sector_summary_weekly": f"""WITH {sql.POST}, {sql.ELEM},
agg AS (SELECT sector, count(*) AS posting_count, count(DISTINCT company) AS employer_count, quantile_disc(salary, 0.5) AS p50_salary FROM post GROUP BY sector HAVING count(*) >= 5),
cnt AS (SELECT sector, lower(trim(skill)) AS skill, count(*) AS cnt FROM post JOIN elem USING (posting_id) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY cnt DESC, skill) AS rn FROM cnt)
SELECT sector, posting_count, employer_count, p50_salary, (SELECT string_agg(skill, ',' ORDER BY rn) FROM rk WHERE rk.sector = agg.sector AND rn <= 10) AS top_skills FROM agg""",
    "salary_percentiles_by_sector": f"""WITH {sql.POST} SELECT trim(sector) AS grp, count(*) AS row_count, quantile_disc(salary, 0.25) AS p25, quantile_disc(salary, 0.5) AS p50, quantile_disc(salary, 0.75) AS p75,
quantile_disc(salary, 0.95) AS p95 FROM post WHERE trim(sector) <> '' AND salary IS NOT NULL GROUP BY ALL HAVING count(*) >= 50""",
    "salary_percentiles_by_source": f"""WITH n AS (SELECT lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))) AS grp, lower(trim(coalesce(salary_period, ''))) AS per, {_NUM.format('salary_min')} AS a, {_NUM.format('salary_max')} AS b FROM job_records),
m AS (SELECT grp, per, {_MID} AS v FROM n),
y AS (SELECT grp, CASE WHEN v IS NULL OR v <= 0 THEN NULL WHEN per IN ('hourly', 'hour', 'hr') THEN v * 2080 WHEN per IN ('monthly', 'month', 'mo') THEN v * 12 WHEN per IN ('weekly', 'week', 'wk') THEN v * 52 ELSE v END AS v FROM m)
SELECT grp, count(*) AS row_count, quantile_disc(v, 0.25) AS p25, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.75) AS p75, quantile_disc(v, 0.95) AS p95 FROM y WHERE v IS NOT NULL AND grp <> '' GROUP BY grp HAVING count(*) >= 20""",
    "role_snapshot_weekly": f"""WITH {sql.POST} SELECT week_start, seniority AS role, count(*) AS posting_count, round(avg(salary) + 1e-7, 4) AS avg_salary, quantile_disc(salary, 0.25) AS p25, quantile_disc(salary, 0.5) AS p50,
quantile_disc(salary, 0.75) AS p75, quantile_disc(salary, 0.95) AS p95 FROM post GROUP BY ALL""",
    "skill_co_occurrence_top200": f"""WITH {sql.ROWS}, d AS (SELECT DISTINCT posting_id, skill FROM skill_rows),
r AS (SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY skill) AS rn FROM d), c AS (SELECT * FROM r WHERE rn <= 20)
SELECT a.skill AS skill_a, b.skill AS skill_b, count(*) AS pair_count FROM c a JOIN c b ON a.posting_id = b.posting_id AND a.skill < b.skill GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 200""",
    "tool_supplier_pairs": f"""WITH {sql.ELEM} SELECT tool, n_name AS responsibility, count(*) AS pair_count FROM elem JOIN supplier ON supplier_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey
WHERE NOT failed GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 20""",
    "skill_velocity": f"WITH {sql.velocity(str(TARGET))} SELECT label, demand_count, change, trend FROM vel",
    "role_evolution_eras": f"WITH {sql.POST} SELECT {_ERA_SQL} AS era, subregion, seniority, count(DISTINCT posting_id) AS posting_count, count(DISTINCT company_id) AS employer_count FROM post GROUP BY ALL",
    "era_mix": f"WITH {_MIX} SELECT seniority, era, label, share FROM mix",
    "era_tool_sets": f"""WITH {_ERA_ROWS}, sets AS (SELECT company_id, era, list(DISTINCT tool) AS labels, count(DISTINCT posting_id) AS n FROM era_rows GROUP BY ALL),
d AS (SELECT c.company_id, e.pos, e.era, coalesce(s.labels, []::VARCHAR[]) AS labels, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT company_id FROM era_rows) c CROSS JOIN {_ERA_LIST} LEFT JOIN sets s ON s.company_id = c.company_id AND s.era = e.era),
w AS (SELECT *, lag(era) OVER o AS from_era, lag(labels) OVER o AS before, lag(n) OVER o AS n0 FROM d WINDOW o AS (PARTITION BY company_id ORDER BY pos)),
x AS (SELECT *, CAST(len(list_intersect(before, labels)) AS BIGINT) AS kept, CAST(len(labels) AS BIGINT) AS la, CAST(len(before) AS BIGINT) AS lb FROM w WHERE pos > 0)
SELECT company_id, from_era, era AS to_era, n0 AS postings_from, n AS postings_to, kept, la - kept AS added, lb - kept AS dropped, round(CASE WHEN la + lb - kept = 0 THEN 1.0 ELSE kept / (la + lb - kept) END, 6) AS jaccard,
round(1 - CASE WHEN la + lb - kept = 0 THEN 1.0 ELSE kept / (la + lb - kept) END, 6) AS change_ratio, round(CASE WHEN n0 > 0 THEN (n - n0) / n0 END, 6) AS demand_ratio FROM x""",
    "era_aggregates": f"""WITH {_ERA_ROWS}, per AS (SELECT seniority, era, posting_id, count(*) AS n, sum(CASE WHEN quantity > 25 THEN quantity END) AS q FROM era_rows GROUP BY ALL)
SELECT seniority, era, count(DISTINCT posting_id) AS posting_count, round(avg(q), 4) AS mean_quantity, round(avg(least(1.0::DOUBLE, greatest(0.0::DOUBLE, n / 20.0::DOUBLE))), 6) AS density FROM per GROUP BY ALL""",
    "era_top_changes": f"""WITH {_MIX}, d AS (SELECT l.seniority, l.label, e.pos, coalesce(m.share, 0.0) AS share FROM (SELECT DISTINCT seniority, label FROM mix) l CROSS JOIN {_ERA_LIST}
LEFT JOIN mix m ON m.seniority = l.seniority AND m.label = l.label AND m.era = e.era),
s AS (SELECT *, round(share - lag(share) OVER (PARTITION BY seniority, label ORDER BY pos), 6) AS delta FROM d),
p AS (SELECT seniority, label, round(sum(delta), 6) AS net_change, first(delta ORDER BY abs(delta) DESC, pos) AS max_step, count(*) FILTER (WHERE delta <> 0) AS changed_steps FROM s WHERE pos > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY seniority ORDER BY abs(net_change) DESC, abs(max_step) DESC, label DESC) AS rank FROM p)
SELECT seniority, CAST(rank AS INTEGER) AS rank, label, CASE WHEN net_change > 0 THEN 'increasing' WHEN net_change < 0 THEN 'decreasing' ELSE 'stable' END AS direction, net_change, max_step, changed_steps FROM r WHERE rank <= 5""",
    "era_patterns": f"""WITH {_ERA_ROWS}, sets AS (SELECT company_id, era, list(DISTINCT skill) AS labels FROM era_rows GROUP BY ALL),
d AS (SELECT c.company_id, e.pos, coalesce(s.labels, []::VARCHAR[]) AS labels FROM (SELECT DISTINCT company_id FROM era_rows) c CROSS JOIN {_ERA_LIST} LEFT JOIN sets s ON s.company_id = c.company_id AND s.era = e.era),
w AS (SELECT *, lag(labels) OVER (PARTITION BY company_id ORDER BY pos) AS before FROM d),
x AS (SELECT company_id, len(list_intersect(before, labels)) AS k, len(labels) AS la, len(before) AS lb FROM w WHERE pos > 0),
sh AS (SELECT company_id, round(avg(round(1 - CASE WHEN la + lb - k = 0 THEN 1.0 ELSE k / (la + lb - k) END, 6)), 6) AS shift FROM x GROUP BY ALL),
seen AS (SELECT company_id, era, count(DISTINCT posting_id) AS n, round(avg(CASE WHEN tool = 'PROMO' THEN 1.0 ELSE 0.0 END), 6) AS ai FROM era_rows GROUP BY ALL),
o AS (SELECT s.*, e.pos FROM seen s JOIN {_ERA_LIST} ON s.era = e.era),
ends AS (SELECT company_id, arg_min(n, pos) AS n0, arg_max(n, pos) AS n1, arg_min(ai, pos) AS a0, arg_max(ai, pos) AS a1, min(pos) AS first FROM o GROUP BY ALL),
j AS (SELECT *, (n1 - n0) / n0 AS dc, (a0 = 0 AND a1 > 0) AS fresh FROM ends JOIN sh USING (company_id)),
l AS (SELECT 'Transformation' AS pattern FROM j WHERE shift >= 0.30 UNION ALL SELECT 'Displacement' FROM j WHERE dc <= -0.10 AND (a1 - a0 >= 0.05 OR fresh)
UNION ALL SELECT 'Augmentation' FROM j WHERE dc >= -0.10 AND fresh UNION ALL SELECT 'Emergence' FROM j WHERE first > 0 AND a1 >= 0.25)
SELECT pattern, count(*) AS companies FROM l GROUP BY ALL""",
    "demand_share_by_region": f"""WITH {sql.POST}, g AS (SELECT week_start, market, count(*) AS posting_count FROM post GROUP BY ALL)
SELECT *, round(posting_count / sum(posting_count) OVER (PARTITION BY week_start), 6) AS share FROM g""",
    "region_week_pivot": "WITH " + sql.POST + " SELECT subregion, " + ", ".join(f"count(*) FILTER (WHERE week_start = DATE '{WEEK + dt.timedelta(days=7 * i)}') AS w{i}" for i in range(5)) + f" FROM post WHERE week_start BETWEEN DATE '{WEEK}' AND DATE '{TARGET}' GROUP BY ALL",
    "sector_top3_sellers": f"""WITH {sql.POST}, g AS (SELECT sector, company, count(*) AS n FROM post GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY sector ORDER BY n DESC, company) AS INTEGER) AS rank FROM g) SELECT * FROM r WHERE rank <= 3""",
    "latest_order_per_customer": "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
    "latest_extraction_per_posting": """SELECT normalized_job_id, id, extraction_version FROM (SELECT *, row_number() OVER (PARTITION BY normalized_job_id ORDER BY extracted_at DESC NULLS LAST, id DESC) AS rn
FROM (SELECT DISTINCT ON (id) * FROM extracted_intelligence) WHERE normalized_job_id IS NOT NULL) WHERE rn = 1""",
    "last5_events_per_user": """SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 5 GROUP BY ALL""",
    "next_turn_index": "SELECT user_id, count(*) AS turns, max(event_id) + 1 AS next_index FROM events GROUP BY ALL",
}

"""Common table expressions that the queries' SQL shares."""

POST = """post AS (
  SELECT o_orderkey AS posting_id, o_custkey AS company_id, c_name AS company, c_mktsegment AS sector, n_name AS subregion, r_name AS market,
         o_orderdate AS date_posted, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, o_orderpriority AS seniority, o_totalprice AS salary,
         o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
ELEM = """elem AS (
  SELECT l_orderkey AS posting_id, l_linenumber AS pos, p_brand AS skill, p_type AS tool, l_suppkey AS supplier_id, l_returnflag = 'R' AS failed,
         l_quantity AS quantity, p_name AS task
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
ROWS = f"""{POST}, {ELEM}, skill_rows AS (
  SELECT elem.*, company_id, company, sector, subregion, market, date_posted, week_start, seniority, salary, status
  FROM elem JOIN post USING (posting_id) WHERE NOT failed AND status <> 'P')"""
WEEKLY = f"""{ROWS}, weekly AS (
  SELECT week_start, skill AS label, count(DISTINCT posting_id) AS posting_count, count(DISTINCT company_id) AS employer_count
  FROM skill_rows GROUP BY ALL)"""


def velocity(target: str, weekly: str = WEEKLY) -> str:
    """`vel`: the velocity of each label for a week, over the weeks that have rows."""
    return f"""{weekly}, hist AS (
  SELECT label, week_start, CAST(sum(posting_count) AS BIGINT) AS n FROM weekly
  WHERE week_start IN (SELECT CAST(DATE '{target}' - INTERVAL (7 * i) DAY AS DATE) FROM range(5) r(i)) GROUP BY ALL),
weeks AS (SELECT DISTINCT week_start FROM hist
  UNION SELECT CAST(DATE '{target}' - INTERVAL (7 * i) DAY AS DATE) FROM range(5) r(i) WHERE NOT EXISTS (SELECT 1 FROM hist WHERE week_start = DATE '{target}')),
dense AS (SELECT l.label, w.week_start, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT label FROM hist) l CROSS JOIN weeks w LEFT JOIN hist h USING (label, week_start)),
means AS (SELECT *, CASE WHEN count(*) OVER o >= 2 THEN avg(n) OVER o END AS m FROM dense WINDOW o AS (PARTITION BY label ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
steps AS (SELECT *, lag(m) OVER (PARTITION BY label ORDER BY week_start) AS prev, row_number() OVER (PARTITION BY label ORDER BY week_start DESC) AS rn FROM means),
vel AS (SELECT label, CAST(CASE WHEN week_start = DATE '{target}' THEN n ELSE 0 END AS BIGINT) AS demand_count,
  CASE WHEN prev IS NULL OR prev = 0 THEN 0.0 ELSE round((m - prev) / prev, 6) END AS change,
  CASE WHEN prev IS NULL OR (prev = 0 AND m = 0) THEN 'emerging' WHEN prev = 0 THEN 'accelerating' WHEN (m - prev) / prev > 0.15 THEN 'accelerating'
       WHEN (m - prev) / prev < -0.15 THEN 'declining' WHEN abs((m - prev) / prev) <= 0.05 THEN 'stable' ELSE 'volatile' END AS trend
  FROM steps WHERE rn = 1)"""

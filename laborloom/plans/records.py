"""Queries: records, batches, quality, text, lookups, vectors, scores and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import elements, postings
from ..functions import dates, labels, text, vectors
from ..functions.money import parse_pay
from ..operators import checks, dedup, matching, mentions, scoring, similarity, upserts, windows
from ..operators.quantiles import quantiles
from ..operators.weekly import pair_table
from ..runtime import table

#: "Now" of the queries about age.
NOW = "2001-08-01 00:00:00"
_SRC = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
_SRC_SQL = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- repeats and batches -------------------------------------------------------------------------------------------


@query("""SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY lower(trim(source)), lower(trim(external_id)), lower(trim(title)), lower(trim(company)) ORDER BY ingestion_timestamp, id) AS rn FROM raw_ingested_jobs) WHERE rn > 1""")
def excess_duplicates(spark, root):
    r = table(spark, root, "raw_ingested_jobs")
    keys = [F.lower(F.trim(c)) for c in ("source", "external_id", "title", "company")]
    return windows.excess(r, keys, [F.asc_nulls_last("ingestion_timestamp"), F.asc("id")]).select("id")


_FP = "sha256(lower(trim(coalesce(external_id, 'none'))) || '|' || lower(trim(coalesce(title, 'none'))) || '|' || lower(trim(coalesce(company, 'none'))))"
_SH = "sha256(lower(trim(coalesce(source, 'none'))) || '|' || lower(trim(coalesce(external_id, 'none'))) || '|' || lower(trim(coalesce(title, 'none'))) || '|' || lower(trim(coalesce(company, 'none'))))"


@query(f"""SELECT id, fingerprint FROM (SELECT r.id, {_FP} AS fingerprint, row_number() OVER (PARTITION BY r.ingestion_run_id, {_FP} ORDER BY coalesce(s.trust_rank, 99), r.id) AS rn
FROM raw_ingested_jobs r LEFT JOIN job_sources s ON s.source = {_SRC_SQL.format('r.source')}) WHERE rn = 1""".replace("external_id", "r.external_id").replace("title", "r.title").replace("company", "r.company"))  # fmt: skip
def batch_dedup_priority(spark, root):
    r = dedup.with_hashes(table(spark, root, "raw_ingested_jobs"))
    s = table(spark, root, "job_sources").select(F.col("source").alias("__s"), "trust_rank")
    ranked = r.join(s, _SRC("source") == F.col("__s"), "left")
    return dedup.batch_survivors(ranked, ["ingestion_run_id", "fingerprint"], F.coalesce("trust_rank", F.lit(99)), "id").select("id", "fingerprint")


@query(f"""WITH h AS (SELECT id, ingestion_run_id, {_SH} AS h FROM raw_ingested_jobs), last AS (SELECT max(ingestion_run_id) AS run FROM raw_ingested_jobs)
SELECT id FROM h, last WHERE ingestion_run_id = run AND NOT EXISTS (SELECT 1 FROM h o WHERE o.ingestion_run_id < last.run AND o.h = h.h)""")
def cross_batch_new_rows(spark, root):
    r = dedup.with_hashes(table(spark, root, "raw_ingested_jobs")).select("id", "ingestion_run_id", "storage_hash")
    last = r.agg(F.max("ingestion_run_id").alias("run"))
    batch = r.join(F.broadcast(last), F.col("ingestion_run_id") == F.col("run")).select("id", "storage_hash")
    earlier = r.join(F.broadcast(last), F.col("ingestion_run_id") < F.col("run")).select("storage_hash")
    return dedup.new_rows(batch, earlier, "storage_hash").select("id")


@query("""SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)""")
def orphan_dimension_rows(spark, root):
    return checks.orphans(table(spark, root, "part"), table(spark, root, "lineitem"), "p_partkey", "l_partkey").select("p_partkey")


@query("""WITH a AS (SELECT o_orderkey AS k, 1 AS n FROM orders), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL)
SELECT count(*) AS keys, count(*) FILTER (WHERE a.n IS DISTINCT FROM b.n) AS differing, count(*) FILTER (WHERE a.n IS DISTINCT FROM b.n) / count(*) AS share FROM a FULL JOIN b USING (k)""")
def reconcile_counts(spark, root):
    a = table(spark, root, "orders").select(F.col("o_orderkey").alias("k"), F.lit(1).cast("long").alias("n"))
    b = table(spark, root, "lineitem").filter("l_linenumber <= 4").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return checks.drift(a, b, ["k"], "n")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("job_records", "raw_ingested_jobs", "extracted_intelligence", "documents")))
def union_counts(spark, root):
    out = None
    for t in ("job_records", "raw_ingested_jobs", "extracted_intelligence", "documents"):
        one = table(spark, root, t).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH c AS (SELECT o_custkey, count(*) AS c FROM orders GROUP BY ALL) SELECT count(*) AS keys, CAST(sum(c) AS BIGINT) AS n_rows, round(avg(c), 6) AS mean_rows, max(c) AS most_rows, CAST(sum(c - 1) AS BIGINT) AS excess_rows FROM c""")
def fanout_audit(spark, root):
    return checks.fan_out(table(spark, root, "orders"), "o_custkey")


_JR = ["job_id", "external_id", "source", "region_id", "raw_payload_hash", "title", "company", "description", "city", "state", "country", "is_remote", "date_posted", "date_ingested", "salary_raw", "salary_min", "salary_max", "salary_currency", "salary_period", "employment_type", "experience_level", "job_url", "source_url", "raw_payload"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL{f' OR isnan({c})' if c in ('salary_min', 'salary_max') else ''}) AS n_null, round(count(*) FILTER (WHERE {c} IS NULL{f' OR isnan({c})' if c in ('salary_min', 'salary_max') else ''}) / count(*), 6) AS null_rate FROM job_records" for c in _JR))
def dq_null_rates(spark, root):
    return checks.null_rates(table(spark, root, "job_records").select(*_JR))


@query("""SELECT CAST(c AS BIGINT) AS distinct_sources, CAST(p AS BIGINT) AS employers_with_types FROM (SELECT count(DISTINCT lower(trim(source))) AS c FROM job_records),
(SELECT count(*) AS p FROM (SELECT lower(trim(company)) AS co FROM job_records WHERE company IS NOT NULL GROUP BY 1 HAVING count(DISTINCT employment_type) >= 3))""")
def employers_with_types(spark, root):
    jr = table(spark, root, "job_records")
    a = jr.agg(F.count_distinct(F.lower(F.trim("source"))).alias("distinct_sources"))
    b = jr.filter("company IS NOT NULL").groupBy(F.lower(F.trim("company")).alias("co")).agg(F.count_distinct("employment_type").alias("t")).filter("t >= 3").agg(F.count(F.lit(1)).alias("employers_with_types"))
    return a.join(F.broadcast(b), F.lit(True))


# ---- counts and ratios -----------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT o_totalprice AS v FROM orders WHERE o_totalprice IS NOT NULL), e AS (SELECT min(v) AS lo, max(v) AS hi FROM r)
SELECT CASE WHEN v = hi THEN 11 ELSE CAST(floor((v - lo) / ((hi - lo) / 10)) AS BIGINT) + 1 END AS bin, round(any_value(lo) + (CASE WHEN v = hi THEN 11 ELSE CAST(floor((v - lo) / ((hi - lo) / 10)) AS BIGINT) + 1 END - 1) * (any_value(hi) - any_value(lo)) / 10, 4) AS bin_start, count(*) AS n
FROM r, e GROUP BY bin""")  # fmt: skip
def histogram_price(spark, root):
    return checks.histogram(table(spark, root, "orders"), "o_totalprice")


@query("SELECT o_orderstatus, quantile_cont(o_totalprice, 0.5) AS median_price FROM orders GROUP BY ALL")
def median_price(spark, root):
    return quantiles(table(spark, root, "orders"), ["o_orderstatus"], "o_totalprice", {"median_price": 0.5}, between=True).select("o_orderstatus", "median_price")


@query("""WITH j AS (SELECT *, CASE WHEN is_remote THEN 'remote' WHEN NOT is_remote THEN 'on site' ELSE 'unknown' END AS r FROM job_records),
c AS (SELECT 'source' AS field, lower(trim(source)) AS value FROM j UNION ALL SELECT 'city', city FROM j UNION ALL SELECT 'state', state FROM j UNION ALL SELECT 'remote', r FROM j UNION ALL SELECT 'type', employment_type FROM j UNION ALL SELECT 'level', experience_level FROM j),
g AS (SELECT field, value, count(*) AS n FROM c WHERE value IS NOT NULL GROUP BY ALL) SELECT field, value, n FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rn FROM g) WHERE rn <= 15""")  # fmt: skip
def category_counts(spark, root):
    jr = table(spark, root, "job_records")
    remote = F.when(F.col("is_remote"), "remote").when(~F.col("is_remote"), "on site").otherwise("unknown")
    cats = {"source": F.lower(F.trim("source")), "city": F.col("city"), "state": F.col("state"), "remote": remote, "type": F.col("employment_type"), "level": F.col("experience_level")}
    long = jr.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in cats.items()])).alias("x")).select("x.*").filter("value IS NOT NULL")
    g = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return windows.top_n(g, "field", 15, F.desc("n"), F.asc("value")).select("field", "value", "n")


@query("""SELECT l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_discount > 0.05) AS discounted,
CAST(sum(CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM lineitem GROUP BY ALL""")
def conditional_counts(spark, root):
    return table(spark, root, "lineitem").groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.sum(F.when(F.col("l_quantity") >= 25, 1).otherwise(0)).alias("large"),
    )


@query(f"""SELECT {_SRC_SQL.format('source')} AS source, round(CAST(sum(total_fetched - staged_count) AS DOUBLE) / nullif(sum(total_fetched), 0) * 100, 4) AS dropped_pct, round(CAST(sum(error_count) AS DOUBLE) / nullif(sum(total_fetched), 0) * 100, 4) AS error_pct,
round(CAST(count(*) FILTER (WHERE completed_at IS NOT NULL) AS DOUBLE) / count(*) * 100, 4) AS finished_pct FROM job_ingestion_runs GROUP BY 1""")
def ratio_metrics(spark, root):
    r = table(spark, root, "job_ingestion_runs").withColumn("source", _SRC("source"))
    g = r.groupBy("source").agg(F.sum(F.col("total_fetched") - F.col("staged_count")).alias("d"), F.sum("total_fetched").alias("t"), F.sum("error_count").alias("e"), F.count_if(F.col("completed_at").isNotNull()).alias("f"), F.count(F.lit(1)).alias("n"))
    return g.select("source", checks.ratio(F.col("d"), F.col("t")).alias("dropped_pct"), checks.ratio(F.col("e"), F.col("t")).alias("error_pct"), checks.ratio(F.col("f"), F.col("n")).alias("finished_pct"))


@query("""SELECT extraction_model AS model, count(*) AS calls, CAST(coalesce(sum(extraction_tokens_used), 0) AS BIGINT) AS tokens, round(coalesce(sum(CASE WHEN isnan(extraction_cost_usd) THEN NULL ELSE extraction_cost_usd END), 0), 4) AS cost,
count(*) FILTER (WHERE extraction_failed) AS failed FROM extracted_intelligence GROUP BY ALL""")
def cost_by_model(spark, root):
    e = table(spark, root, "extracted_intelligence")
    cost = F.when(~F.isnan("extraction_cost_usd"), F.col("extraction_cost_usd"))
    return e.groupBy(F.col("extraction_model").alias("model")).agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("extraction_tokens_used"), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.sum(cost), F.lit(0.0)), 4).alias("cost"), F.count_if("extraction_failed").alias("failed"))


@query("SELECT CAST(CAST(date_trunc('month', started_at AT TIME ZONE 'UTC') AS DATE) AS VARCHAR) AS month, CAST(sum(api_requests_used) AS BIGINT) AS requests FROM job_ingestion_runs WHERE started_at IS NOT NULL GROUP BY 1")
def monthly_requests(spark, root):
    r = table(spark, root, "job_ingestion_runs").filter("started_at IS NOT NULL")
    return r.groupBy(F.to_date(F.date_trunc("month", "started_at")).cast("string").alias("month")).agg(F.sum("api_requests_used").alias("requests"))


@query("""WITH d AS (SELECT epoch_ms(completed_at) - epoch_ms(started_at) AS ms FROM job_ingestion_runs WHERE completed_at IS NOT NULL AND started_at IS NOT NULL)
SELECT count(*) AS n, round(quantile_cont(ms, 0.5), 3) AS p50, round(quantile_cont(ms, 0.95), 3) AS p95, round(quantile_cont(ms, 0.99), 3) AS p99 FROM d""")
def run_latency(spark, root):
    d = table(spark, root, "job_ingestion_runs").select((F.unix_millis("completed_at") - F.unix_millis("started_at")).alias("ms")).dropna()
    q = quantiles(d, [], "ms", {f"p{int(q * 100)}": q for q in (0.5, 0.95, 0.99)}, between=True)
    return q.select(F.col("row_count").alias("n"), *[F.round(c, 3).alias(c) for c in ("p50", "p95", "p99")])


@query(f"""WITH g AS (SELECT {_SRC_SQL.format('source')} AS source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS rn FROM g)
SELECT CASE WHEN rn <= 10 THEN source ELSE 'Other' END AS source, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def overflow_other(spark, root):
    g = table(spark, root, "documents").filter("source IS NOT NULL").groupBy(_SRC("source").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    top = g.orderBy(F.desc("n"), "source").limit(10).select(F.col("source").alias("kept"))
    named = g.join(F.broadcast(top), F.col("source") == F.col("kept"), "left").withColumn("source", F.coalesce("kept", F.lit("Other")))
    return named.groupBy("source").agg(F.sum("n").alias("n"))


# ---- events ------------------------------------------------------------------------------------------------------------


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1")
def daily_volume(spark, root):
    return table(spark, root, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def weekly_tumbling(spark, root):
    e = table(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "7 days", "7 days", "4 days").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.to_date("w.start").cast("string").alias("week_start"), "event_type", "n", "total")


@query("""WITH d AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS w FROM events), s AS (SELECT DISTINCT CAST(w - INTERVAL (7 * i) DAY AS DATE) AS start FROM d, range(4) r(i))
SELECT CAST(start AS VARCHAR) AS start, count(*) AS n FROM s JOIN events ON ts >= start AND ts < start + INTERVAL 28 DAY GROUP BY 1""")
def sliding_28d(spark, root):
    e = table(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "28 days", "7 days", "4 days").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").cast("string").alias("start"), "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def user_sessions(spark, root):
    e = table(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY ALL")
def json_props(spark, root):
    e = table(spark, root, "events").withColumn("p", F.from_json("props", "k int"))
    return e.filter("p.k IS NOT NULL").groupBy("event_type", F.col("p.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


# ---- text and labels -----------------------------------------------------------------------------------------------------


@query("""SELECT id, trim(regexp_replace(regexp_replace(coalesce(description, ''), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS plain, trim(regexp_replace(regexp_replace(coalesce(description, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS spaced FROM raw_ingested_jobs""")
def text_normalize(spark, root):
    r = table(spark, root, "raw_ingested_jobs")
    return r.select("id", text.clean_text(F.col("description")).alias("plain"), text.tags_to_blanks(F.col("description")).alias("spaced"))


@query("""SELECT id, sha256(concat_ws(' | ', nullif(t, ''), nullif(c, ''), nullif(trim(substr(b, 1, 500)), ''))) AS text_hash FROM (SELECT id, trim(regexp_replace(regexp_replace(coalesce(title, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t,
trim(regexp_replace(regexp_replace(coalesce(company, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS c, trim(regexp_replace(regexp_replace(coalesce(description, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS b FROM raw_ingested_jobs)""")
def dedup_text_hash(spark, root):
    r = table(spark, root, "raw_ingested_jobs")
    return r.select("id", F.sha2(text.dedup_text(F.col("title"), F.col("company"), F.col("description")), 256).alias("text_hash"))


_EMP = " ".join(f"WHEN k IN ({', '.join(repr(w) for w in ws)}) THEN '{n}'" for n, ws in labels.EMPLOYMENT.items())


@query(f"""WITH k AS (SELECT job_id, ltrim(replace(lower(trim(employment_type)), '''', ''), 'n') AS k FROM job_records) SELECT t AS employment_type, count(*) AS n FROM (SELECT CASE {_EMP} ELSE 'unknown' END AS t FROM k) GROUP BY 1""")
def employment_types(spark, root):
    return table(spark, root, "job_records").groupBy(labels.employment_type(F.col("employment_type")).alias("employment_type")).agg(F.count(F.lit(1)).alias("n"))


_EXP = " ".join(f"WHEN upper(trim(experience_level)) IN ({', '.join(repr(w) for w in ws)}) THEN '{n}'" for n, ws in labels.EXPERIENCE.items())
_SEN = lambda c: "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce({c}, '')), '{p}') THEN '{n}'" for n, p in labels.SENIORITY_WORDS) + " END"


@query(f"""SELECT job_id, coalesce(CASE {_EXP} END, {_SEN('title')}, {_SEN('description')}, CASE WHEN regexp_matches(lower(title), '\\b(engineer|developer|scientist|analyst|architect|programmer)\\b') THEN 'mid' END, 'unknown') AS seniority FROM job_records""")
def seniority_cascade(spark, root):
    return table(spark, root, "job_records").select("job_id", labels.seniority(F.col("experience_level"), F.col("title"), F.col("description")).alias("seniority"))


@query("""WITH p AS (SELECT job_id, translate(lower(trim(coalesce(city, ''))), 'áéíóú', 'aeiou') AS c, lower(trim(coalesce(state, ''))) AS s, lower(trim(coalesce(country, ''))) AS n, coalesce(is_remote, false) AS r FROM job_records)
SELECT job_id, CASE WHEN r THEN 'regional' WHEN c = 'el paso' AND s IN ('tx', 'texas') AND n IN ('', 'us', 'usa', 'u.s.', 'u.s.a.', 'united states', 'united states of america') THEN 'el_paso'
WHEN c = 'las cruces' AND s IN ('nm', 'new mexico') AND n IN ('', 'us', 'usa', 'u.s.', 'u.s.a.', 'united states', 'united states of america') THEN 'las_cruces'
WHEN c IN ('ciudad juarez', 'juarez') AND s NOT IN ('tx', 'texas', 'nm', 'new mexico') AND n NOT IN ('us', 'usa', 'u.s.', 'u.s.a.', 'united states', 'united states of america') AND (n IN ('mx', 'mex', 'mexico') OR s IN ('chihuahua', 'chih', 'chihuahua state')) THEN 'ciudad_juarez' ELSE 'regional' END AS subregion FROM p""")
def subregions(spark, root):
    return table(spark, root, "job_records").select("job_id", labels.subregion(F.col("city"), F.col("state"), F.col("country"), F.col("is_remote")).alias("subregion"))


@query("""WITH c AS (SELECT job_id, trim(coalesce(title, '') || ' ' || coalesce(description, '')) AS c FROM job_records), s AS (SELECT job_id, CASE WHEN length(c) < 35 THEN 0.88 WHEN regexp_matches(lower(c), '\\b(click here|earn \\$\\d|bitcoin|crypto airdrop)\\b') THEN 0.92 WHEN contains(lower(c), 'work from home') AND length(c) < 120 THEN 0.78 ELSE 0.45 END AS score FROM c)
SELECT CASE WHEN score < 0.7 THEN 'clean' WHEN score <= 0.9 THEN 'flagged' ELSE 'rejected' END AS tier, count(*) AS n FROM s GROUP BY 1""")
def spam_tiers(spark, root):
    jr = table(spark, root, "job_records").withColumn("score", labels.offline_spam_score(F.col("title"), F.col("description")))
    return jr.groupBy(labels.spam_tier(F.col("score"))["tier"].alias("tier")).agg(F.count(F.lit(1)).alias("n"))


_QUALITY = f"""WITH t AS (SELECT job_id, trim(coalesce(title, '')) AS ti, trim(coalesce(description, '')) AS de, lower(concat_ws(' ', title, description)) AS corpus, [x FOR x IN regexp_extract_all(lower(concat_ws(' ', title, description)), '[a-z0-9]+') IF length(x) >= 2] AS w FROM job_records),
u AS (SELECT *, len(w) AS n, len(list_distinct(w)) / greatest(len(w), 1) AS ratio, [x FOR x IN regexp_split_to_array(de, '\\r?\\n') IF trim(x) <> ''] AS lines FROM t),
c AS (SELECT *, 0.28 * least(1, length(ti) / 24.0) + 0.42 * least(1, length(de) / 1400.0) AS complete, least(1, n / 90.0) * 0.45 + least(1, ratio / 0.55) * 0.55 AS base, len([x FOR x IN lines IF regexp_matches(x, '^\\s*([-*•]|\\d+[.)])\\s+\\S')]) AS items,
len([x FOR x IN w IF x IN ({', '.join(repr(x) for x in labels.TECH_WORDS if ' ' not in x)})]) + {' + '.join(f"(CASE WHEN contains(' ' || corpus || ' ', '{x}') THEN 1 ELSE 0 END)" for x in labels.TECH_WORDS if ' ' in x)} AS hits FROM u),
s AS (SELECT job_id, complete, CASE WHEN n = 0 THEN 0 WHEN n < 8 THEN 0.25 + n / 8.0 * 0.45 ELSE least(1, CASE WHEN n > 12 AND ratio < 0.28 THEN base * 0.75 ELSE base END) END AS clear, least(1, 0.58 + 0.42 * least(1, hits * 2.5 / greatest(n, 1))) AS ai,
CASE WHEN de = '' THEN 0 ELSE least(1, CASE WHEN len(lines) >= 5 THEN 0.38 WHEN len(lines) >= 3 THEN 0.26 WHEN len(lines) >= 2 THEN 0.16 ELSE 0 END + CASE WHEN items >= 3 THEN 0.34 WHEN items >= 1 THEN 0.20 ELSE 0 END
+ CASE WHEN regexp_matches(lower(de), '\\b(responsibilities|qualifications|requirements|what you will|who you are|benefits|about (the )?role|skills required)\\b') THEN 0.28 ELSE 0 END) END AS struct FROM c)
SELECT job_id, round(1e-7 + CAST(complete AS DOUBLE), 5) AS completeness, round(1e-7 + CAST(clear AS DOUBLE), 5) AS clarity, round(1e-7 + CAST(ai AS DOUBLE), 5) AS tech_density, round(1e-7 + CAST(struct AS DOUBLE), 5) AS structure, round(1e-7 + CAST(0.30 * complete + 0.30 * clear + 0.10 * ai + 0.30 * struct AS DOUBLE), 5) AS quality FROM s"""


@query(_QUALITY)
def quality_scores(spark, root):
    jr = table(spark, root, "job_records")
    parts = labels.quality(F.col("title"), F.col("description"), F.lit(0), F.lit(False))
    return jr.select("job_id", *[F.round(parts[c] + 1e-7, 5).alias(c) for c in ("completeness", "clarity", "tech_density", "structure", "quality")])


@query("""SELECT filled, count(*) AS n FROM (SELECT CASE WHEN trim(salary_raw) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(city) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(state) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(country) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(description) <> '' THEN 1 ELSE 0 END AS filled FROM job_records) GROUP BY 1""")
def filled_fields(spark, root):
    jr = table(spark, root, "job_records")
    return jr.groupBy(labels.filled(*[F.col(c) for c in ("salary_raw", "city", "state", "country", "description")]).alias("filled")).agg(F.count(F.lit(1)).alias("n"))


@query()
def simple_pay(spark, root):
    p = table(spark, root, "job_records").select("job_id", parse_pay(F.col("salary_raw")).alias("p"))
    return p.select("job_id", "p.*").filter("low IS NOT NULL")


@query()
def ordered_date_formats(spark, root):
    jr = table(spark, root, "job_records").select("job_id", dates.parse_date(F.col("date_posted")).alias("posted"))
    return jr.filter("posted IS NOT NULL").select("job_id", dates.week_of(F.col("posted")).cast("string").alias("week_start"), dates.era_of(F.col("posted")).alias("era"))


@query(f"""WITH d AS (SELECT CAST(floor((epoch(TIMESTAMP '{NOW}') - epoch(o_orderdate)) / 86400) AS INTEGER) AS days FROM orders) SELECT CASE WHEN greatest(days, 0) <= 30 THEN 'fresh' WHEN greatest(days, 0) <= 90 THEN 'stale' ELSE 'expired' END AS freshness, count(*) AS n FROM d GROUP BY 1""")
def freshness_buckets(spark, root):
    days = dates.whole_days(F.col("o_orderdate"), F.lit(NOW).cast("timestamp"))
    return table(spark, root, "orders").groupBy(dates.freshness(days).alias("freshness")).agg(F.count(F.lit(1)).alias("n"))


_SIGNALS = " UNION ALL ".join(f"SELECT job_id, '{f}' AS family, unnest(regexp_extract_all(lower(concat_ws('. ', title, description)), '({p})', 1)) AS signal, {c} AS confidence FROM job_records" for f, (p, c) in mentions.CONTEXT.items())


@query(f"SELECT job_id, family, signal, count(*) AS n, CAST(confidence AS DOUBLE) AS confidence FROM ({_SIGNALS}) GROUP BY ALL")
def context_signals(spark, root):
    return mentions.context_signals(table(spark, root, "job_records").select("job_id", F.concat_ws(". ", "title", "description").alias("t")), "job_id", "t")


@query()
def tool_mentions(spark, root):
    """Mentions in documents of the tools that extraction has found, at most MOST_NAMES names."""
    e = table(spark, root, "extracted_intelligence").select(F.explode("tools").alias("t")).select(F.trim(F.coalesce("t.tool_name", "t.label")).alias("name"))
    names = [r[0] for r in e.filter("name <> ''").groupBy(F.lower("name").alias("l")).agg(F.min("name").alias("name")).select("name").limit(mentions.MOST_NAMES + 1).collect()]
    return mentions.name_mentions(table(spark, root, "documents"), "doc_id", ["text"], [(n, n) for n in names]).drop("around")


@query("""WITH e AS (SELECT id, skills FROM (SELECT DISTINCT ON (id) * FROM extracted_intelligence)), n AS (SELECT id, skills IS NULL AS missing, len(skills) = 0 AS none FROM e), x AS (SELECT id, unnest(skills) AS s FROM e),
l AS (SELECT id, lower(trim(coalesce(s.skill_name, s.label, ''))) AS nm, s.confidence AS c FROM x), a AS (SELECT id, bool_or(nm = '') AS blank, coalesce(bool_or(c < 0 OR c > 1 OR isnan(c)), false) AS rng, coalesce(bool_or(c < 0.75 AND NOT isnan(c)), false) AS low, count(DISTINCT nm) < count(*) AS rep FROM l GROUP BY id),
w AS (SELECT 'missing' AS warning FROM n WHERE missing UNION ALL SELECT 'empty' FROM n WHERE none UNION ALL SELECT 'blank_name' FROM a WHERE blank UNION ALL SELECT 'confidence_range' FROM a WHERE rng UNION ALL SELECT 'low_confidence' FROM a WHERE low UNION ALL SELECT 'repeated_name' FROM a WHERE rep)
SELECT warning, count(*) AS n FROM w GROUP BY 1""")  # fmt: skip
def extraction_warnings(spark, root):
    e = table(spark, root, "extracted_intelligence").dropDuplicates(["id"])
    return e.select(F.explode(mentions.extraction_warnings("skills")).alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(CASE WHEN NOT coalesce(trim(title) <> '', false) THEN 'title' WHEN NOT coalesce(trim(company) <> '', false) THEN 'company' WHEN a IS NOT NULL AND b IS NOT NULL AND b < a THEN 'salary' END, 'valid') AS outcome, count(*) AS n
FROM (SELECT *, CASE WHEN isnan(salary_min) THEN NULL ELSE salary_min END AS a, CASE WHEN isnan(salary_max) THEN NULL ELSE salary_max END AS b FROM job_records) GROUP BY 1""")
def quarantine_counts(spark, root):
    jr = table(spark, root, "job_records").withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("salary_min", "salary_max")})
    ok, bad = upserts.quarantine(jr, {"title": F.trim("title") != "", "company": F.trim("company") != "", "salary": F.coalesce(F.col("salary_max") >= F.col("salary_min"), F.lit(True))})
    return ok.agg(F.lit("valid").alias("outcome"), F.count(F.lit(1)).alias("n")).filter("n > 0").unionByName(bad.groupBy(F.col("error_type").alias("outcome")).agg(F.count(F.lit(1)).alias("n")))


# ---- lookups ---------------------------------------------------------------------------------------------------------------

_CK = lambda c: f"trim(regexp_replace(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '((,\\s*|\\s+)(corporation|incorporated|limited|llc|llp|corp|inc|ltd|lp|co)\\.?[ ,]*)+$', ''))"


@query(f"""WITH a AS (SELECT DISTINCT company, {_CK('company')} AS k FROM job_records WHERE company IS NOT NULL), b AS (SELECT DISTINCT {_CK('company')} AS k FROM raw_ingested_jobs WHERE company IS NOT NULL) SELECT a.company, b.k IS NOT NULL AS known FROM a LEFT JOIN b USING (k)""")
def company_exact_match(spark, root):
    a = table(spark, root, "job_records").select("company").dropna().distinct().withColumn("k", text.company_key(F.col("company")))
    b = table(spark, root, "raw_ingested_jobs").select(text.company_key(F.col("company")).alias("k")).dropna().distinct().withColumn("known", F.lit(True))
    return a.join(b, "k", "left").select("company", F.coalesce("known", F.lit(False)).alias("known"))


@query()
def company_resolution(spark, root):
    """Employers of postings looked up in those of the staging table: exactly, else by likeness, else a placeholder."""
    catalog = table(spark, root, "raw_ingested_jobs").groupBy(text.company_key(F.col("company")).alias("name")).agg(F.min("id").alias("cid")).dropna()
    jr = table(spark, root, "job_records").select("job_id", "company")
    keys = jr.select("company", text.company_key(F.col("company")).alias("k")).dropna().distinct()
    entries = [(str(r["cid"]), r["name"]) for r in catalog.limit(matching.SMALL + 1).collect()]
    near = matching.fuzzy_matches(keys.join(catalog.select(F.col("name").alias("k")), "k", "left_anti"), "k", entries)
    return matching.resolve_names(jr, "company", text.company_key, catalog, "cid", "name", keys.join(near, "k").drop("k")).select("job_id", "resolved_id", "confidence")


@query()
def fuzzy_titles(spark, root):
    """Nation names with a typing error looked up among all nations by likeness."""
    n = [(str(r[0]), r[1]) for r in table(spark, root, "nation").select("n_nationkey", "n_name").limit(matching.SMALL + 1).collect()]
    wrong = table(spark, root, "nation").select(F.concat(F.substring("n_name", 1, 3), F.lit("x"), F.substring("n_name", 4, 60)).alias("name"))
    return matching.fuzzy_best(wrong, "name", n)


@query("""WITH cs AS (SELECT lower(city) || ',' || lower(state) AS k, min(region_id) AS v FROM raw_ingested_jobs WHERE region_id IS NOT NULL GROUP BY 1), c AS (SELECT lower(city) AS k, min(region_id) AS v FROM raw_ingested_jobs WHERE region_id IS NOT NULL GROUP BY 1)
SELECT j.job_id, CASE WHEN cs.v IS NOT NULL THEN 1 WHEN c.v IS NOT NULL THEN 2 ELSE 0 END AS step, coalesce(cs.v, c.v) AS found FROM job_records j LEFT JOIN cs ON cs.k = lower(j.city) || ',' || lower(j.state) LEFT JOIN c ON c.k = lower(j.city)""")
def location_cascade(spark, root):
    r = table(spark, root, "raw_ingested_jobs").filter("region_id IS NOT NULL")
    both = r.groupBy(F.concat(F.lower("city"), F.lit(","), F.lower("state")).alias("k")).agg(F.min("region_id").alias("v"))
    city = r.groupBy(F.lower("city").alias("k")).agg(F.min("region_id").alias("v"))
    jr = table(spark, root, "job_records").select("job_id", "city", "state")
    return matching.cascade_lookup(jr, [(F.concat(F.lower("city"), F.lit(","), F.lower("state")), both), (F.lower("city"), city)]).select("job_id", F.coalesce("step", F.lit(0)).alias("step"), "found")


@query("""WITH w AS (SELECT DISTINCT title, unnest(list_slice(list_distinct_ordered, 1, 4)) AS w FROM (SELECT title, [x FOR x, i IN l IF length(x) >= 4 AND list_position(l, x) = i] AS list_distinct_ordered FROM (SELECT DISTINCT title, regexp_split_to_array(lower(title), '[^\\p{L}]+') AS l FROM job_records WHERE title IS NOT NULL))),
e AS (SELECT value_id, lower(canonical) AS l, unnest(list_distinct(regexp_split_to_array(lower(canonical), '[^\\p{L}]+'))) AS w FROM canonical_values WHERE field_name = 'title'), h AS (SELECT title, value_id, CAST(sum(CASE WHEN starts_with(l, w) THEN 2 ELSE 1 END) AS BIGINT) AS score FROM w JOIN e USING (w) GROUP BY ALL)
SELECT title, value_id, score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY score DESC, value_id) AS rn FROM h) WHERE rn <= 5""")
def catalog_candidates(spark, root):
    titles = table(spark, root, "job_records").select("title").dropna().distinct()
    codes = table(spark, root, "canonical_values").filter("field_name = 'title'")
    return matching.catalog_candidates(titles, "title", "title", codes, "value_id", "canonical", 5)


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), '\\b(nurse|clinic|patient)') THEN 'health' WHEN regexp_matches(lower(coalesce(text, '')), '\\b(warehouse|forklift|pallet)') THEN 'logistics' WHEN regexp_matches(lower(coalesce(text, '')), '\\b(software|data|network)') THEN 'technology' END AS theme FROM documents""")
def document_themes(spark, root):
    themes = [("health", r"\b(nurse|clinic|patient)"), ("logistics", r"\b(warehouse|forklift|pallet)"), ("technology", r"\b(software|data|network)")]
    return matching.first_theme(table(spark, root, "documents"), "text", themes).select("doc_id", "theme")


@query("""WITH a AS (SELECT city, state, count(*) AS n FROM job_records GROUP BY ALL), b AS (SELECT city, state, count(*) AS m FROM raw_ingested_jobs GROUP BY ALL) SELECT a.city, a.state, n, m FROM a JOIN b ON a.city = b.city AND a.state IS NOT DISTINCT FROM b.state""")
def null_safe_merge(spark, root):
    a = table(spark, root, "job_records").groupBy("city", "state").agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, root, "raw_ingested_jobs").groupBy(F.col("city").alias("c"), F.col("state").alias("s")).agg(F.count(F.lit(1)).alias("m"))
    return a.join(b, (F.col("city") == F.col("c")) & F.col("state").eqNullSafe(F.col("s"))).select("city", "state", "n", "m")


# ---- vectors ---------------------------------------------------------------------------------------------------------------


@query("""WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) > 0.35""")
def near_dup_pairs(spark, root):
    return similarity.pairs_in_block(table(spark, root, "embeddings"), "label", "vec_id", "embedding", 0.35).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("""WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, r.vec_id, list_cosine_similarity(q.v, r.v) AS sim FROM u q JOIN u r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5""")
def knn_topk(spark, root):
    e = table(spark, root, "embeddings")
    return similarity.knn(e, "vec_id", "embedding", e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5).select("query_id", "vec_id", "rank")


_CENT = """u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT label, unnest(range(1, len(v) + 1)) AS pos, unnest(v) AS x FROM u), m AS (SELECT label, pos, avg(x) AS m FROM l GROUP BY ALL), c AS (SELECT label, list(m ORDER BY pos) AS centroid FROM m GROUP BY label)"""


@query(f"WITH {_CENT} SELECT label, pos - 1 AS pos, round(m, 6) AS m FROM m")
def centroid_mean(spark, root):
    c = vectors.centroids(table(spark, root, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("pos", "m")).select("label", F.col("pos").cast("long").alias("pos"), F.round("m", 6).alias("m"))


@query(f"""WITH {_CENT}, s AS (SELECT u.vec_id, u.label AS truth, c.label, round(list_cosine_similarity(u.v, c.centroid), 9) AS s FROM u, c),
b AS (SELECT truth, arg_max(label, (s, -label)) AS guess FROM s GROUP BY vec_id, truth) SELECT truth, guess, count(*) AS n FROM b GROUP BY ALL""")
def centroid_confusion(spark, root):
    e = table(spark, root, "embeddings")
    near = similarity.nearest_centroid(e, "vec_id", "embedding", vectors.centroids(e, "label", "embedding"))
    return scoring.confusion(near.withColumnRenamed("label", "guess").join(e.select("vec_id", F.col("label").alias("truth")), "vec_id"), "truth", "guess")


@query(f"""WITH {_CENT}, s AS (SELECT u.vec_id, u.label AS truth, c.label, round(list_cosine_similarity(u.v, c.centroid), 9) AS s FROM u, c), b AS (SELECT truth, arg_max(label, (s, -label)) AS guess FROM s GROUP BY vec_id, truth),
k AS (SELECT label, (SELECT count(*) FROM b WHERE truth = label) AS support, (SELECT count(*) FROM b WHERE guess = label) AS guessed, (SELECT count(*) FROM b WHERE truth = label AND guess = label) AS tp FROM c),
r AS (SELECT label, support, coalesce(tp / nullif(guessed, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM k) SELECT label, support, round(p, 6) AS precision_, round(r, 6) AS recall_, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM r""")
def centroid_f1(spark, root):
    return scoring.class_report(centroid_confusion(spark, root))


@query("""WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT list_cosine_similarity(a.v, b.v) AS s, a.label = b.label AS y FROM u a JOIN u b ON a.vec_id < b.vec_id), t AS (SELECT unnest([0.0, 0.1, 0.2, 0.3]) AS threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (WHERE s > threshold AND y) AS tp, count(*) FILTER (WHERE s > threshold AND NOT y) AS fp, count(*) FILTER (WHERE s <= threshold AND y) AS fn, count(*) FILTER (WHERE s <= threshold AND NOT y) AS tn,
round(count(*) FILTER (WHERE s > threshold AND y) / nullif(count(*) FILTER (WHERE s > threshold), 0), 6) AS precision_, round(count(*) FILTER (WHERE s > threshold AND y) / nullif(count(*) FILTER (WHERE y), 0), 6) AS recall_ FROM p, t GROUP BY threshold""")
def threshold_sweep(spark, root):
    return similarity.sweep_pairs(table(spark, root, "embeddings"), "vec_id", "embedding", "label", [0.0, 0.1, 0.2, 0.3])


# ---- scores ------------------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT overall_confidence AS c, CASE WHEN extraction_failed THEN 0.0 ELSE 1.0 END AS y FROM extracted_intelligence WHERE overall_confidence IS NOT NULL AND NOT isnan(overall_confidence) AND extraction_failed IS NOT NULL)
SELECT CAST(least(floor(c * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(c), 6) AS mean_confidence, round(avg(y), 6) AS accuracy FROM c GROUP BY 1""")
def calibration_bins(spark, root):
    e = table(spark, root, "extracted_intelligence").filter("extraction_failed IS NOT NULL")
    b = scoring.calibration(e, "overall_confidence", ~F.col("extraction_failed"))
    return b.select(F.col("bin").cast("long").alias("bin"), "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("accuracy", 6).alias("accuracy"))


@query("""WITH c AS (SELECT l_returnflag AS a, CASE l_linestatus WHEN 'O' THEN 'N' ELSE 'R' END AS b FROM lineitem), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS s FROM c),
x AS (SELECT sum(na * nb) AS x FROM (SELECT a, count(*) AS na FROM c GROUP BY 1) l JOIN (SELECT b, count(*) AS nb FROM c GROUP BY 1) r ON a = b) SELECT n, round(s / n, 6) AS agreement, round((s / n - x / (n * n)) / (1 - x / (n * n)), 6) AS kappa FROM n, x""")
def rater_kappa(spark, root):
    li = table(spark, root, "lineitem").select(F.col("l_returnflag").alias("a"), F.when(F.col("l_linestatus") == "O", "N").otherwise("R").alias("b"))
    return scoring.kappa(li, "a", "b")


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY ALL")
def rater_correlation(spark, root):
    return table(spark, root, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("SELECT CAST(floor(round(abs(l_discount - l_tax) * 10, 6)) AS BIGINT) AS step, count(*) AS n FROM lineitem GROUP BY 1")
def score_gaps(spark, root):
    return scoring.gaps(table(spark, root, "lineitem"), "l_discount", "l_tax")


@query("""SELECT l_returnflag, metric, round(avg(v), 6) AS mean_value FROM (SELECT l_returnflag, unnest(['discount', 'tax', 'quantity']) AS metric, unnest([l_discount, l_tax, l_quantity]) AS v FROM lineitem) GROUP BY ALL""")
def metric_means(spark, root):
    li = table(spark, root, "lineitem").select("l_returnflag", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_quantity").alias("quantity"))
    return li.unpivot("l_returnflag", ["discount", "tax", "quantity"], "metric", "v").groupBy("l_returnflag", "metric").agg(F.round(F.avg("v"), 6).alias("mean_value"))


@query("""WITH e AS (SELECT DISTINCT ON (id) * FROM extracted_intelligence ORDER BY id), k AS (SELECT normalized_job_id, id, extracted_at, list_distinct([lower(trim(coalesce(s.skill_name, s.label))) FOR s IN coalesce(skills, []) IF trim(coalesce(s.skill_name, s.label, '')) <> '']) AS l FROM e WHERE normalized_job_id IS NOT NULL AND NOT coalesce(extraction_failed, false)),
r AS (SELECT normalized_job_id, l AS now, row_number() OVER w AS rn, lead(l) OVER w AS before FROM k WINDOW w AS (PARTITION BY normalized_job_id ORDER BY extracted_at DESC NULLS LAST, id DESC)), c AS (SELECT *, len(list_intersect(now, before)) AS tp, len(now) AS a, len(before) AS b FROM r WHERE rn = 1 AND before IS NOT NULL),
p AS (SELECT normalized_job_id, CASE WHEN a + b = 0 THEN 1.0 ELSE coalesce(tp / nullif(a, 0), 0) END AS p, CASE WHEN a + b = 0 THEN 1.0 ELSE coalesce(tp / nullif(b, 0), 0) END AS r FROM c)
SELECT normalized_job_id, round(CAST(p AS DOUBLE), 6) AS precision_, round(CAST(r AS DOUBLE), 6) AS recall_, round(CAST(coalesce(2 * p * r / nullif(p + r, 0), 0) AS DOUBLE), 6) AS f1 FROM p""")
def extraction_set_scores(spark, root):
    """Skills of a posting's latest run against those of the run before."""
    e = table(spark, root, "extracted_intelligence").dropDuplicates(["id"]).filter("normalized_job_id IS NOT NULL AND NOT coalesce(extraction_failed, false)")
    names = F.array_distinct(F.filter(F.transform("skills", lambda s: F.lower(F.trim(F.coalesce(s["skill_name"], s["label"])))), lambda x: x.isNotNull() & (x != "")))
    from pyspark.sql import Window

    w = Window.partitionBy("normalized_job_id").orderBy(F.desc_nulls_last("extracted_at"), F.desc("id"))
    r = e.select("normalized_job_id", F.coalesce(names, F.array().cast("array<string>")).alias("now"), F.row_number().over(w).alias("rn"), F.lead(F.coalesce(names, F.array().cast("array<string>"))).over(w).alias("before"))
    return r.filter("rn = 1 AND before IS NOT NULL").select("normalized_job_id", scoring.set_scores(F.col("now"), F.col("before")).alias("s")).select("normalized_job_id", "s.*")


@query("""WITH t AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 = 0), u AS (SELECT c_custkey AS k, upper(c_mktsegment) AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT k, coalesce(t.v, u.v) AS v FROM t FULL JOIN u USING (k)""")
def coalesce_upsert(spark, root):
    c = table(spark, root, "customer")
    t = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    u = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.upper("c_mktsegment").alias("v"))
    return upserts.fill_missing(t, u, ["k"])


@query("""WITH t AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 = 0), u AS (SELECT c_custkey AS k, upper(c_mktsegment) AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT k, v FROM u UNION ALL SELECT k, v FROM t WHERE k NOT IN (SELECT k FROM u)""")
def latest_wins_upsert(spark, root):
    c = table(spark, root, "customer")
    t = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    u = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.upper("c_mktsegment").alias("v"))
    return upserts.latest_wins(t, u, ["k"])


@query("""WITH t AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 = 0), u AS (SELECT c_custkey AS k, upper(c_mktsegment) AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT k, v FROM t UNION ALL SELECT k, v FROM u WHERE k NOT IN (SELECT k FROM t)""")
def insert_missing(spark, root):
    c = table(spark, root, "customer")
    t = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    u = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.upper("c_mktsegment").alias("v"))
    return upserts.insert_missing(t, u, ["k"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascade_reset(spark, root):
    drop = table(spark, root, "orders").filter("o_orderstatus = 'P'")
    return upserts.cascade(drop, "o_orderkey", {"lineitem": (table(spark, root, "lineitem"), "l_orderkey")})["lineitem"].select("l_orderkey", "l_linenumber")


@query("""WITH e AS (SELECT DISTINCT l_orderkey, p_brand || '/' || p_type AS s FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT a.s AS skill_a, b.s AS skill_b, count(*) AS pair_count
FROM e a JOIN e b ON a.l_orderkey = b.l_orderkey AND a.s < b.s GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 50""")
def brand_type_pairs_top50(spark, root):
    e = elements(spark, root).withColumn("s", F.concat_ws("/", "skill", "tool"))
    return pair_table(e, "posting_id", "s", None, 50)


@query("""WITH a AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-01-01') AS cur, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '2000-01-01' AND o_orderdate >= TIMESTAMP '1999-01-01') AS prior FROM orders GROUP BY 1)
SELECT CASE WHEN cur - prior > 0 THEN 'rising' WHEN cur - prior < 0 THEN 'declining' ELSE 'stable' END AS trajectory, count(*) AS n FROM a GROUP BY 1""")
def trajectories(spark, root):
    o = table(spark, root, "orders")
    cut, before = F.lit("2000-01-01").cast("timestamp"), F.lit("1999-01-01").cast("timestamp")
    g = o.groupBy("o_custkey").agg(F.count_if(F.col("o_orderdate") >= cut).alias("cur"), F.count_if((F.col("o_orderdate") < cut) & (F.col("o_orderdate") >= before)).alias("prior"))
    return g.groupBy(dates.trajectory(F.col("cur") - F.col("prior")).alias("trajectory")).agg(F.count(F.lit(1)).alias("n"))


# ---- taxonomy and roles ------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT unnest(skills) AS s FROM extracted_intelligence), c AS (SELECT s.skill_id AS uri, s.skill_name AS name FROM s WHERE s.skill_id IS NOT NULL AND s.skill_name IS NOT NULL),
e AS (SELECT lower(trim(name)) AS k, min(uri) AS u FROM c GROUP BY 1), m AS (SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS k, min(uri) AS u FROM c GROUP BY 1),
l AS (SELECT DISTINCT coalesce(s.skill_name, s.label) AS label FROM s WHERE trim(coalesce(s.skill_name, s.label)) <> ''),
r AS (SELECT CASE WHEN e.u IS NOT NULL THEN 2 WHEN m.u IS NOT NULL THEN 3 ELSE 6 END AS step, CASE WHEN e.u IS NOT NULL OR m.u IS NOT NULL THEN 1.0 ELSE 0.0 END AS c FROM l LEFT JOIN e ON e.k = lower(trim(label)) LEFT JOIN m ON m.k = trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')))
SELECT step, count(*) AS n, round(CAST(avg(c) AS DOUBLE), 6) AS mean_confidence FROM r GROUP BY 1""")
def taxonomy_resolution(spark, root):
    from ..operators.taxonomy import coverage, resolve

    s = table(spark, root, "extracted_intelligence").select(F.explode("skills").alias("s"))
    catalog = s.select(F.col("s.skill_id").alias("uri"), F.col("s.skill_name").alias("name")).dropna().distinct()
    return coverage(resolve(s.select(F.coalesce("s.skill_name", "s.label").alias("l")), "l", catalog))


@query("""WITH e AS (SELECT o_orderpriority AS role, p_brand AS skill, count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL), t AS (SELECT o_orderpriority AS role, count(DISTINCT o_orderkey) AS total FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1),
r AS (SELECT role, skill, n, round(n / total, 6) AS demand_pct, CAST(row_number() OVER (PARTITION BY role ORDER BY n DESC, skill) AS INTEGER) AS rank FROM e JOIN t USING (role)) SELECT * FROM r WHERE rank <= 15""")
def role_top_skills(spark, root):
    from ..operators.pipelines import top_of_role

    rows = elements(spark, root).join(table(spark, root, "orders").select(F.col("o_orderkey").alias("posting_id"), F.col("o_orderpriority").alias("role")), "posting_id")
    return top_of_role(rows, "role", "skill", "posting_id")


@query("""WITH g AS (SELECT c_mktsegment AS sector, c_name AS company, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT sector, company, n FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY n DESC, company) AS rn FROM g) WHERE rn <= 5""")
def top_employers(spark, root):
    g = postings(spark, root).groupBy("sector", "company").agg(F.count(F.lit(1)).alias("n"))
    return windows.top_n(g, "sector", 5, F.desc("n"), F.asc("company")).drop("rank")


@query()
def pipeline_stages(spark, root):
    """Rows of all batches that pass ingestion, each batch against those before it, and normalisation, the rows that
    don't, and the postings and roles that come of them. Roles are the postings' titles; staged rows have no vectors."""
    from ..operators.clusters import most_common
    from ..operators.pipelines import ingest_all, normalise, promote_all, role_ids
    from ..runtime import materialize

    s = table(spark, root, "job_sources").groupBy(F.col("source").alias("__s")).agg(F.min("trust_rank").alias("__rank"))
    r = table(spark, root, "raw_ingested_jobs").join(s, _SRC("source") == F.col("__s"), "left").withColumn("arrival", F.col("id"))
    one = ingest_all(r, "ingestion_run_id", F.coalesce("__rank", F.lit(99)))
    two = normalise(one.passed)  # not written in between: the counts read few of its columns
    postings = materialize(promote_all(two.passed, ["fingerprint"], "ingestion_run_id").select("fingerprint", "title"), "postings")
    titles = postings.withColumn("label", F.lower("title"))
    roles = role_ids(most_common(titles, "label", "title", 5).select(F.col("label").alias("cluster_id"), "label", F.col("values").alias("top_title"), F.array().cast("array<string>").alias("top_skill")))
    count = lambda df, s: df.agg(F.lit(s).alias("outcome"), F.count(F.lit(1)).alias("n"))
    stages = [(one.rejected, "repeated"), (two.passed, "normalised"), (two.rejected, "rejected"), (postings, "promoted"), (roles.select("role_id").distinct(), "roles")]
    return reduce(DataFrame.unionByName, [count(df, s) for df, s in stages])

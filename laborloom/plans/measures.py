"""Queries: gates, joins, lookups, measures, upserts and text forms over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..adapters import elements, postings, skill_rows
from ..functions import dates, labels, text, vectors
from ..operators import checks, eras, gates, matching, mentions, roles, scoring, similarity, upserts, windows
from ..operators.clusters import dominant_label, most_common
from ..operators.weekly import demand, in_week, pair_table, sector_summary
from ..runtime import table
from . import sql
from .registry import registry

QUERIES, SQL, query = registry()
_SRC = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
_SRC_SQL = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"


def _n():
    return F.count(F.lit(1))


_LAST = "2001-08-01 00:00:00"


# ---- gates and filters -----------------------------------------------------------------------------------------------

_SCORED = """j AS (SELECT *, trim(coalesce(title, '') || ' ' || coalesce(description, '')) AS c FROM job_records), s AS (SELECT *, CASE WHEN length(c) < 35 THEN 0.88 WHEN regexp_matches(lower(c), '\\b(click here|earn \\$\\d|bitcoin|crypto airdrop)\\b') THEN 0.92
WHEN contains(lower(c), 'work from home') AND length(c) < 120 THEN 0.78 ELSE 0.45 END AS spam_score, nullif(trim(company), '') AS company_id, CASE WHEN raw_payload_hash IS NULL THEN NULL ELSE row_number() OVER (PARTITION BY raw_payload_hash ORDER BY job_id) > 1 END AS is_duplicate FROM j),
t AS (SELECT *, CASE WHEN spam_score < 0.7 THEN false WHEN spam_score > 0.9 THEN true END AS is_spam FROM s)"""


def _scored(spark, root):
    jr = table(spark, root, "job_records").withColumn("spam_score", labels.offline_spam_score(F.col("title"), F.col("description")))
    again = F.row_number().over(Window.partitionBy("raw_payload_hash").orderBy("job_id")) > 1
    jr = jr.withColumn("is_duplicate", F.when(F.col("raw_payload_hash").isNotNull(), again)).withColumn("company_id", text.blank_to_null(F.col("company")))
    return jr.withColumn("is_spam", labels.spam_tier(F.col("spam_score"))["is_spam"])


@query(f"""WITH {_SCORED}
SELECT 'analytics' AS gate, count(*) AS n FROM t WHERE is_spam IS NOT TRUE AND (spam_score IS NULL OR spam_score <= 0.9) AND is_duplicate IS NOT TRUE UNION ALL SELECT 'clustering', count(*) FROM t WHERE (spam_score IS NULL OR spam_score < 0.9) AND company_id IS NOT NULL AND is_duplicate IS NOT TRUE
UNION ALL SELECT 'strict', count(*) FROM t WHERE is_spam = false UNION ALL SELECT 'tolerant', count(*) FROM t WHERE is_spam = false OR is_spam IS NULL""")
def gate_counts(spark, root):
    rows = _scored(spark, root).select("spam_score", "is_duplicate", "company_id", "is_spam")
    named = {"analytics": gates.analytics_gate, "clustering": gates.clustering_gate, "strict": gates.strict_gate, "tolerant": gates.tolerant_gate}
    out = None
    for name, gate in named.items():
        one = gate(rows).agg(F.lit(name).alias("gate"), _n().alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH e AS (SELECT *, CASE WHEN overall_confidence >= 0.9 THEN 'gold' WHEN overall_confidence >= 0.6 THEN 'silver' ELSE 'rejected' END AS tier FROM extracted_intelligence)
SELECT count(*) AS fresh, count(*) >= 50 AS enough FROM e WHERE extracted_at > TIMESTAMPTZ '2025-03-01 00:00:00+00' AND tier NOT IN ('rejected')""")
def enough_new_rows(spark, root):
    c = F.col("overall_confidence")
    e = table(spark, root, "extracted_intelligence").withColumn("tier", F.when(c >= 0.9, "gold").when(c >= 0.6, "silver").otherwise("rejected"))
    n = gates.new_since(e, "extracted_at", "2025-03-01 00:00:00", "tier", ("rejected",))
    return n.agg(_n().alias("fresh"), (_n() >= 50).alias("enough"))


@query("""SELECT normalized_job_id, count(*) AS n FROM extracted_intelligence WHERE len([s FOR s IN skills IF s.skill_name ILIKE '%planning%' OR s.label ILIKE '%planning%']) > 0 GROUP BY ALL""")
def skill_text_search(spark, root):
    hit = F.exists("skills", lambda s: F.coalesce(s["skill_name"].ilike("%planning%"), F.lit(False)) | F.coalesce(s["label"].ilike("%planning%"), F.lit(False)))
    return table(spark, root, "extracted_intelligence").filter(hit).groupBy("normalized_job_id").agg(_n().alias("n"))


@query("""SELECT event_type, count(*) FILTER (WHERE json_type(props, '$.k') = 'ARRAY') AS arrays, count(*) FILTER (WHERE json_type(props, '$.k') IS NOT NULL AND json_type(props, '$.k') NOT IN ('ARRAY', 'NULL')) AS others, count(*) AS n FROM events GROUP BY ALL""")
def json_array_guard(spark, root):
    k = F.get_json_object("props", "$.k")
    return table(spark, root, "events").groupBy("event_type").agg(F.count_if(text.json_array(k).isNotNull()).alias("arrays"), F.count_if(k.isNotNull() & text.json_array(k).isNull()).alias("others"), _n().alias("n"))


@query("""SELECT id FROM raw_ingested_jobs WHERE processing_status = 'pending' AND created_at < TIMESTAMPTZ '2025-06-01 00:00:00+00' - INTERVAL 30 MINUTE ORDER BY created_at, id LIMIT 100""")
def pending_oldest_first(spark, root):
    """The next rows to work on: pending, past the grace window, the oldest first."""
    r = table(spark, root, "raw_ingested_jobs").filter("processing_status = 'pending'")
    return gates.past_grace(r, "created_at", F.lit("2025-06-01 00:00:00").cast("timestamp"), 30).orderBy("created_at", "id").limit(100).select("id")


@query("""SELECT coalesce(employment_type, 'none') AS kind, count(*) AS n FROM job_records WHERE employment_type IS NULL OR employment_type NOT IN ('Other', 'Any') GROUP BY 1""")
def without_misfiled(spark, root):
    jr = gates.without_values(table(spark, root, "job_records"), "employment_type", ("Other", "Any"))
    return jr.groupBy(F.coalesce("employment_type", F.lit("none")).alias("kind")).agg(_n().alias("n"))


# ---- joins -----------------------------------------------------------------------------------------------------------


@query("""SELECT coalesce(c_mktsegment, 'none') AS segment, count(*) AS n FROM orders LEFT JOIN customer ON CAST(o_custkey AS VARCHAR) = CAST(c_custkey AS VARCHAR) AND c_acctbal > 0 GROUP BY 1""")
def text_key_lookup(spark, root):
    c = table(spark, root, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("k"), "c_mktsegment")
    o = table(spark, root, "orders").select(F.col("o_custkey").cast("string").alias("k"))
    return o.join(c, "k", "left").groupBy(F.coalesce("c_mktsegment", F.lit("none")).alias("segment")).agg(_n().alias("n"))


@query("""SELECT c_nationkey, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)) AS with_large FROM customer GROUP BY ALL""")
def exists_in_aggregate(spark, root):
    large = table(spark, root, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("large")).distinct()
    return table(spark, root, "customer").join(large, "c_custkey", "left").groupBy("c_nationkey").agg(_n().alias("n"), F.count_if("large").alias("with_large"))


@query("""SELECT b.o_orderkey AS key, count(*) AS earlier, max(a.o_orderdate) AS latest FROM orders b JOIN orders a ON a.o_custkey = b.o_custkey AND a.o_orderdate >= b.o_orderdate - INTERVAL 30 DAY AND a.o_orderdate < b.o_orderdate AND a.o_orderkey <> b.o_orderkey GROUP BY 1""")
def repeats_within_30_days(spark, root):
    o = table(spark, root, "orders").select(F.col("o_custkey"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    near = similarity.earlier_in_window(o, "o_custkey", "key", "ts")
    return near.groupBy("key").agg(_n().alias("earlier"), F.max("other_ts").alias("latest"))


_VECTORS_SQL = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, o_orderdate AS ts FROM embeddings JOIN orders ON o_orderkey = vec_id)"


def _dated_vectors(spark, root):
    e, o = table(spark, root, "embeddings"), table(spark, root, "orders")
    return e.join(o, e.vec_id == o.o_orderkey).select("label", "vec_id", F.col("o_orderdate").cast("timestamp").alias("ts"), "embedding", F.length("o_orderpriority").alias("filled"))


@query(f"""WITH {_VECTORS_SQL}, p AS (SELECT b.vec_id AS key, a.vec_id AS other, round(list_cosine_similarity(a.e, b.e), 9) AS s FROM v b JOIN v a ON a.label = b.label AND a.vec_id <> b.vec_id AND a.ts >= b.ts - INTERVAL 400 DAY AND a.ts < b.ts),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, other) AS rn FROM p) SELECT key, other, round(s, 6) AS similarity FROM r WHERE rn = 1 AND s > 0.1""")
def nearest_earlier_posting(spark, root):
    """Each row's most similar earlier one of its block, above a threshold; the days and threshold suit these random vectors."""
    pairs = similarity.earlier_neighbours(_dated_vectors(spark, root), "label", "vec_id", "ts", "embedding", 400).withColumn("similarity", F.round("similarity", 9))
    return similarity.nearest_earlier(pairs, 0.1).select("key", "other", F.round("similarity", 6).alias("similarity"))


@query()
def fuzzy_survivors(spark, root):
    """Near repeats replayed in order of date, each with the row that survives in the end; no SQL, as each decision depends on those
    before it."""
    from ..operators.dedup import follow, sequential_survivors

    rows = _dated_vectors(spark, root).withColumnRenamed("vec_id", "key").withColumnRenamed("embedding", "vector")
    return follow(sequential_survivors(rows, "label", 0.1, 400))


@query("""WITH z AS (SELECT upper(trim(state)) AS s, lower(trim(city)) AS c, min(region_id) AS zone FROM raw_ingested_jobs WHERE state IS NOT NULL AND city IS NOT NULL AND region_id IS NOT NULL GROUP BY ALL)
SELECT coalesce(zone, 'none') AS zone, count(*) AS n FROM job_records LEFT JOIN z ON upper(trim(state)) = z.s AND lower(trim(city)) = z.c GROUP BY 1""")
def code_of_place(spark, root):
    known = table(spark, root, "raw_ingested_jobs").select(F.upper(F.trim("state")).alias("s"), F.lower(F.trim("city")).alias("c"), F.col("region_id").alias("zone"))
    jr = matching.first_code(table(spark, root, "job_records"), [F.upper(F.trim("state")), F.lower(F.trim("city"))], known, ["s", "c"], "zone")
    return jr.groupBy(F.coalesce("zone", F.lit("none")).alias("zone")).agg(_n().alias("n"))


@query("""WITH w AS (SELECT job_id, unnest(list_distinct([x FOR x IN regexp_split_to_array(lower(title), '[^a-z]+') IF length(x) >= 4])) AS w FROM job_records), h AS (SELECT job_id, value_id AS code, count(*) AS score, any_value(length(canonical)) AS size FROM w JOIN canonical_values ON field_name = 'title' AND contains(lower(canonical), w) GROUP BY ALL)
SELECT job_id, code, score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, size, code) AS rn FROM h) WHERE rn <= 15""")
def substring_candidates(spark, root):
    catalog = table(spark, root, "canonical_values").filter("field_name = 'title'")
    return matching.substring_candidates(table(spark, root, "job_records"), "job_id", "title", catalog, "value_id", "canonical").withColumnRenamed("value_id", "code")


_SECTORS = {"1-URGENT": "Health", "2-HIGH": "Technology", "3-MEDIUM": "Education"}


@query(f"""SELECT CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _SECTORS.items())} ELSE 'Other' END AS sector, count(*) AS n FROM orders GROUP BY 1""")
def sector_of_role(spark, root):
    return table(spark, root, "orders").groupBy(labels.mapped(F.col("o_orderpriority"), _SECTORS, "Other").alias("sector")).agg(_n().alias("n"))


@query("""SELECT count(*) FILTER (WHERE d.doc_id IS NOT NULL AND e.vec_id IS NOT NULL) AS aligned, count(*) FILTER (WHERE e.vec_id IS NULL) AS missing, count(*) FILTER (WHERE d.doc_id IS NULL) AS orphans FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT vec_id FROM embeddings) e ON doc_id = vec_id""")
def aligned_rows(spark, root):
    return checks.alignment(table(spark, root, "documents"), table(spark, root, "embeddings"), "doc_id", "vec_id")


@query(f"""SELECT id FROM raw_ingested_jobs r WHERE processing_status = 'normalized' AND NOT EXISTS (SELECT 1 FROM job_records j WHERE {_SRC_SQL.format('j.source')} = {_SRC_SQL.format('r.source')} AND j.external_id = r.external_id) ORDER BY created_at, id LIMIT 100""")
def unpromoted_oldest_first(spark, root):
    """Normalised rows that no posting was made of, by source and external id, the oldest first."""
    r = table(spark, root, "raw_ingested_jobs").filter("processing_status = 'normalized'").withColumn("source", _SRC("source"))
    j = table(spark, root, "job_records").select(_SRC("source").alias("source"), "external_id")
    return r.join(j, ["source", "external_id"], "left_anti").orderBy("created_at", "id").limit(100).select("id")


@query(f"""SELECT e.id, j.job_id, (s.trust_rank <= 3) AS trusted FROM extracted_intelligence e JOIN job_records j ON e.normalized_job_id = j.job_id JOIN job_sources s ON s.source = {_SRC_SQL.format('j.source')} GROUP BY ALL ORDER BY trusted DESC, e.id DESC, j.job_id LIMIT 50""")
def trusted_first(spark, root):
    e, s = table(spark, root, "extracted_intelligence").select("id", "normalized_job_id"), table(spark, root, "job_sources")
    j = table(spark, root, "job_records").select("job_id", _SRC("source").alias("source"))
    rows = e.join(j, e.normalized_job_id == j.job_id).join(s, "source").select("id", "job_id", (F.col("trust_rank") <= 3).alias("trusted")).distinct()
    return rows.orderBy(F.desc("trusted"), F.desc("id"), "job_id").limit(50)


@query("""WITH h AS (SELECT o_orderkey AS trace, o_custkey AS item FROM orders), d AS (SELECT trace, item, round(l.l_discount, 6) AS automated, round(c.c_acctbal / 10000, 6) AS human FROM lineitem l JOIN h ON l.l_orderkey = trace JOIN customer c ON c_custkey = item WHERE l_linenumber = 1)
SELECT trace, item, automated, human, round(abs(automated - human), 6) AS delta FROM d ORDER BY delta DESC, trace LIMIT 100""")
def score_divergence(spark, root):
    """Scores of two raters matched through a map of ids, the largest differences first."""
    ids = table(spark, root, "orders").select(F.col("o_orderkey").alias("trace"), F.col("o_custkey").alias("item"))
    a = table(spark, root, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("trace"), F.round("l_discount", 6).alias("automated"))
    b = table(spark, root, "customer").select(F.col("c_custkey").alias("item"), F.round(F.col("c_acctbal") / 10000, 6).alias("human"))
    return scoring.divergence(a, b, ids, "trace", "item", "automated", "human").orderBy(F.desc("delta"), "trace").limit(100)


@query(f"""WITH e AS (SELECT DISTINCT id, normalized_job_id FROM extracted_intelligence), j AS (SELECT DISTINCT job_id, {_SRC_SQL.format('source')} AS source FROM job_records), c AS (SELECT e.id, j.job_id, s.source FROM e LEFT JOIN j ON normalized_job_id = job_id LEFT JOIN job_sources s ON s.source = j.source)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE job_id IS NULL) AS no_posting, count(*) FILTER (WHERE job_id IS NOT NULL AND source IS NULL) AS no_source, round(count(*) FILTER (WHERE source IS NOT NULL) / count(*), 6) AS success, (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM c WHERE job_id IS NOT NULL GROUP BY job_id)) AS fan_out FROM c""")
def chain_integrity(spark, root):
    """How many rows of a chain of joins reach its end, where the others are lost, and rows of each posting."""
    e = table(spark, root, "extracted_intelligence").select("id", "normalized_job_id").distinct()
    j = table(spark, root, "job_records").select("job_id", _SRC("source").alias("js")).distinct()
    c = e.join(j, e.normalized_job_id == j.job_id, "left").join(table(spark, root, "job_sources").select("source"), F.col("js") == F.col("source"), "left")
    per = c.groupBy("job_id").agg(_n().alias("n"), F.count("source").alias("with_source"))
    lost = F.sum(F.when(F.col("job_id").isNull(), F.col("n")).otherwise(0))
    return per.agg(
        F.sum("n").alias("n_rows"), lost.alias("no_posting"), (F.sum(F.when(F.col("job_id").isNotNull(), F.col("n") - F.col("with_source")).otherwise(0))).alias("no_source"),
        F.round(F.sum("with_source") / F.sum("n"), 6).alias("success"), F.round(F.avg(F.when(F.col("job_id").isNotNull(), F.col("n"))), 6).alias("fan_out"),
    )


# ---- counts and reports ----------------------------------------------------------------------------------------------


@query("""SELECT CAST(CAST(date_trunc('week', max(o_orderdate)) AS DATE) AS VARCHAR) AS latest_week, count(*) FILTER (WHERE date_trunc('week', o_orderdate) = (SELECT date_trunc('week', max(o_orderdate)) FROM orders)) AS n FROM orders""")
def latest_week(spark, root):
    per = table(spark, root, "orders").groupBy(dates.week_of(F.col("o_orderdate")).alias("w")).agg(_n().alias("n"))
    return per.agg(F.max("w").cast("string").alias("latest_week"), F.max_by("n", "w").alias("n"))


@query("""SELECT CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS week, count(*) AS expanded_rows, count(DISTINCT o_orderkey) AS n_postings FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY 1 DESC LIMIT 200""")
def weeks_with_rows(spark, root):
    """The weeks that there are, the newest first, with their expanded rows and postings."""
    li = table(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(_n().alias("n"))
    o = table(spark, root, "orders").join(li, "o_orderkey")
    return o.groupBy(dates.week_of(F.col("o_orderdate")).cast("string").alias("week")).agg(F.sum("n").alias("expanded_rows"), _n().alias("n_postings")).orderBy(F.desc("week")).limit(200)


@query("""WITH c AS (SELECT raw_payload_hash, count(*) AS n FROM job_records WHERE raw_payload_hash IS NOT NULL GROUP BY 1) SELECT CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 5 THEN '3-5' ELSE '6+' END AS bucket, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS n_rows FROM c GROUP BY 1""")
def duplicate_buckets(spark, root):
    return checks.cluster_sizes(table(spark, root, "job_records"), "raw_payload_hash")


@query("""SELECT lower(trim(company)) AS cluster, count(*) AS n, max(substr(title, 1, 40)) AS sample FROM job_records WHERE company IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def largest_clusters(spark, root):
    jr = table(spark, root, "job_records").filter("company IS NOT NULL")
    return jr.groupBy(F.lower(F.trim("company")).alias("cluster")).agg(_n().alias("n"), F.max(F.substring("title", 1, 40)).alias("sample")).orderBy(F.desc("n"), "cluster").limit(20)


@query("""SELECT ingestion_run_id, count(*) AS n, count(*) FILTER (WHERE processing_status = 'pending') AS pending, count(*) FILTER (WHERE processing_status = 'error') AS failed, count(*) FILTER (WHERE raw_payload_hash IS NULL) AS without_hash, count(DISTINCT lower(trim(company))) AS employers,
count(*) - count(DISTINCT coalesce(lower(trim(external_id)), '')) AS repeats FROM raw_ingested_jobs GROUP BY ALL""")
def batch_counters(spark, root):
    r = table(spark, root, "raw_ingested_jobs")
    # one grouping on the keys that are counted apart, so that each distinct count is a plain one after
    employers = r.groupBy("ingestion_run_id", F.lower(F.trim("company")).alias("c")).agg(F.lit(1).alias("one")).groupBy("ingestion_run_id").agg(F.count("c").alias("employers"))
    per = r.groupBy("ingestion_run_id", F.coalesce(F.lower(F.trim("external_id")), F.lit("")).alias("x")).agg(
        _n().alias("n"), F.count_if(F.col("processing_status") == "pending").alias("pending"), F.count_if(F.col("processing_status") == "error").alias("failed"), F.count_if(F.col("raw_payload_hash").isNull()).alias("without_hash"),
    )
    sums = per.groupBy("ingestion_run_id").agg(*[F.sum(c).alias(c) for c in ("n", "pending", "failed", "without_hash")], (F.sum("n") - _n()).alias("repeats"))
    return sums.join(employers, "ingestion_run_id").select("ingestion_run_id", "n", "pending", "failed", "without_hash", "employers", "repeats")


@query(f"""SELECT {_SRC_SQL.format('source')} AS source, count(*) AS n, round(count(*) FILTER (WHERE experience_level IS NULL) / count(*), 6) AS share, count(*) FILTER (WHERE experience_level IS NULL) / count(*) > 0.3 AS alert FROM job_records GROUP BY 1""")
def unclassified_alerts(spark, root):
    return checks.missing_rate(table(spark, root, "job_records").withColumn("source", _SRC("source")), "source", "experience_level", 0.3)


@query("""WITH i AS (SELECT id, extraction_model, len([s FOR s IN skills IF s.skill_id IS NULL]) AS bad FROM (SELECT DISTINCT ON (id) * FROM extracted_intelligence ORDER BY id) WHERE skills IS NOT NULL) SELECT extraction_model, count(*) AS n, round(avg(CASE WHEN bad = 0 THEN 1.0 ELSE 0.0 END), 6) AS grounded FROM i GROUP BY ALL""")
def grounded_rate(spark, root):
    """The share of answers without an item that nothing backs."""
    e = table(spark, root, "extracted_intelligence").filter("skills IS NOT NULL").dropDuplicates(["id"])
    clean = ~F.exists("skills", lambda s: s["skill_id"].isNull())
    return e.groupBy("extraction_model").agg(_n().alias("n"), F.round(F.avg(F.when(clean, 1.0).otherwise(0.0)), 6).alias("grounded"))


@query("""SELECT job_id, salary_max FROM job_records ORDER BY (CASE WHEN isnan(salary_max) THEN NULL ELSE salary_max END) ASC NULLS FIRST, job_id DESC LIMIT 60""".replace("SELECT job_id, salary_max", "SELECT job_id, CASE WHEN isnan(salary_max) THEN NULL ELSE salary_max END AS salary_max"))
def unpaid_first(spark, root):
    pay = F.when(~F.isnan("salary_max"), F.col("salary_max")).alias("salary_max")
    return table(spark, root, "job_records").select("job_id", pay).orderBy(F.asc_nulls_first("salary_max"), F.desc("job_id")).limit(60)


@query("""WITH d AS (SELECT p_brand, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS BIGINT) AS gap FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'A' OR l_linestatus = 'O' GROUP BY 1)
SELECT p_brand, gap, CASE WHEN gap > 0 THEN 'surplus' ELSE 'deficit' END AS side, CAST(row_number() OVER (PARTITION BY gap > 0 ORDER BY abs(gap) DESC, p_brand) AS INTEGER) AS rank FROM d WHERE gap <> 0""")
def surplus_and_deficit(spark, root):
    li = table(spark, root, "lineitem").filter("l_returnflag <> 'A' OR l_linestatus = 'O'").join(table(spark, root, "part"), F.col("l_partkey") == F.col("p_partkey"))
    d = li.groupBy("p_brand").agg(F.sum(F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).alias("gap")).filter("gap <> 0")
    side = F.when(F.col("gap") > 0, "surplus").otherwise("deficit")
    return windows.ranked(d.withColumn("side", side), ["side"], F.desc(F.abs("gap")), F.asc("p_brand"))


@query("""SELECT l_returnflag, round((sum(l_quantity * 0.5) + sum(coalesce(CASE WHEN l_linenumber < 4 THEN l_discount END, 0) * 0.5)) / 1, 2) AS total FROM lineitem GROUP BY 1""".replace("round((sum(l_quantity * 0.5) + sum(coalesce(CASE WHEN l_linenumber < 4 THEN l_discount END, 0) * 0.5)) / 1, 2) AS total", "round(avg(CASE WHEN l_linenumber < 4 THEN (l_discount * 0.6 + l_tax * 0.4) / 1.0 ELSE l_tax END), 6) AS composite, round(avg(CASE WHEN l_discount <= 0 OR l_tax <= 0 THEN 0 ELSE sqrt(l_discount * l_tax) END), 6) AS geometric"))
def composite_scores(spark, root):
    """Weighted means, whose weights are spread anew where a part is missing, and geometric means."""
    d = F.when(F.col("l_linenumber") < 4, F.col("l_discount"))
    w, g = scoring.weighted([(d, 0.6), (F.col("l_tax"), 0.4)]), scoring.geometric([F.col("l_discount"), F.col("l_tax")])
    return table(spark, root, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(w), 6).alias("composite"), F.round(F.avg(g), 6).alias("geometric"))


@query("""WITH c AS (SELECT o_orderpriority AS role, p_type AS tool, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT role, string_agg(tool, '|' ORDER BY rn) AS tools FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, tool) AS rn FROM c) WHERE rn <= 5 GROUP BY 1""")
def most_common_tools(spark, root):
    o = table(spark, root, "orders").select(F.col("o_orderkey").alias("posting_id"), F.col("o_orderpriority").alias("role"))
    return most_common(elements(spark, root).join(o, "posting_id"), "role", "tool", 5).select("role", F.array_join("values", "|").alias("tools"))


@query("""WITH c AS (SELECT o_custkey, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT o_custkey, sum(n) AS total, max(n) AS most FROM c GROUP BY 1), f AS (SELECT o_custkey, min(label) AS l, any_value(most) AS most, any_value(total) AS total FROM c JOIN t USING (o_custkey) WHERE n = most GROUP BY 1)
SELECT CASE WHEN round(most / total, 6) >= 0.3 THEN l END AS label, count(*) AS n FROM f GROUP BY 1""")
def dominant_labels(spark, root):
    d = dominant_label(table(spark, root, "orders"), "o_custkey", "o_orderpriority", 0.3)
    return d.groupBy("label").agg(_n().alias("n"))


# ---- keyed writes ------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT c_custkey AS k, c_name AS v, c_mktsegment AS w FROM customer WHERE c_custkey % 3 = 0), u AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE upper(c_mktsegment) END AS v, CAST(NULL AS VARCHAR) AS w FROM customer WHERE c_custkey % 2 = 0)
SELECT k, coalesce(u.v, t.v) AS v, coalesce(u.w, t.w) AS w FROM t FULL JOIN u USING (k)""")
def new_values_unless_null(spark, root):
    c = table(spark, root, "customer")
    t = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.col("c_mktsegment").alias("w"))
    u = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 != 0, F.upper("c_mktsegment")).alias("v"), F.lit(None).cast("string").alias("w"))
    return upserts.fill_missing(t, u, ["k"], new_first=True)


@query("""WITH l AS (SELECT * FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)
SELECT c_custkey, coalesce(o_orderpriority, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN l ON o_custkey = c_custkey""")
def update_from_latest(spark, root):
    o = windows.latest_per_key(table(spark, root, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"))
    return upserts.update_from(table(spark, root, "customer").select("c_custkey", "c_mktsegment"), o, ["c_custkey"], ["c_mktsegment"])


@query("""WITH t AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS link FROM orders), f AS (SELECT o_orderkey, min(c_custkey) AS v FROM t JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 WHERE link IS NULL GROUP BY 1)
SELECT count(*) AS n, count(link) AS had, count(*) FILTER (WHERE link IS NULL AND v IS NOT NULL) AS filled FROM t LEFT JOIN f USING (o_orderkey)""")
def link_preview(spark, root):
    t = table(spark, root, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("link"))
    c = table(spark, root, "customer").filter("c_acctbal > 0").select("c_custkey")
    return upserts.fill_link(t, c, F.col("o_custkey") == F.col("c_custkey"), "link", F.col("c_custkey"), "o_orderkey")[1]


@query("""SELECT label, count(*) AS n, count(*) FILTER (WHERE len(embedding) = 64) AS valid, count(*) FILTER (WHERE embedding IS NULL OR len(embedding) <> 64) AS skipped FROM embeddings GROUP BY ALL""")
def vector_backfill(spark, root):
    ok = vectors.of_length(F.col("embedding"), 64).isNotNull()
    return table(spark, root, "embeddings").groupBy("label").agg(_n().alias("n"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("skipped"))


@query("""WITH a AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS w, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), b AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS w, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(w AS VARCHAR) AS week, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after_, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM a FULL JOIN b USING (w) WHERE a.n IS DISTINCT FROM b.n""")
def refresh_changes(spark, root):
    """Rows of each week before and after a refresh, where they differ."""
    week = dates.week_of(F.col("o_orderdate")).cast("string").alias("week")
    o = table(spark, root, "orders")
    a, b = (x.groupBy(week).agg(_n().alias("n")) for x in (o.filter("o_orderdate < TIMESTAMP '1998-01-01'"), o))
    z = lambda c: F.coalesce(c, F.lit(0))
    return checks.reconcile(a, b, ["week"], "n").filter("differs").select("week", z("a").alias("before"), z("b").alias("after_"), (z("b") - z("a")).alias("change"))


# ---- text forms --------------------------------------------------------------------------------------------------------


@query("""SELECT city, lower(strip_accents(trim(regexp_replace(city, '\\s+', ' ', 'g')))) AS folded, lower(trim(regexp_replace(city, '\\s+', ' ', 'g'))) AS label, lower(city) AS cased, count(*) AS n FROM job_records WHERE city IS NOT NULL GROUP BY ALL""")
def folded_labels(spark, root):
    """Each different city in its normal forms; the folding runs in Python, on distinct values only."""
    g = table(spark, root, "job_records").filter("city IS NOT NULL").groupBy("city").agg(_n().alias("n"))
    return g.select("city", text.fold_accents("city").alias("folded"), text.normal_label("city").alias("label"), text.casefold("city").alias("cased"), "n")


@query("""SELECT trim(regexp_replace(regexp_replace(lower(concat_ws(', ', city, state, country)), '[^a-z0-9,\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) AS place, count(*) AS n FROM job_records GROUP BY 1""")
def location_keys(spark, root):
    return table(spark, root, "job_records").groupBy(text.location_key(F.concat_ws(", ", "city", "state", "country")).alias("place")).agg(_n().alias("n"))


@query("""SELECT job_id, CASE WHEN lower(t) LIKE 'remote - remote%' THEN 'Remote' ELSE t END AS place FROM (SELECT job_id, trim(regexp_replace(coalesce((CASE WHEN is_remote THEN 'Remote - ' || CASE WHEN job_id % 2 = 0 THEN 'Remote' ELSE coalesce(city, '') END ELSE city END), ''), '\\s+', ' ', 'g')) AS t FROM job_records)""")
def clean_locations(spark, root):
    given = F.when(F.col("is_remote"), F.concat(F.lit("Remote - "), F.when(F.col("job_id") % 2 == 0, "Remote").otherwise(F.coalesce("city", F.lit(""))))).otherwise(F.col("city"))
    return table(spark, root, "job_records").select("job_id", text.clean_location(given).alias("place"))


_STATES_SQL = "CASE " + " ".join(f"WHEN s = '{n}' THEN '{c}'" for n, c in labels.STATE_CODES.items()) + " WHEN length(s) = 2 THEN upper(s) END"


@query(f"""SELECT {_STATES_SQL} AS code, count(*) AS n FROM (SELECT lower(trim(state)) AS s FROM job_records) GROUP BY 1""")
def state_codes(spark, root):
    return table(spark, root, "job_records").groupBy(labels.state_code(F.col("state")).alias("code")).agg(_n().alias("n"))


_CORPUS_SQL = "trim(array_to_string([x FOR x IN list_concat([s.skill_name FOR s IN coalesce(skills, [])], [t.tool_name FOR t IN coalesce(tools, [])]) IF x IS NOT NULL AND trim(x) <> ''], ' '))"


@query(f"SELECT id, {_CORPUS_SQL} AS corpus FROM (SELECT DISTINCT ON (id) * FROM extracted_intelligence ORDER BY id)")
def extraction_corpus(spark, root):
    e = table(spark, root, "extracted_intelligence").dropDuplicates(["id"])
    return e.select("id", text.flat_corpus(F.transform("skills", lambda s: s["skill_name"]), F.transform("tools", lambda t: t["tool_name"])).alias("corpus"))


_HINT = "CASE " + " ".join(f"WHEN contains(lower(title), '{p}') THEN '{n}'" for p, n in roles.TITLE_ROLES) + " END"


def _overlap_sql(name: str) -> str:
    ws = sorted({w for w in name.lower().split() if len(w) >= 2})
    return " + ".join(f"CASE WHEN len([c FOR c IN w IF c = '{x}' OR (length('{x}') >= 3 AND length(c) >= 3 AND (contains(c, '{x}') OR contains('{x}', c)))]) > 0 THEN 1 ELSE 0 END" for x in ws)


@query(f"""WITH t AS (SELECT job_id, title, list_distinct([x FOR x IN regexp_split_to_array(lower(concat_ws(' ', title, description)), '[^a-z0-9]+') IF length(x) >= 2]) AS w FROM job_records),
s AS (SELECT job_id, title, unnest([{', '.join(f"struct_pack(score := {_overlap_sql(n)}, size := {len(n)}, id := '{i}', name := '{n}')" for i, n in roles.AREAS)}]) AS x FROM t), b AS (SELECT job_id, any_value(title) AS title, max(x) AS x FROM s GROUP BY job_id)
SELECT job_id, coalesce({_HINT}, CASE WHEN x.score >= 1 THEN x.name END, 'unclassified') AS role FROM b""")
def role_classes(spark, root):
    return table(spark, root, "job_records").select("job_id", roles.role(F.col("title"), F.col("description")).alias("role"))


@query("""WITH k AS (SELECT id, list_sort(list_distinct([lower(trim(coalesce(s.skill_name, s.label))) FOR s IN coalesce(skills, []) IF trim(coalesce(s.skill_name, s.label, '')) <> ''])) AS l FROM (SELECT DISTINCT ON (id) * FROM extracted_intelligence ORDER BY id)) SELECT id, concat_ws(' | ', 'title: posting', CASE WHEN len(l) > 0 THEN 'skills: ' || array_to_string(l, ', ') END) AS t FROM k""")
def clustering_texts(spark, root):
    e = table(spark, root, "extracted_intelligence").dropDuplicates(["id"])
    names = F.filter(F.transform("skills", lambda s: F.lower(F.coalesce(s["skill_name"], s["label"]))), lambda x: x.isNotNull())
    return e.select("id", text.cluster_text(F.lit("posting"), {"skills": names}).alias("t"))


@query("""SELECT id, len([s FOR s IN skills IF s.confidence >= 0.75 AND trim(coalesce(s.skill_name, s.label, '')) <> '']) AS kept, len([s FOR s IN skills IF s.confidence >= 0.75 AND trim(coalesce(s.skill_name, s.label, '')) <> '']) = 0 AS failed FROM (SELECT DISTINCT ON (id) * FROM extracted_intelligence ORDER BY id) WHERE skills IS NOT NULL""")
def confident_skills(spark, root):
    e = table(spark, root, "extracted_intelligence").filter("skills IS NOT NULL").dropDuplicates(["id"])
    n = F.size(mentions.confident("skills")).cast("long")
    return e.select("id", n.alias("kept"), (n == 0).alias("failed"))


@query("""SELECT id, round(greatest(0, least(1, coalesce(overall_confidence, 0) * 0.4 + 0.5 * 0.3 + (coalesce(s, 0) + coalesce(t, 0)) / 2 * 0.2 + CASE WHEN len(skills) > 0 THEN 1.0 ELSE 0.0 END * 0.1)), 3) AS confidence FROM (SELECT DISTINCT ON (id) *, list_max([x.confidence FOR x IN skills]) AS s, list_max([x.confidence FOR x IN tools]) AS t FROM extracted_intelligence ORDER BY id) WHERE NOT coalesce(isnan(overall_confidence), false)""")
def blended_confidences(spark, root):
    e = table(spark, root, "extracted_intelligence").dropDuplicates(["id"]).filter("NOT coalesce(isnan(overall_confidence), false)")
    best = lambda c: F.array_max(F.transform(c, lambda x: x["confidence"]))
    c = labels.blended_confidence([best("skills"), best("tools")], F.col("overall_confidence"), F.lit(0.5), F.when(F.size("skills") > 0, 1.0).otherwise(0.0))
    return e.select("id", F.round(c, 3).alias("confidence"))


@query("""SELECT vec_id, len(v) AS dims, round(list_sum(v), 4) AS total FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""")
def parsed_vectors(spark, root):
    """Vectors written as text and read again."""
    e = table(spark, root, "embeddings").select("vec_id", vectors.parse_vector(F.to_json(F.col("embedding").cast("array<double>"))).alias("v"))
    return e.select("vec_id", F.size("v").cast("long").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"""WITH f AS (SELECT c_custkey AS k, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen, count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), g AS (SELECT k, CASE WHEN k % 5 = 0 THEN NULL ELSE first_seen END AS a, CASE WHEN k % 7 = 0 THEN NULL ELSE last_seen END AS b, CAST(k % 40 AS INTEGER) AS days, n FROM f),
h AS (SELECT k, n, days, a, b, coalesce(b, TIMESTAMP '{_LAST}') AS l, coalesce(a, coalesce(b, TIMESTAMP '{_LAST}') - to_days(greatest(days, 0))) AS s FROM g)
SELECT k AS posting_id, s AS first_seen, l AS last_seen, CAST(greatest(0, floor((epoch(l) - epoch(s)) / 86400)) AS INTEGER) AS duration_days, n > 20 AS is_repost, CAST(CASE WHEN n > 20 THEN 1 ELSE 0 END AS INTEGER) AS repost_count FROM h""")
def freshness_rows(spark, root):
    """First and last sight, duration and reposts of each posting; what is missing comes from the other end or the age in days."""
    o = table(spark, root, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), _n().alias("n"))
    c = table(spark, root, "customer").select(F.col("c_custkey").alias("k")).join(o, "k", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    seen = c.select("k", F.when(F.col("k") % 5 != 0, F.col("a")).cast("timestamp").alias("a"), F.when(F.col("k") % 7 != 0, F.col("b")).cast("timestamp").alias("b"), (F.col("k") % 40).cast("int").alias("days"), "n")
    return seen.select(F.col("k").alias("posting_id"), dates.seen_span(F.col("a"), F.col("b"), F.col("days"), F.lit(_LAST).cast("timestamp")).alias("x"), (F.col("n") > 20).alias("is_repost"), F.when(F.col("n") > 20, 1).otherwise(0).alias("repost_count")).select(
        "posting_id", "x.*", "is_repost", "repost_count"
    )


@query("""WITH m AS (SELECT o_orderpriority AS role, year(o_orderdate) AS y, p_type AS tool, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL), s AS (SELECT role, y, tool, n / sum(n) OVER (PARTITION BY role, y) AS share FROM m)
SELECT role, y, round(coalesce(sum(share) FILTER (WHERE contains(lower(tool), 'ai') OR contains(lower(tool), 'llm') OR contains(lower(tool), 'gpt')), 0), 6) AS density FROM s GROUP BY ALL""")
def word_density(spark, root):
    """The share of labels that have one of some words in them."""
    o = table(spark, root, "orders").select(F.col("o_orderkey").alias("posting_id"), F.col("o_orderpriority").alias("role"), F.year("o_orderdate").cast("long").alias("y"))
    m = elements(spark, root).join(o, "posting_id").groupBy("role", "y", "tool").agg(_n().alias("n"))
    hit = F.lower("tool").rlike("ai|llm|gpt")
    return m.groupBy("role", "y").agg(F.round(F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("density"))


@query("""SELECT l_orderkey, round(1.37e-5 + greatest(0, least(1, coalesce(max(l_discount), 0) * 3.5 + coalesce(max(l_tax), 0) * 2.5 + 0.25 * coalesce(min(l_discount), 0) + least(1, abs(avg(l_discount) - 0.05)) * 0.15)), 3) AS score FROM lineitem GROUP BY 1""")
def restructuring_scores(spark, root):
    g = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("a"), F.max("l_tax").alias("b"), F.min("l_discount").alias("c"), F.avg("l_discount").alias("d"))
    return g.select("l_orderkey", F.round(eras.restructuring(F.col("a") * 10, F.col("b") * 10, F.col("c"), F.col("d") - 0.05) + 1.37e-5, 3).alias("score"))


@query()
def tool_catalogue(spark, root):
    """The best mention of each tool in documents. The catalogue is what extraction has found, with its
    category; names of one word up to four letters count near a word of work with them only."""
    e = table(spark, root, "extracted_intelligence").select(F.explode("tools").alias("t")).select(F.trim(F.coalesce("t.tool_name", "t.label")).alias("name"), "t.category")
    known = e.filter("name <> ''").groupBy(F.lower("name").alias("l")).agg(F.min("name").alias("name"), F.max("category").alias("category")).limit(mentions.MOST_NAMES + 1).collect()
    near = ("use", "using", "with", "tool", "software", "experience", "skills")
    names = [mentions.Name(r["name"], r["name"], r["category"] or "", 0.6 if len(r["name"]) <= 4 else 0.95, near if len(r["name"]) <= 4 else ()) for r in known]
    return mentions.catalogue_mentions(table(spark, root, "documents"), "doc_id", ["text"], names).drop("around")


# ---- answers of the interface --------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT p_brand AS skill, c_mktsegment AS cohort, count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL), t AS (SELECT skill, sum(n) AS total FROM d GROUP BY 1)
SELECT skill, CAST(total AS BIGINT) AS total, coalesce(n, 0) AS cohort_count, CAST(total - coalesce(n, 0) AS BIGINT) AS gap FROM t LEFT JOIN (SELECT * FROM d WHERE cohort = 'BUILDING') USING (skill) ORDER BY gap DESC, skill LIMIT 50""")
def cohort_gap(spark, root):
    p = postings(spark, root).select("posting_id", F.col("sector").alias("cohort"))
    d = elements(spark, root).select("posting_id", "skill").distinct().join(p, "posting_id").groupBy("skill").agg(_n().alias("total"), F.count_if(F.col("cohort") == "BUILDING").alias("cohort_count"))
    return d.withColumn("gap", F.col("total") - F.col("cohort_count")).orderBy(F.desc("gap"), "skill").limit(50)


@query("""SELECT p_brand AS skill, count(DISTINCT o_orderkey) AS n, round(count(DISTINCT o_orderkey) / (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT'), 6) AS share FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1 ORDER BY n DESC, skill LIMIT 20""")
def role_benchmark(spark, root):
    o = table(spark, root, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("posting_id"))
    total = o.agg(_n().alias("total"))
    rows = elements(spark, root).select("posting_id", "skill").distinct().join(o, "posting_id").groupBy("skill").agg(_n().alias("n"))
    return rows.join(F.broadcast(total), F.lit(True)).select("skill", "n", F.round(F.col("n") / F.col("total"), 6).alias("share")).orderBy(F.desc("n"), "skill").limit(20)


@query("""SELECT c_mktsegment AS sector, n_name AS place, count(*) AS n, count(DISTINCT o_custkey) AS employers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL ORDER BY n DESC, sector, place LIMIT 40""")
def market_context(spark, root):
    per = postings(spark, root).groupBy("sector", "subregion", "company_id").agg(_n().alias("n"))
    return per.groupBy("sector", F.col("subregion").alias("place")).agg(F.sum("n").alias("n"), _n().alias("employers")).orderBy(F.desc("n"), "sector", "place").limit(40)


@query("""WITH l AS (SELECT list_distinct(list_sort([lower(trim(coalesce(s.skill_name, s.label))) FOR s IN coalesce(skills, []) IF trim(coalesce(s.skill_name, s.label, '')) <> ''])) AS k FROM (SELECT DISTINCT ON (id) * FROM extracted_intelligence ORDER BY id)), e AS (SELECT unnest(k) AS label FROM l), t AS (SELECT label, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, label LIMIT 12),
p AS (SELECT a, b FROM (SELECT k, unnest(k) AS a FROM l), LATERAL (SELECT unnest(k) AS b)) SELECT a AS label_a, b AS label_b, count(*) AS n FROM p WHERE a IN (SELECT label FROM t) AND b IN (SELECT label FROM t) AND a <> b GROUP BY ALL""")
def skill_matrix(spark, root):
    """How often the most frequent skills occur together, both ways round."""
    e = table(spark, root, "extracted_intelligence").dropDuplicates(["id"])
    names = F.filter(F.transform("skills", lambda s: F.lower(F.trim(F.coalesce(s["skill_name"], s["label"])))), lambda x: x.isNotNull() & (x != ""))
    sets = e.select("id", F.explode(F.array_distinct(names)).alias("label"))
    top = sets.groupBy("label").agg(_n().alias("n")).orderBy(F.desc("n"), "label").limit(12).select("label")
    kept = sets.join(F.broadcast(top), "label").groupBy("id").agg(F.collect_list("label").alias("k"))
    pairs = kept.select("k", F.explode("k").alias("label_a")).select("label_a", F.explode("k").alias("label_b")).filter("label_a <> label_b")
    return pairs.groupBy("label_a", "label_b").agg(_n().alias("n"))


# ---- one week, as a refresh computes it: a range of the date itself reaches the scan --------------------------------------

_WEEK = "1997-06-02"
_IN_WEEK = f"date_posted >= TIMESTAMP '{_WEEK}' AND date_posted < TIMESTAMP '{_WEEK}' + INTERVAL 7 DAY"
_ROWS_SQL = f"WITH {sql.ROWS}, w AS (SELECT * FROM skill_rows WHERE {_IN_WEEK})"


def _week_rows(spark, root):
    return in_week(skill_rows(spark, root), "date_posted", _WEEK)


@query(f"{_ROWS_SQL} SELECT skill AS label, count(DISTINCT posting_id) AS posting_count, count(DISTINCT company_id) AS employer_count FROM w GROUP BY ALL")
def skill_demand_one_week(spark, root):
    return demand(_week_rows(spark, root), F.col("skill")).drop("week_start")


@query(f"{_ROWS_SQL} SELECT tool AS label, count(DISTINCT posting_id) AS posting_count FROM w GROUP BY ALL")
def tool_demand_one_week(spark, root):
    return demand(_week_rows(spark, root), F.col("tool"), company=None).drop("week_start")


@query(f"""{_ROWS_SQL}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY skill) AS rn FROM (SELECT DISTINCT posting_id, skill FROM w)) WHERE rn <= 20)
SELECT a.skill AS skill_a, b.skill AS skill_b, count(*) AS pair_count FROM c a JOIN c b ON a.posting_id = b.posting_id AND a.skill < b.skill GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 200""")
def co_occurrence_one_week(spark, root):
    return pair_table(_week_rows(spark, root), "posting_id", "skill")


@query(f"""WITH {sql.POST}, {sql.ELEM}, w AS (SELECT * FROM post WHERE {_IN_WEEK}), agg AS (SELECT sector, count(*) AS posting_count, count(DISTINCT company) AS employer_count, quantile_disc(salary, 0.5) AS p50_salary FROM w GROUP BY sector HAVING count(*) >= 5),
cnt AS (SELECT sector, lower(trim(skill)) AS skill, count(*) AS cnt FROM w JOIN elem USING (posting_id) GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY cnt DESC, skill) AS rn FROM cnt)
SELECT sector, posting_count, employer_count, p50_salary, coalesce((SELECT string_agg(skill, ',' ORDER BY rn) FROM rk WHERE rk.sector = agg.sector AND rn <= 10), '') AS top_skills FROM agg""")
def sector_summary_one_week(spark, root):
    week = in_week(postings(spark, root), "date_posted", _WEEK)
    return sector_summary(week, elements(spark, root).select("posting_id", "skill")).withColumn("top_skills", F.array_join("top_skills", ","))


@query(f"WITH {sql.ROWS} SELECT week_start, skill AS label, count(DISTINCT posting_id) AS posting_count, count(DISTINCT company_id) AS employer_count FROM skill_rows WHERE subregion IN ('NATION_3', 'NATION_7') GROUP BY ALL".replace("week_start, skill AS label", "CAST(week_start AS VARCHAR) AS week_start, skill AS label"))
def tenant_weekly_demand(spark, root):
    """The weekly table that a tenant of two places sees."""
    from .router import Router

    return Router(spark, root, tenant=["NATION_3", "NATION_7"]).weekly().withColumn("week_start", F.col("week_start").cast("string"))

import datetime as dt

import pytest
from pyspark.sql import functions as F

from laborloom.plans import guard
from laborloom.plans.router import Cache, Request, Router, guess_intent, role_words, weeks_back
from laborloom.sources import records
from laborloom.operators import weekly
from laborloom.sources.paged import PagedSource, RateLimited, Throttle, fetch_all, fetch_with_retry
from laborloom.streaming import jobs
from tests.conftest import DATA

OK = ["SELECT * FROM skill_velocity", "with x as (select 1 a) select * from x", "SELECT a FROM dbo.canonical_roles UNION SELECT a FROM skill_velocity", "SELECT count(*) FROM skill_velocity WHERE a IN (SELECT a FROM canonical_roles) LIMIT 1000"]
BAD = ["", "DROP TABLE skill_velocity", "SELECT 1; SELECT 2", "SELECT * FROM users", "INSERT INTO skill_velocity SELECT 1", "WITH x AS (SELECT * FROM secrets) SELECT * FROM x", "SELECT * FROM skill_velocity WHERE a IN (SELECT a FROM secrets)",
       "SELECT * FROM other.skill_velocity", "SHOW TABLES", "SELEC 1", "SELECT * FROM range(5)", "x" * 30_000, "SET spark.x=1", "SELECT * FROM parquet.`/etc`"]


def test_guard(spark):
    assert [s for s in OK if not guard.check(spark, s).ok] == []
    assert [s for s in BAD if guard.check(spark, s).ok] == []


CALLS = [
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS h", "SELECT java_method('java.lang.System', 'exit', 0)", "SELECT input_file_name() FROM skill_velocity",
    "SELECT a FROM skill_velocity WHERE length(reflect('java.lang.System', 'getenv', 'HOME')) > 0", "SELECT a FROM skill_velocity ORDER BY try_reflect('a', 'b')", "SELECT current_user()",
    "SELECT a FROM skill_velocity WHERE a IN (SELECT reflect('java.lang.System', 'getenv', 'HOME') FROM canonical_roles)", "SELECT sum(a) OVER (ORDER BY reflect('x', 'y')) FROM skill_velocity",
    "SELECT spark_catalog.default.f(a) FROM skill_velocity", "SELECT a FROM skill_velocity LATERAL VIEW stack(2, a, a) AS z", "WITH x AS (SELECT reflect('a', 'b') AS a) SELECT a FROM x",
    "SELECT CASE WHEN a > 1 THEN reflect('a', 'b') END FROM skill_velocity", "SELECT a FROM skill_velocity GROUP BY a HAVING max(reflect('a', 'b')) > '1'", "SELECT `reflect`('a', 'b')",
]
FINE = ["SELECT round(avg(a), 2) AS m, count(DISTINCT b) FROM skill_velocity GROUP BY date_trunc('week', c)", "SELECT row_number() OVER (ORDER BY a) FROM skill_velocity", "SELECT x FROM skill_velocity LATERAL VIEW explode(a) AS x", "SELECT a::int, CASE WHEN a THEN 1 END FROM skill_velocity WHERE a LIKE 'x%' AND lower(b) IN ('y')"]


def test_guard_functions(spark):
    assert [s for s in CALLS if guard.check(spark, s).ok] == []
    assert [(s, guard.check(spark, s).reason) for s in FINE if not guard.check(spark, s).ok] == []


def test_role_rule(spark):
    text = "SELECT role_classification, count(*) FROM job_postings GROUP BY 1"
    assert guard.check(spark, text, guard.ASK_TABLES).tables == ("job_postings",)
    rule = guard.role_rule(text, "Employer", ("job_postings",))
    views = {"job_postings": spark.createDataFrame([("Nurse",), (guard.NO_ROLE,), (None,)], "role_classification string")}
    assert [r["role_classification"] for r in guard.run(spark, text, views, guard.ASK_TABLES, where=rule)] == ["Nurse"]
    assert guard.role_rule(text, "trend", ("job_postings",)) == {} and guard.role_rule("SELECT 1 FROM job_postings", "employer", ("job_postings",)) == {}


def test_guarded_run(spark):
    views = {"skill_velocity": spark.range(500).withColumnRenamed("id", "a")}
    assert len(guard.run(spark, "SELECT * FROM dbo.skill_velocity LIMIT 1000", views)) == 100
    assert len(guard.run(spark, "SELECT * FROM skill_velocity", views, where={"skill_velocity": F.col("a") < 7})) == 7
    with pytest.raises(ValueError):
        guard.run(spark, "SELECT * FROM nope", views)


def test_router(spark):
    r = Router(spark, DATA)
    a = r.answer(Request("trend"))
    assert a.routed and a.error is None and len(a.rows) == 100 and a.is_partial
    assert not r.answer(Request("other")).routed and not r.answer(Request("nonsense")).routed
    assert r.known_skills(["brand#1"]) and not r.known_skills(["nothing"])
    assert guess_intent("Compare welding vs plumbing") == "comparison" and guess_intent("hello") == "other"
    assert weeks_back(["last 3 months"]) == 12 and weeks_back([]) == 12 and weeks_back(["2 years"]) == 104
    assert role_words(["Senior data engineer", "Data QA"]) == ["senior", "data", "engineer"]


def test_cache():
    now = [0.0]
    c, calls = Cache(hours=1, clock=lambda: now[0]), []
    make = lambda: calls.append(1) or len(calls)
    assert c.get("a", {"x": 1}, make) == 1 and c.get("a", {"x": 1}, make) == 1
    now[0] = 3601
    assert c.get("a", {"x": 1}, make) == 2 and c.get("a", {"x": 2}, make) == 3


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"posting_id": 7, "job_title": "Cook", "url": "u"}, {"id": 8}]')
    got = records.read(spark, "json", path=str(tmp_path / "a.json"), source="s").orderBy("external_id").collect()
    assert [(r["external_id"], r["title"], r["source"]) for r in got] == [("7", "Cook", "s"), ("8", None, "s")]
    with pytest.raises(ValueError):
        records.read(spark, "nope")
    fill = "<!-- " + "x" * 120 + " -->"
    pages = spark.createDataFrame([("u1", '<a class="job x" href="/1"><b>Cook</b></a><a class="job" href="/2">Nurse</a>' + fill), ("u2", "Just a moment..." + fill), ("u3", '<a class="job" href="/3">Short</a>'), ("u4", None)], "url string, html string")
    assert [(r["link"], r["title"]) for r in records.job_cards(pages).orderBy("position").collect()] == [("/1", "Cook"), ("/2", "Nurse")]
    ld = '<script type="application/ld+json">{"title": "Cook", "hiringOrganization": {"name": "Acme"}, "baseSalary": {"currency": "USD", "value": {"minValue": 10, "maxValue": 12, "unitText": "HOUR"}}}</script><h1>x</h1>'
    p = records.posting_pages(spark.createDataFrame([("u", ld + fill), ("v", "<h1>Nurse</h1><p>text. Full-time in El Paso, TX for $20 - $25 / hour</p>" + fill)], "url string, html string")).orderBy("job_url").collect()
    assert (p[0]["title"], p[0]["company"], p[0]["salary_raw"]) == ("Cook", "Acme", "USD 10-12 HOUR") and p[1]["title"] == "Nurse"
    assert (p[1]["employment_type"], p[1]["state"], p[1]["salary_raw"]) == ("Full-time", "TX", "$20 - $25 / hour")
    q = spark.createDataFrame([("q", ["a", "b"], ["t1", "t2"]), ("r", ["c"], [])], "query string, keywords array<string>, tiers array<string>")
    assert records.fan_out(q).count() == 5
    assert records.table_or_empty(spark, "no_such_table", records.RAW)[1]
    assert [r["id"] for r in records.page(spark.range(10), [F.desc("id")], 0, -5).collect()] == [9]


def test_more_sources(spark, tmp_path):
    nested = spark.createDataFrame([(1, ("a", ("b", 2)), [1])], "id int, x struct<n: string, y: struct<m: string, k: int>>, l array<int>")
    assert records.flatten(nested).columns == ["id", "x_n", "x_y_m", "x_y_k", "l"]
    assert records.health(spark, "json", path=str(tmp_path / "no.json"))["ok"] is False and records.health(spark, "nope")["error"]
    spark.range(1).createOrReplaceTempView("seen_table")
    assert ("seen_table", 1, "id", "bigint") in [tuple(r) for r in records.tables_and_columns(spark).collect()]
    listed = spark.createDataFrame([("u1",), ("u2",)], "conceptUri string")
    entries = spark.createDataFrame([("u1", "Cook", "chef\nchef\n cook ", None)], "conceptUri string, preferredLabel string, altLabels string, hiddenLabels string")
    assert sorted(tuple(r) for r in records.listed_names(listed, entries).collect()) == [("u1", "Cook", "preferredLabel"), ("u1", "chef", "altLabels"), ("u1", "cook", "altLabels"), ("u2", None, None)]
    (tmp_path / "s.json").write_text('[{"id": "1", "title": "a"}, {"id": "2", "title": "b"}]')
    (tmp_path / "t.json").write_text('[{"id": "2", "title": "c"}, {"id": "3", "title": "d"}]')
    records.seed(spark, str(tmp_path / "s.json"), f"file://{tmp_path}/tab", ["external_id"]).write.parquet(f"file://{tmp_path}/tab")
    assert sorted((r["external_id"], r["title"]) for r in records.seed(spark, str(tmp_path / "t.json"), f"file://{tmp_path}/tab", ["external_id"]).collect()) == [("1", "a"), ("2", "c"), ("3", "d")]
    assert records.markdown(spark.createDataFrame([(1, "a|b"), (2, None)], "x int, y string")) == "| x | y |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |"
    records.report(spark.range(3), f"file://{tmp_path}/r", "csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/r").count() == 3


def test_week_replacement(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    df = spark.createDataFrame([("a", 1), ("b", 2)], "label string, n int")
    assert weekly.replace_week(df, path, "2024-01-01") == 2 and weekly.replace_week(df, path, "2024-01-08") == 2
    assert weekly.replace_week(df.filter("n = 1"), path, "2024-01-01") == 1 and weekly.replace_week(df.filter("n = 9"), path, "2024-01-08") == 0
    assert [r["label"] for r in spark.read.parquet(path).collect()] == ["a"]


def test_rate_keys_and_last_page():
    calls, slept = [], []

    def fetch(keyword, page, key):
        calls.append((page, key))
        if key == "k1" or (page == 1 and len(calls) < 5):
            raise RateLimited("no")
        return [{"id": i} for i in range(2 if page == 0 else 1)]

    now = [0.0]
    throttle = Throttle(2.0, lambda: now[0], slept.append)
    got = list(fetch_all(fetch, "cook", 10, 2, throttle, keys=["k1", "k2"], sleep=slept.append))
    assert got == [(0, {"id": 0}), (0, {"id": 1}), (1, {"id": 0})]
    assert calls[:2] == [(0, "k1"), (0, "k2")] and slept == [0.5, 0.5]
    with pytest.raises(RateLimited):
        fetch_with_retry(lambda *a: (_ for _ in ()).throw(RateLimited("x")), "a", 0, keys=["k"], sleep=lambda s: None)


def test_replay_after_a_crash(spark, tmp_path):
    path, out = events(spark, tmp_path, 200), str(tmp_path / "out")
    write = lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")
    counters = jobs.Counters()
    handled = jobs.crash_and_replay(lambda: jobs.read_files(spark, path, files=1), counters.around(write), str(tmp_path / "cp"), crashes=2)
    ids = [r["event_id"] for r in spark.read.parquet(out).collect()]
    assert handled == 5 and sorted(ids) == list(range(200))
    assert counters.published == 200 and counters.delivered > 200 and counters.in_flight == 0 and counters.peak > 0


def test_ordered_log_goes_on_where_it_stopped(spark):
    applied, done = [], {}
    fail = [True]

    def apply(row):
        if row["id"] == 3 and fail.pop() if fail else False:
            raise OSError("no")
        applied.append(row["id"])

    handle = jobs.one_by_one(apply, "id", done)
    with pytest.raises(OSError):
        handle(spark.range(6), 0)
    assert applied == [0, 1, 2]
    handle(spark.range(6), 0)
    assert applied == [0, 1, 2, 3, 4, 5]
    log = jobs.keyed(spark.createDataFrame([(2, "a"), (1, "a"), (3, "b")], "n int, c string"), F.col("c"), "n").collect()
    assert [(r["key"], r["value"]) for r in log if r["key"] == "a"] == [("a", '{"n":1,"c":"a"}'), ("a", '{"n":2,"c":"a"}')]


def test_paged_source(spark):
    spark.dataSource.register(PagedSource)
    df = spark.read.format("paged_postings").option("keywords", "cook,nurse").option("pages", "2").option("fetch", "laborloom.sources.paged.demo_fetch").load()
    assert df.count() == 8 and df.select("external_id").distinct().count() == 8
    whole = spark.read.format("paged_postings").option("keywords", "cook,nurse").option("size", "2").option("rate", "1000").option("fetch", "laborloom.sources.paged.demo_fetch").load()
    assert whole.count() == 14  # three full pages and one that ends them, of each keyword


def events(spark, tmp_path, n=300, name="in"):
    path = str(tmp_path / name)
    jobs.synthetic(spark, n).repartition(3).write.parquet(path)
    return path


def test_stream_equals_batch(spark, tmp_path):
    path = events(spark, tmp_path)
    out, seen = str(tmp_path / "out"), []
    build = lambda df: df.groupBy("week_start", "event_type").agg(F.count(F.lit(1)).alias("n"))
    handle = jobs.recompute_weeks(lambda: spark.read.parquet(path), build, out)
    for _ in range(2):  # the second start finds nothing new
        q = jobs.start(jobs.read_files(spark, path, files=1), lambda b, i: (seen.append(i), handle(b, i)), str(tmp_path / "cp"))
        q.awaitTermination()
    assert len(seen) == 3
    want = sorted((str(r[0]), r[1], r[2]) for r in build(spark.read.parquet(path).withColumn("week_start", F.to_date(F.date_trunc("week", "ts")))).collect())
    assert sorted((str(r["week_start"]), r["event_type"], r["n"]) for r in spark.read.parquet(out).collect()) == want


def test_windows_in_append_mode(spark, tmp_path):
    path = events(spark, tmp_path, 200, "w")
    for make in (jobs.tumbling, jobs.sliding, jobs.sessions, jobs.first_seen):
        name = make.__name__
        q = make(jobs.read_files(spark, path)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() >= 0
    assert spark.table("first_seen").count() == 200


def test_routes(spark):
    r, got = jobs.Routes(), []
    with pytest.raises(PermissionError):
        r.subscribe("SourceFailed", "dashboard", lambda b, i: None)
    r.subscribe("IngestBatch", "dashboard", lambda b, i: got.append(b.count()))
    r.deliver(jobs.synthetic(spark, 100), 0)
    assert got == [jobs.synthetic(spark, 100).filter("event_type = 'IngestBatch'").count()]
    ok, bad = jobs.valid_events(spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "a"), (None, None, "")], "event_id long, ts timestamp, event_type string"))
    assert ok.count() == 1 and bad.collect()[0]["reason"] == "no id"
    now = dt.datetime(2024, 1, 1, 1)
    assert jobs.stale({"a": now - dt.timedelta(minutes=15), "b": now - dt.timedelta(minutes=16)}, now) == [{"table": "b", "age_minutes": 16.0}]

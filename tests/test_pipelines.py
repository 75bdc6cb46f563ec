from pyspark.sql import functions as F

from laborloom import queries
from laborloom.functions import hooks
from laborloom.operators import pipelines, taxonomy
from tests.conftest import DATA


def test_hooks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "k int, p string")
    got = {r["k"]: r["answer"] for r in hooks.ask(df, "k", "p", lambda ps: [p.upper() for p in ps]).collect()}
    assert got == {1: "A", 2: "A", 3: "B", 4: None}

    def broken(prompts):
        raise OSError

    assert {r["answer"] for r in hooks.ask(df, "k", "p", broken).collect()} == {None}
    assert hooks.pick_code("15-1252", ["151252", "x"]) == "151252" and hooks.pick_code("the code is 15-1252.", ["15-1252"]) == "15-1252" and hooks.pick_code("99", ["1"]) == "unclassified"
    assert hooks.read_records('```json\n{"skills": [{"n": "a", "confidence": 0.8}, {"n": "", "confidence": 1}, {"n": "b", "confidence": 0.7}]}\n```', ("n",)) == ([{"n": "a", "confidence": 0.8}], False)
    assert hooks.read_records("oops", ("n",)) == ([], True)
    assert "rising" in hooks.summary("welding", "rising", 3, 1)


def test_taxonomy(spark):
    labels = spark.createDataFrame([("Python ",), ("python (language)",), ("GenAI",), ("tensor flow",), ("zzz",), (" ",), (None,)], "l string")
    catalog = spark.createDataFrame([("u2", "Python"), ("u1", "python"), ("u3", "Python, language")], "uri string, name string")
    ext = spark.createDataFrame([("g1", "genai")], "uri string, name string")
    near = spark.createDataFrame([("tensor flow", "u9", 0.95), ("zzz", "u9", 0.5)], "label string, uri string, similarity double")
    got = {r["label"]: (r["uri"], r["step"]) for r in taxonomy.resolve(labels, "l", catalog, ext, near).collect()}
    assert got == {"Python ": ("u1", 2), "python (language)": ("u3", 3), "GenAI": ("g1", 1), "tensor flow": ("u9", 4), "zzz": (None, 6)}


def test_stages(spark):
    cols = "arrival int, source string, external_id string, title string, company string, description string, date_posted string, employment_type string, salary_raw string"
    batch = spark.createDataFrame([(1, "b", "x", " <b>Cook</b> ", "Acme", None, "2024-01-02", "FT", "$10-12/hr"), (2, "a", "x", " <b>Cook</b> ", "Acme", None, None, None, None), (3, "a", "y", " ", "Acme", None, None, None, None), (4, "a", "z", "t", "Acme", None, None, None, "$12-10/hr")], cols)
    one = pipelines.ingest(batch, spark.createDataFrame([], "storage_hash string"), F.when(F.col("source") == "a", 0).otherwise(1))
    assert sorted(r["arrival"] for r in one.passed.collect()) == [2, 3, 4] and [r["arrival"] for r in one.rejected.collect()] == [1]
    again = pipelines.ingest(batch, one.passed, F.lit(0))
    assert [r["arrival"] for r in again.passed.collect()] == [1]  # another source's hash, so not stored yet
    two = pipelines.normalise(batch)
    assert {r["error_type"]: r["n"] for r in two.counts.collect()} == {"title": 1, "salary": 1}
    first = two.passed.filter("arrival = 1").collect()[0]
    assert (first["title"], first["salary_min"], first["employment_type"], str(first["date_posted"])[:10]) == ("Cook", 10.0, "full_time", "2024-01-02")
    t, s = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), spark.createDataFrame([(1, None), (2, "n"), (3, "m")], "k int, v string")
    assert sorted(tuple(r) for r in pipelines.promote(t, s, ["k"]).collect()) == [(1, "a"), (2, "n"), (3, "m")]


def test_all_runs_equal_run_after_run(spark):
    raw = spark.read.parquet(f"{DATA}/raw_ingested_jobs.parquet").dropDuplicates(["id"]).withColumn("arrival", F.col("id"))
    rows = raw.withColumn("run", F.concat(F.lit("r"), F.floor(F.col("id") / 60).cast("string"))).filter("id < 240").unionByName(raw.filter("id < 40").withColumn("arrival", F.col("id") + 1000).withColumn("run", F.lit("r4")))
    priority = F.when(F.col("source") == "jobfeed_api", 0).otherwise(1)
    all_at_once = pipelines.ingest_all(rows, "run", priority)
    stored, got, state = rows.limit(0).select(F.lit("").alias("storage_hash")), set(), None
    for run in sorted(r[0] for r in rows.select("run").distinct().collect()):
        one = pipelines.ingest(rows.filter(F.col("run") == run), stored, priority).passed.localCheckpoint()
        got |= {r["arrival"] for r in one.select("arrival").collect()}
        stored = stored.union(one.select("storage_hash")).localCheckpoint()
        new = one.select("fingerprint", "run", "arrival", "city", "salary_raw")
        state = (new if state is None else pipelines.promote(state, new, ["fingerprint"])).localCheckpoint()
    assert {r["arrival"] for r in all_at_once.passed.collect()} == got and all_at_once.rejected.count() == rows.count() - len(got) > 0
    promoted = pipelines.promote_all(all_at_once.passed.select("fingerprint", "run", "arrival", "city", "salary_raw"), ["fingerprint"], "run")
    assert sorted(map(str, promoted.collect())) == sorted(map(str, state.collect()))


def test_query_runs_over_every_batch(spark):
    got = {r["outcome"]: r["n"] for r in queries.QUERIES["pipeline_stages"](spark, DATA).collect()}
    assert got["repeated"] + got["normalised"] + got["rejected"] == spark.read.parquet(f"{DATA}/raw_ingested_jobs.parquet").count()
    assert 0 < got["roles"] <= got["promoted"] <= got["normalised"]


def test_roles(spark):
    rows = spark.createDataFrame([("r", "a", 1), ("r", "b", 1), ("r", "a", 2), ("q", "c", 3)], "role string, l string, p int")
    known = spark.createDataFrame([("b",)], "l string")
    got = sorted((r["role"], r["l"], r["demand_pct"]) for r in pipelines.top_of_role(rows, "role", "l", "p", known).collect())
    assert got == [("q", "c", 1.0), ("r", "b", 0.5)]
    c = spark.createDataFrame([(1, " Data  Eng", ["t"], ["s"]), (2, "data eng", ["u"], ["s"]), (3, None, [], [])], "cluster_id int, label string, top_title array<string>, top_skill array<string>")
    ids = [r["role_id"] for r in pipelines.role_ids(c).orderBy("cluster_id").collect()]
    assert len(set(ids)) == 3 and ids == [r["role_id"] for r in pipelines.role_ids(c).orderBy("cluster_id").collect()]

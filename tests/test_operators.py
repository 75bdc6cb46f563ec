import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from laborloom import queries
from laborloom.operators.quantiles import quantiles
from laborloom.operators import roles, checks, clusters, dedup, eras, gates, matching, mentions, scoring, similarity, upserts, velocity, weekly, windows


def test_gates_keep_their_nulls(spark):
    df = spark.createDataFrame([(1, None, 0.9), (2, True, 0.1), (3, False, 0.91), (4, False, None)], "company_id int, is_spam boolean, spam_score double")
    ids = lambda d: sorted(r["company_id"] for r in d.collect())
    assert ids(gates.analytics_gate(df)) == [1, 4]
    assert ids(gates.clustering_gate(df)) == [2, 4]
    assert ids(gates.strict_gate(df)) == [3, 4]
    assert ids(gates.tolerant_gate(df)) == [1, 3, 4]
    assert gates.enough_new(df, "company_id", 2, 2) and not gates.enough_new(df, "company_id", 2, 3)
    assert gates.entitled(df, "company_id", []).count() == 0 and gates.entitled(df, "company_id", None).count() == 4


def test_velocity_smooths_over_present_weeks(spark):
    t = dt.date(2026, 4, 13)
    w = [t - dt.timedelta(days=7 * i) for i in range(4, -1, -1)]
    rows = [("a", d, n) for d, n in zip(w, [10, 10, 10, 10, 1000])] + [("z", w[0], 0), ("new", w[4], 5), ("gone", w[0], 8)]
    df = spark.createDataFrame(rows, "label string, week_start date, posting_count long")
    got = {r["label"]: r for r in velocity.velocity(df, t).collect()}
    assert got["a"]["change"] == 24.75 and got["a"]["trend"] == "accelerating" and got["a"]["demand_count"] == 1000
    assert got["z"]["trend"] == "emerging" and got["z"]["change"] == 0.0
    assert got["new"]["trend"] == "accelerating" and got["new"]["change"] == 0.0
    assert got["gone"]["demand_count"] == 0
    two = velocity.velocity(df.filter(F.col("week_start").isin(w[3], w[4])), t).collect()
    assert {r["trend"] for r in two} == {"emerging"}


def test_velocity_without_target_week(spark):
    t = dt.date(2026, 4, 13)
    df = spark.createDataFrame([("a", t - dt.timedelta(days=7), 4)], "label string, week_start date, posting_count long")
    r = velocity.velocity(df, t).collect()[0]
    assert r["demand_count"] == 0 and r["trend"] == "stable"
    assert velocity.velocity(df.limit(0), t).count() == 0


def test_refresh_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("x", dt.date(2026, 1, 5), 1), ("y", dt.date(2026, 1, 12), 2)], "label string, week_start date, n long")
    weekly.refresh_week(a, path)
    weekly.refresh_week(a.filter("n = 2").withColumn("n", F.lit(7).cast("long")), path)
    weekly.refresh_week(a.filter("n = 2").withColumn("n", F.lit(7).cast("long")), path)
    got = sorted((r["label"], r["n"]) for r in spark.read.parquet(path).collect())
    assert got == [("x", 1), ("y", 7)]
    weekly.clear_week(spark, path, dt.date(2026, 1, 12))
    assert spark.read.parquet(path).count() == 1


def test_pairs_sort_and_repeat(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "c"), (3, None)], "p int, s string")
    assert [tuple(r) for r in weekly.pair_table(df, "p", "s").collect()] == [("a", "b", 2)]


def test_sector_needs_five(spark):
    base = spark.createDataFrame([(i, "s" if i < 5 else " ", "c", float(i)) for i in range(9)], "posting_id long, sector string, company string, salary double")
    skills = spark.createDataFrame([(0, "B"), (1, "b"), (2, "a")], "posting_id long, skill string")
    got = [tuple(r) for r in weekly.sector_summary(base, skills).collect()]
    assert got == [("s", 5, 1, 2.0, ["b", "a"])]


def test_windows(spark):
    df = spark.createDataFrame([(1, None, 9), (1, dt.datetime(2024, 1, 1), 1), (1, dt.datetime(2024, 1, 1), 2)], "k int, ts timestamp, id int")
    assert windows.latest_per_key(df, ["k"], "ts", "id").collect()[0]["id"] == 2
    assert sorted(r["id"] for r in windows.excess(df, [F.col("k")], [F.asc("id")]).collect()) == [2, 9]
    assert windows.last_turns(df.withColumn("t", F.col("id").cast("string")), "k", "id", "t", 2).collect()[0]["turns"] == ["2", "9"]


def test_eras(spark):
    rows = [("g", "a", 1, "x"), ("g", "a", 2, "y"), ("g", "c", 3, "y")]
    df = spark.createDataFrame(rows, "g string, era string, posting_id long, l string")
    steps = eras.era_steps(eras.dense_sets(df, "g", "l", ["a", "b", "c", "d"]), "g").orderBy("to_era").collect()
    assert [(s["kept"], s["added"], s["dropped"], s["jaccard"]) for s in steps] == [(0, 0, 2, 0.0), (0, 1, 0, 0.0), (0, 0, 1, 0.0)]
    empty = spark.createDataFrame([([], [])], "a array<string>, b array<string>").select(eras.jaccard(F.col("a"), F.col("b"))).collect()[0][0]
    assert empty == 1.0
    lab = spark.range(1).select(eras.patterns(F.lit(0.3), F.lit(-0.2), F.lit(0.0), F.lit(0.3), F.lit(True), F.lit(False), F.lit(True))).collect()[0][0]
    assert lab == ["Transformation", "Displacement", "Emergence"]


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a", None), (2, None, "x")], "k int, v string, w string")
    s = spark.createDataFrame([(1, "b", "n"), (3, "c", None)], "k int, v string, w string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(upserts.latest_wins(t, s, ["k"])) == [(1, "b", "n"), (2, None, "x"), (3, "c", None)]
    assert rows(upserts.insert_missing(t, s, ["k"])) == [(1, "a", None), (2, None, "x"), (3, "c", None)]
    assert rows(upserts.fill_missing(t, s, ["k"])) == [(1, "a", "n"), (2, None, "x"), (3, "c", None)]
    assert rows(upserts.fill_missing(t, s, ["k"], new_first=True))[0] == (1, "b", "n")
    assert rows(upserts.update_from(t, s, ["k"], ["v"])) == [(1, "b", None), (2, None, "x")]
    ok, bad = upserts.quarantine(t, {"v": F.col("v") != ""})
    assert ok.count() == 1 and bad.collect()[0]["error_type"] == "v"
    out, preview = upserts.fill_link(t.withColumn("link", F.lit(None).cast("int")), s.select(F.col("k").alias("sk")), F.col("k") == F.col("sk"), "link", F.col("sk"), "k")
    assert tuple(preview.collect()[0]) == (2, 0, 1) and sorted(str(r["link"]) for r in out.collect()) == ["1", "None"]
    assert upserts.cascade(s, "k", {"t": (t, "k")})["t"].count() == 1


def test_checks(spark):
    a = spark.createDataFrame([(1, 2), (2, 3)], "k int, v int")
    b = spark.createDataFrame([(2, 3), (3, 1)], "k int, v int")
    assert tuple(checks.drift(a, b, ["k"], "v").collect()[0])[:2] == (3, 2)
    assert {r["column_name"]: r["n_null"] for r in checks.null_rates(spark.createDataFrame([(1.0, None), (float("nan"), "x")], "a double, b string")).collect()} == {"a": 1, "b": 1}
    h = {r["bin"]: r["n"] for r in checks.histogram(spark.range(0, 101).select(F.col("id").cast("double").alias("v")), "v").collect()}
    assert h[11] == 1 and sum(h.values()) == 101


def vectors(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(5, 8))
    return [(i, i % 5, dt.datetime(2024, 1, 1) + dt.timedelta(days=int(rng.integers(0, 90))), [float(x) for x in base[i % 5] + rng.normal(scale=0.15, size=8)]) for i in range(n)]


def test_blocked_pairs_against_brute_force(spark):
    v = vectors(spark)
    df = spark.createDataFrame(v, "k long, b long, ts timestamp, v array<double>")
    cos = lambda x, y: float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
    want = {(a[0], b[0]) for a in v for b in v if a[0] < b[0] and a[1] == b[1] and cos(a[3], b[3]) > 0.95}
    for chunk in (1000, 3):
        assert {(r["a"], r["b"]) for r in similarity.pairs_in_block(df, "b", "k", "v", 0.95, chunk).collect()} == want
    near = {(a[0], b[0]) for a in v for b in v if a[1] == b[1] and dt.timedelta(0) < a[2] - b[2] <= dt.timedelta(days=30)}
    pairs = similarity.earlier_neighbours(df, "b", "k", "ts", "v")
    assert {(r["key"], r["other"]) for r in pairs.collect()} == near and pairs.count() == len(near)


def test_window_edges(spark):
    d = dt.datetime(2024, 3, 31)
    rows = [(1, 1, d, [1.0]), (2, 1, d - dt.timedelta(days=29), [1.0]), (3, 1, d - dt.timedelta(days=31), [1.0]), (4, 1, d, [1.0])]
    df = spark.createDataFrame(rows, "k long, b long, ts timestamp, v array<double>")
    got = {(r["key"], r["other"]) for r in similarity.earlier_neighbours(df, "b", "k", "ts", "v").collect()}
    assert got == {(1, 2), (4, 2), (2, 3)}
    best = similarity.nearest_earlier(similarity.earlier_neighbours(df, "b", "k", "ts", "v"), 1.0)
    assert best.count() == 0  # equal to the threshold is no match


def test_sequential_survivors(spark):
    d = dt.datetime(2024, 1, 1)
    rows = [("c", 1, d, [1.0, 0.0], 3), ("c", 2, d + dt.timedelta(days=1), [1.0, 0.01], 3), ("c", 3, d + dt.timedelta(days=2), [1.0, 0.02], 1), ("x", 4, d + dt.timedelta(days=3), [1.0, 0.0], 5), ("c", 5, d + dt.timedelta(days=60), [1.0, 0.0], 5)]
    df = spark.createDataFrame(rows, "co string, key long, ts timestamp, vector array<double>, filled int")
    links = dedup.sequential_survivors(df, "co")
    assert {(r["key"], r["survivor"]) for r in links.collect()} == {(1, 2), (3, 2)}
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8)], "key long, survivor long")
    assert {(r["key"], r["survivor"]) for r in dedup.follow(chain).collect()} == {(1, 4), (2, 4), (3, 4), (9, 8)}


def test_knn(spark):
    v = vectors(spark, 40, 3)
    df = spark.createDataFrame(v, "k long, b long, ts timestamp, v array<double>")
    got = similarity.knn(df, "k", "v", df.filter("k < 3").select(F.col("k").alias("query_id"), "v"), 4).collect()
    m = np.array([x[3] for x in v])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(3):
        s = m @ m[q]
        s[q] = -9
        assert [r["k"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == list(np.argsort(-s)[:4])


def test_matching(spark):
    assert matching.token_sort_ratio("Acme Tools Inc", "inc acme tools") == 100.0
    assert matching.partial_ratio("acme", "the acme company") == 100.0
    names = spark.createDataFrame([("acme tool",), ("zzz",), (None,)], "n string")
    got = {r["n"]: r["match_id"] for r in matching.fuzzy_best(names, "n", [("1", "acme tools"), ("2", "other")]).collect()}
    assert got == {"acme tool": "1", "zzz": None}
    df = spark.createDataFrame([("b",), (None,)], "k string")
    one = spark.createDataFrame([("b", "second")], "k string, v string")
    none = spark.createDataFrame([("a", "first")], "k string, v string")
    assert [(r["step"], r["found"]) for r in matching.cascade_lookup(df, [(F.col("k"), none), (F.col("k"), one)]).orderBy("k").collect()] == [(None, None), (2, "second")]


def test_likeness_search_equals_all_pairs(spark):
    base = ["sunmesa health network", "hecoruso steel works", "josephine freight lines", "acme tools", "acme tool", "x", ""]
    catalog = [(str(i), c) for i, c in enumerate(base)]
    wrong = ["sun mesa health network", "hecorso steel works", "freight lines josephine", "acme tols", "zzz", "acme toolz", "steel"]
    df = spark.createDataFrame([(w,) for w in [*wrong, None]], "n string")
    want = {tuple(r) for r in matching.fuzzy_best(df, "n", catalog).filter("match_id IS NOT NULL").collect()}
    assert len(want) >= 4 and {tuple(r) for r in matching.fuzzy_matches(df, "n", catalog).collect()} == want


def test_misspelt_employers_are_resolved(spark, tmp_path):
    spark.createDataFrame([(7, "Hecoruso Steel Works Inc."), (8, "Other")], "id long, company string").write.parquet(f"{tmp_path}/raw_ingested_jobs.parquet")
    spark.createDataFrame([(1, "Hecoruso Steel Works"), (2, "Hecorusso Steel Works LLC"), (3, "Zzz"), (4, None)], "job_id long, company string").write.parquet(f"{tmp_path}/job_records.parquet")
    got = {r["job_id"]: (r["resolved_id"], r["confidence"]) for r in queries.QUERIES["company_resolution"](spark, str(tmp_path)).collect()}
    assert got[1] == ("7", 0.95) and got[2][0] == "7" and 0.85 <= got[2][1] < 1 and got[3][0].startswith("new-") and got[4] == (None, None)


def test_mentions(spark):
    df = spark.createDataFrame([(1, "We use Spark SQL, spark and SQL. C++ too"), (2, None)], "id int, t string")
    got = [(r["label"], r["start_char"], r["end_char"]) for r in mentions.name_mentions(df, "id", ["t"], [("spark sql", "Spark SQL"), ("spark", "Spark"), ("c++", "C++")]).orderBy("start_char").collect()]
    assert got == [("Spark SQL", 7, 16), ("Spark", 18, 23), ("C++", 33, 36)]
    assert mentions.context_signals(df.withColumn("t", F.lit("Fully remote. Reports to a lead.")), "id", "t").count() == 4


def test_catalogue_mentions(spark):
    N = mentions.Name
    names = [N("Go", "Go", "language", 0.6, ("developer",)), N("Golang", "Go", "language", 0.9), N("C++", "C++", "language"), N("Power BI", "Power BI"), N("BI", "BI", "", 0.5), N(".NET", ".NET")]
    rows = [(1, "Go developer", "Golang and Power BI, C++11 no, C++ yes"), (2, "Let it go", "bi-weekly BI"), (3, None, ""), (4, "ASP.NET", "we like .NET")]
    got = mentions.catalogue_mentions(spark.createDataFrame(rows, "id int, a string, b string"), "id", ["a", "b"], names).collect()
    assert sorted((r["id"], r["label"], r["confidence"], r["field"], r["start_char"], r["text"]) for r in got) == [
        (1, "C++", 1.0, "b", 31, "C++"), (1, "Go", 0.9, "b", 0, "Golang"), (1, "Power BI", 1.0, "b", 11, "Power BI"), (2, "BI", 0.5, "b", 0, "bi"), (4, ".NET", 1.0, "b", 8, ".NET"),
    ]


def test_survivors_do_not_depend_on_classes(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    d = dt.datetime(2024, 1, 1)
    rows = []
    for k in range(120):
        v = centres[rng.integers(6)] + rng.normal(size=8) * 0.35
        rows.append((("hot" if rng.random() < 0.7 else "x"), k, d + dt.timedelta(hours=int(rng.integers(0, 24 * 90))), [float(x) for x in v], int(rng.integers(0, 4))))
    want = set()
    for co in ("hot", "x"):
        alive = []
        for _, key, ts, v, full in sorted((r for r in rows if r[0] == co), key=lambda r: (r[2], r[1])):
            v = np.array(v) / np.linalg.norm(v)
            alive = [s for s in alive if s[0] >= ts - dt.timedelta(days=30)]
            best = max(((float(v @ s[3]), -i) for i, s in enumerate(alive) if s[0] < ts), default=None)
            if best is None or best[0] <= 0.92:
                alive.append((ts, key, full, v))
            elif full >= alive[-best[1]][2]:
                want.add((alive[-best[1]][1], key))
                alive[-best[1]] = (ts, key, full, v)
            else:
                want.add((key, alive[-best[1]][1]))
    got = dedup.sequential_survivors(spark.createDataFrame(rows, "co string, key long, ts timestamp, vector array<double>, filled int"), "co")
    assert want and {(r["key"], r["survivor"]) for r in got.collect()} == want


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [(str(g), float(v)) for g in range(3) for v in rng.integers(0, 9, 40 + g)] + [("n", None), ("one", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for r in quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "z": 0.0, "m": 1.0}, mean="mean").collect():
        x = np.sort([v for g, v in rows if g == r["g"]])
        assert [r[c] for c in "abzm"] == [x[max(int(np.ceil(q * len(x))) - 1, 0)] for q in (0.25, 0.5, 0.0, 1.0)] and r["row_count"] == len(x) and abs(r["mean"] - x.mean()) < 1e-9
    both = quantiles(df, [], "v", {"p": 0.95, "h": 0.5}, between=True).collect()[0]
    x = [v for _, v in rows if v is not None]
    assert abs(both["p"] - np.quantile(x, 0.95)) < 1e-9 and both["h"] == np.median(x)


def test_roles(spark):
    df = spark.createDataFrame([(1, "Senior Data Engineer", None), (2, "Worker", "we do dataset engineering"), (3, "Cook", "soup"), (4, None, None), (5, "Health Aide", "care")], "i int, t string, d string")
    sectors = (("s1", "Health Care"), ("s2", "Unknown"))
    got = {r["i"]: r["r"] for r in df.select("i", roles.role(F.col("t"), F.col("d"), sectors=sectors).alias("r")).collect()}
    assert got == {1: "Data Engineering", 2: "Data Engineering", 3: "unclassified", 4: "unclassified", 5: "Health Care"}


def test_scores(spark):
    p = spark.createDataFrame([("a", "a", 8), ("a", "b", 2), ("b", "b", 5)], "truth string, guess string, n long")
    r = {x["label"]: x for x in scoring.class_report(p).collect()}
    assert r["a"]["recall_"] == 0.8 and r["b"]["precision_"] == round(5 / 7, 6)
    df = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("y", "y")], "a string, b string")
    assert scoring.kappa(df, "a", "b").collect()[0]["kappa"] == 0.5
    s = spark.createDataFrame([(["a"], ["a", "b"]), ([], [])], "f array<string>, t array<string>").select(scoring.set_scores(F.col("f"), F.col("t")).alias("s")).collect()
    assert s[0]["s"]["recall_"] == 0.5 and s[1]["s"]["f1"] == 1.0
    w = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double").select(scoring.weighted([(F.col("a"), 0.7), (F.col("b"), 0.3)]).alias("w")).collect()
    assert [x["w"] for x in w] == [1.0, None]


def test_clusters(spark):
    df = spark.createDataFrame([(i, i % 5, v) for i, _, _, v in vectors(spark)], "k long, truth long, v array<double>")
    got = clusters.cluster(df, "k", "v", 5, 4).join(df, "k")
    assert got.groupBy("cluster_id").agg(F.count_distinct("truth").alias("t")).filter("t > 1").count() == 0
    assert clusters.summarise(got.withColumn("title", F.col("truth").cast("string")), "v", {"title": 2}).count() == 5
    d = clusters.dominant_label(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "x"), (2, "y"), (2, "z"), (2, "w")], "g int, l string"), "g", "l").orderBy("g").collect()
    assert [x["label"] for x in d] == ["a", None]
    noise = spark.createDataFrame([("t", ["p", "q", "r"], "e1"), ("t", ["p"], "e2"), ("u", ["p", "q", "r"], "e1")], "g string, s array<string>, e string")
    known = spark.createDataFrame([("z",)], "skill string")
    assert [tuple(r) for r in clusters.novel_groups(noise, "g", "s", "e", known).collect()] == [("t", 2, ["p", "q", "r"])]


def test_batch_dedup_is_order_free(spark):
    rows = [(i, random.Random(i).choice(["a", "b"]), str(i % 4), "t", "c") for i in range(20)]
    df = spark.createDataFrame(rows, "id int, source string, external_id string, title string, company string")
    f = lambda d: {r["id"] for r in dedup.batch_survivors(dedup.with_hashes(d), ["fingerprint"], F.when(F.col("source") == "a", 0).otherwise(1), "id").collect()}
    assert f(df) == f(df.orderBy(F.desc("id"))) and len(f(df)) == 4
    assert dedup.new_rows(df, df.filter("id < 5"), "external_id").count() == 0

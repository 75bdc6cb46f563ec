import itertools

from laborloom.llm.automata import damerau
from laborloom.llm.names import bound, link_names, p3_found, read_name, trie_join
from tests.llm.tables import folder

SAME = [
    ["Botinamo Packaging", "BOTINAMO PACKAGING", "Packaging, Botinamo", "Boinamo Packging", "Botinamo Pkg. LLC", "Boti-namo Packaging #12", "Boti namo Packaging - El Paso", "The Botinamo Packaging Group (Hiring)", "Botinamo, Inc."],
    ["Guadalupe Hehirifi Home Furnishings", "Hehirifi, Lupe Home Furnishings", "G. Hehirifi Home Furn.", "Gpe Hehirifi Home Furnishngs Ltd"],
    ["Mococavu Health Care", "Mococavu Healthcare El Paso"], ["Mococavu Insurance Agency", "Mococavu Ins. Agcy"],
    ["Sunmesa Regional Health Network", "SRHN", "Sun Mesa Reg. Health Ntwk", "Health Network, Sunmesa Regional", "Sunmesa Helath Network", "Sunmesa Regional Hlth Network (SRHN)"],
    ["Rucibuci Laboratories", "Labs - Rucbiuci"], ["Jusojade Electric Supply", "Jusojade Elec. Sply"], ["LLC", "llc"], ["Vahalibi Credit Union", "Vahalibi Cr. Union Co.", "Vahalibi C.U."],
]


def test_classes(spark):
    values = [v for g in SAME for v in g]
    df = spark.createDataFrame([(v,) for v in values + values[:5] + [None]], "value string")
    got = {r["value"]: r["employer"] for r in link_names(df, frozenset({"el paso"})).collect()}
    assert set(got) == set(values)
    wrong = [(a, b) for a, b in itertools.combinations(values, 2) if (got[a] == got[b]) != any(a in g and b in g for g in SAME)]
    assert wrong == []


def test_bare_name_of_two_trades_is_left_alone(spark):
    df = spark.createDataFrame([("Mococavu Health Care",), ("Mococavu Insurance Agency",), ("Mococavu LLC",)], "value string")
    assert link_names(df).select("employer").distinct().count() == 3


def test_query(spark, tmp_path):
    jobs = [{"job_id": i, "company": c, "city": "Mesa"} for i, c in enumerate(["Acmezo Farms", "ACMEZO FARMS", "Acmezo Frms Mesa", "Acmezo Farms", None, "", " "])]
    got = sorted(tuple(r) for r in p3_found(spark, folder(spark, tmp_path, True, job_records=jobs)).collect())
    assert ("ACMEZO FARMS", "Acmezo Farms") in got and all(a < b for a, b in got)
    assert {x for p in got for x in p if "cmezo" in x.lower()} == {"Acmezo Farms", "ACMEZO FARMS", "Acmezo Frms Mesa"}
    assert p3_found(spark, folder(spark, tmp_path / "e", job_records=[])).count() == 0


def employers(spark, *values):
    got = {r["value"]: r["employer"] for r in link_names(spark.createDataFrame([(v,) for v in values], "value string")).collect()}
    return [[v for v in values if got[v] == e] for e in dict.fromkeys(got[v] for v in values)]


def test_order_of_words_and_given_names(spark):
    apart = [
        ["Smith Jones Electric", "Jones Smith Electric", "Electric, Jones Smyth"], ["Acme Rockets LLC", "Rockets Acme Inc"], ["Rivera Roofing", "Roofing, Rivera"],
        ["Robert Garcia Dental", "Bob Garcia Dental", "R. Garcia Dental"], ["William Garcia Dental", "Garcia, Bill Dental"], ["Garcia Dental"],
        ["Casa Bonita Restaurant", "Casa Bonnita Restaurnat"], ["Uno Dos Tres Cuatro Cinco", "Tres Cuatro Cinco Uno Dos"],
    ]
    assert employers(spark, *[v for g in apart for v in g]) == apart


def test_chains_of_edits_do_not_join(spark):
    common = [f"Miller Dental {x}".strip() for x in ("", "LLC", "Inc", "Co", "Ltd")]
    middle = ["Hiller Dental", "Hiller Dental LLC"]
    assert employers(spark, *common, *middle, "Hillen Dental", "Hallen Dental") == [[*common, *middle, "Hillen Dental"], ["Hallen Dental"]]


def test_trie_join_against_all_pairs(spark):
    import random

    rng = random.Random(2)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(3, 7))) for _ in range(150)}
    for _ in range(40):  # long words and what is up to two edits from them
        w = [rng.choice("abcdefghij") for _ in range(rng.randint(9, 14))]
        words.add("".join(w))
        for _ in range(rng.randint(1, 2)):
            k = rng.randrange(len(w) - 1)
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + ["x"] + w[k:], w[:k] + ["y"] + w[k + 1 :], w[:k] + [w[k + 1], w[k]] + w[k + 2 :]])
        words.add("".join(w))
    words = sorted(words)
    df = spark.createDataFrame([("x", w) for w in words] + [("y", w) for w in words[:40]], "block string, word string")
    got = {(r["block"], r["a"], r["b"]) for r in trie_join(df).collect()}
    near = lambda ws: {(a, b) for a, b in itertools.combinations(sorted(ws), 2) if damerau(a, b, 2) <= max(bound(a), bound(b))}
    both = {("x", a, b) for a, b in near(words)} | {("y", a, b) for a, b in near(words[:40])}
    assert both <= got
    assert all(damerau(a, b, 2) <= max(bound(a), bound(b)) for _, a, b in got)


def test_parts():
    r = read_name("José Jusojade Electric Supply, Inc.", frozenset())
    assert (r["given"], r["family"], r["trade"]) == ("jose", "jusojade", "electric supply")
    assert read_name("", frozenset())["family"] == ""

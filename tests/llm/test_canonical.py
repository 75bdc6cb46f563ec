import itertools
import random

from laborloom.llm.automata import Trie, damerau
from laborloom.llm.canonical import Matcher, bound, map_values, near_entries, p7_found
from tests.llm.tables import folder

ENTRIES = [(1, "title", "Registered Nurse"), (2, "title", "Data Engineer"), (3, "title", "Cook"), (4, "title", "Warehouse Manager"), (5, "title", "Security Guard"), (61, "employment_type", "full_time"), (63, "employment_type", "contract"), (67, "experience_level", "junior"), (68, "experience_level", "mid"), (70, "experience_level", "lead")]
CASES = [
    ("title", "Sr. Registered Nusre (Req 12345) - Dallas", 1), ("title", "R.N. PRN", 1), ("title", "ENGINEER - DATA, SR.", 2), ("title", "Lead Engineer - Data - Nights", 2), ("title", "big data enginer", 2), ("title", "Line Cook", 3), ("title", "koch (m/w/d)", 3),
    ("title", "Whse Mgr III (Weekends)", 4), ("title", "Manager, Warehouse | 2nd Shift", 4), ("title", "Guard - Security", 5), ("title", "Falconer", 0), ("title", "", 0), ("title", "Multiple Openings!", 0), ("title", "x" * 10_000, 0),
    ("employment_type", "N'full-time'", 61), ("employment_type", "Vollzeit", 61), ("employment_type", "Ful-time", 61), ("employment_type", "contract (12 mo)", 63), ("employment_type", "Any", 0),
    ("experience_level", "Associate", 67), ("experience_level", "Mid-Senior level", 68), ("experience_level", "Staff", 70), ("experience_level", "Tier 3", 0), ("city", "x", 0),
]


def test_cases(spark):
    values = spark.createDataFrame([(f, v) for f, v, _ in CASES] * 2 + [("title", None), (None, "x")], "field_name string, value string")
    got = {(r["field_name"], r["value"]): r["value_id"] for r in map_values(values, spark.createDataFrame(ENTRIES, "value_id long, field_name string, canonical string")).collect()}
    assert got == {(f, v): i for f, v, i in CASES}


def test_query(spark, tmp_path):
    jobs = [{"job_id": 1, "title": "cook", "employment_type": None, "experience_level": "jr."}, {"job_id": 1, "title": "cook", "employment_type": None, "experience_level": "jr."}, {"job_id": 2}]
    path = folder(spark, tmp_path, True, job_records=jobs, canonical_values=ENTRIES)
    got = sorted(tuple(r) for r in p7_found(spark, path).collect())
    assert got == [(1, "experience_level", 67)] * 2 + [(1, "title", 3)] * 2
    empty = folder(spark, tmp_path / "e", job_records=[], canonical_values=[])
    assert p7_found(spark, empty).count() == 0


def slow(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_against_matrix():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(120)})
    trie = Trie((w, w) for w in words)
    for q in words[::3]:
        for k in (0, 1, 2):
            assert dict(trie.within(q, k)) == {w: slow(q, w) for w in words if slow(q, w) <= k}
    assert damerau("ab", "ba", 2) == 1 and damerau("abcdef", "a", 2) == 3
    assert [bound("x" * n) for n in (3, 4, 8, 9)] == [0, 1, 1, 2]


def test_every_near_entry_is_returned(spark):
    m = Matcher({"title": [(1, "Cook"), (2, "Book"), (3, "Cooker")]})
    assert m.match("title", "Cook") == 1 and m.match("title", "Hook") == 1
    values = spark.createDataFrame([("title", "Hook"), ("title", "Cook"), ("title", "Zzzz")], "field_name string, value string")
    entries = spark.createDataFrame([(1, "title", "Cook"), (2, "title", "Book"), (3, "title", "Cooker")], "value_id long, field_name string, canonical string")
    got = sorted(tuple(r) for r in near_entries(values, entries).select("value", "rank", "value_id", "distance").collect())
    assert got == [("Cook", 0, 1, 0), ("Cook", 1, 2, 1), ("Hook", 0, 1, 1), ("Hook", 1, 2, 1), ("Zzzz", 0, None, None)]


def test_a_near_short_word_does_not_beat_the_title():
    m = Matcher({"title": [(1, "Cook"), (2, "Forklift Operator")]})
    assert m.match("title", "Forklfit Opertor - Kochi") == 2 and m.match("title", "Kochi") == 1


def test_aliases_are_an_argument(spark):
    values = spark.createDataFrame([("colour", "crimsonn"), ("colour", "navy"), ("colour", "rd")], "field_name string, value string")
    entries = spark.createDataFrame([(1, "colour", "red"), (2, "colour", "blue")], "value_id long, field_name string, canonical string")
    aliases = spark.createDataFrame([("colour", "crimson", "red", False), ("colour", "navy", "blue", True), ("colour", "teal", "green", False)], "field_name string, alias string, canonical string, alone boolean")
    assert {(r["value"], r["value_id"]) for r in map_values(values, entries, aliases).collect()} == {("crimsonn", 1), ("navy", 2), ("rd", 0)}

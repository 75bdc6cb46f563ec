import random

import numpy as np

from laborloom.llm.history import Levels, Segment, Texts, first_rows, near_copies, p6_found, replay, shared
from tests.llm.tables import folder

WORDS = [f"w{i}" for i in range(400)]


def advert(rng, n=60):
    return [rng.choice(WORDS) for _ in range(n)]


def reword(rng, words):
    out = list(words)
    for _ in range(len(words) // 12):
        k = rng.randrange(len(out))
        if rng.random() < 0.5:
            out[k] = rng.choice(WORDS)
        else:
            del out[k]
    return out


def row(i, text, city="Mesa", title="Cook", company="Acme", source="s", ext=None, run=None):
    return {"id": i, "ingestion_run_id": run or f"r{(i or 0) // 10}", "source": source, "external_id": ext or f"x{i}", "title": title, "company": company, "city": city, "description": text}


def test_rules(spark, tmp_path):
    rng = random.Random(1)
    a, b, c = (" ".join(advert(rng)) for _ in range(3))
    rows = [
        row(1, a), row(2, f"<p>{a.upper()}</p>", title="COOK - NEW", company=" acme "), row(3, a, city="Yuma"), row(4, a, title="Nurse"), row(5, " ".join(reword(rng, a.split())), source="t"),
        row(6, b), row(7, b.replace(" ", "  "), title="Cook *HOT*"), row(8, b, city=None, ext=" X6?utm=feed"), row(9, c, city="", ext="lone"), row(10, c, city=None, ext="lone:2"), row(11, c, ext="LONE#src=mail"),
        row(12, None), row(13, ""), row(14, "short text"), row(15, "Short  text!"), row(14, "short text"), row(16, "w " * 50_000), row(17, None, city=None, ext=None),
        row(None, a),
    ]
    rows[-2]["external_id"] = None
    got = dict((r["dup_id"], r["first_id"]) for r in p6_found(spark, folder(spark, tmp_path, True, raw_ingested_jobs=rows)).collect())
    assert got == {2: 1, 5: 1, 7: 6, 8: 6, 10: 9, 11: 9, 13: 12, 15: 14}


def test_empty(spark, tmp_path):
    assert p6_found(spark, folder(spark, tmp_path, raw_ingested_jobs=[])).count() == 0


def planted(seed, postings=60):
    rng = random.Random(seed)
    rows, truth = [], {}
    for p in range(postings):
        base = advert(rng)
        for k in range(rng.randint(1, 5)):
            rows.append((p, base if k == 0 else reword(rng, base)))
    rng.shuffle(rows)
    first = {}
    for i, (p, _) in enumerate(rows):
        truth[i] = first.setdefault(p, i)
    return [w for _, w in rows], truth


def test_replay_finds_planted_copies():
    texts, truth = planted(4)
    code = {w: i for i, w in enumerate(WORDS)}
    flat = np.array([code[w] for t in texts for w in t])
    offsets = np.cumsum([0, *map(len, texts)])
    for run in (7, 64, 10_000):  # the runs' size changes the segments, not the result
        got = replay(Texts(np.zeros(len(texts), np.int64), flat, offsets), run)
        assert dict(enumerate(got.tolist())) == truth


def test_owner_of_all_windows_hides_no_later_copy():
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    c = a[:30] + b[:30]  # shares half with each of two earlier postings
    d = c[:29] + ["x", "y"] + c[31:]  # a rewording at the junction, the only words that c had first
    texts = [a, b, c, d, [f"z{i}" for i in range(60)]]
    code = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    flat, offsets = np.array([code[w] for t in texts for w in t]), np.cumsum([0, *map(len, texts)])
    for run in (1, 2, 10):
        assert replay(Texts(np.zeros(len(texts), np.int64), flat, offsets), run).tolist() == [0, 1, 2, 2, 4]


def test_replay_equals_all_pairs():
    rng = random.Random(8)
    sentences = [advert(rng, rng.randint(5, 14)) for _ in range(12)]
    texts = []
    for _ in range(150):
        t = sum(rng.sample(sentences, 5), [])
        texts.append(reword(rng, t) if rng.random() < 0.7 else t)
    code = {w: i for i, w in enumerate(WORDS)}
    t = Texts(np.zeros(len(texts), np.int64), np.array([code[w] for x in texts for w in x]), np.cumsum([0, *map(len, texts)]))
    pairs = np.array([(i, j) for i in range(150) for j in range(i)])
    pairs = pairs[(shared(t, pairs) >= 0.6) & (shared(t, pairs[:, ::-1]) >= 0.6)]
    want = list(range(150))
    for a, b in pairs:
        x, y = want[a], want[b]
        want = [min(x, y) if w in (x, y) else w for w in want]
    assert len(set(want)) > 1 and replay(t, 16).tolist() == want


def test_hot_block_is_sharded_without_loss(spark):
    texts, truth = planted(6)
    df = spark.createDataFrame([(1, len(texts), i, " ".join(t)) for i, t in enumerate(texts)], "block long, n long, gid long, words string")
    for shard in (10_000, 9):
        got = {r["gid"]: r["root"] for r in near_copies(df, shard).collect()}
        assert got == {i: f for i, f in truth.items() if i != f}


def test_hot_block_keeps_short_copies(spark):
    rng = random.Random(9)
    rows = []
    for p in range(120):  # a stretch of 7 words is all that the two have in common
        a = [f"p{p}w{i}" for i in range(10)]
        rows += [(a, 2 * p), (["new", "here"] + a[2:9] + ["now"], 2 * p)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    df = spark.createDataFrame([(1, len(rows), i, " ".join(rows[k][0])) for i, k in enumerate(order)], "block long, n long, gid long, words string")
    cool, hot = ({r["gid"]: r["root"] for r in near_copies(df, shard).collect()} for shard in (10_000, 20))
    assert len(cool) == 120 and hot == cool


def test_hot_block_of_shared_sentences(spark):
    rng = random.Random(10)
    sentences = [advert(rng, rng.randint(5, 14)) for _ in range(12)]
    texts = [t if rng.random() < 0.3 else reword(rng, t) for t in (sum(rng.sample(sentences, 5), []) for _ in range(80))] + [["a"], ["a", "b", "c"]]
    df = spark.createDataFrame([(1, len(texts), i, " ".join(t)) for i, t in enumerate(texts)], "block long, n long, gid long, words string")
    cool, hot = ({r["gid"]: r["root"] for r in near_copies(df, shard).collect()} for shard in (10_000, 9))
    assert cool and hot == cool


def random_texts(rng, n=60, blocks=3, vocabulary=4):
    words = [[rng.randrange(1, vocabulary + 1) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 9, 30]))] for _ in range(n)]
    words[n // 2] = words[n // 3]
    return Texts(np.array([rng.choice([-5, 7, 2**40])] * n) if blocks == 1 else np.array([rng.choice([-5, 7, 2**40]) for _ in range(n)]), np.array([w for ws in words for w in ws]), np.cumsum([0, *map(len, words)]))


def test_suffix_array_is_sorted_and_finds_the_longest_match():
    rng = random.Random(12)
    for blocks in (1, 3):
        t = random_texts(rng, blocks=blocks)
        s = Segment(t, 0, 40)
        suffix = lambda p: (int(t.block[t.owner[p]]) % 2**64, t.words[p : p + t.left[p]].tolist(), t.owner[p])
        assert [suffix(p) for p in s.order] == sorted(suffix(p) for p in t.places(0, 40))
        at = t.places(40, 60)
        size, record = s.longest(t, at)
        for p, n, r in zip(at, size, record):
            block, words, _ = suffix(p)
            common = {}
            for x in t.places(0, 40):
                b, other, o = suffix(x)
                k = 0
                while b == block and k < min(len(words), len(other)) and words[k] == other[k]:
                    k += 1
                whole = k == len(words) == len(other)
                if k >= 4 or (whole and k):
                    common[o] = max(k, common.get(o, 0))
            best = max(common.values(), default=0)
            assert n == best and r == min((o for o, k in common.items() if k == best), default=-1)


def test_segments_merge_logarithmically():
    rng = random.Random(2)
    t = random_texts(rng, 640, vocabulary=50)
    levels = Levels()
    for i in range(0, 640, 10):
        levels.add(Segment(t, i, i + 10))
    assert len(levels.segments) <= 8 and levels.segments[0].first == 0 and levels.segments[-1].last == 640
    assert [s.last for s in levels.segments[:-1]] == [s.first for s in levels.segments[1:]]


def test_clashing_columns(spark):
    rows = [row(1, "a b c d e f g h"), row(2, "A b c d e f g h")]
    df = spark.createDataFrame([(r["id"], r["source"], r["external_id"], r["title"], r["company"], r["city"], r["description"], "x", "y") for r in rows], "id long, source string, external_id string, title string, company string, city string, description string, text string, gid string")
    assert sorted(tuple(r) for r in first_rows(df).collect()) == [(1, 1), (2, 1)]

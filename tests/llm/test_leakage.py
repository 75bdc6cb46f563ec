import random
import unicodedata

import numpy as np
import pytest

from laborloom.llm.leakage import EDITS, WINDOW, Items, Walks, edit_distances, leaks, p9_found, stretches, words_of
from tests.llm.tables import folder

VOCAB = [f"{a}{b}" for a in ("mar", "tel", "run", "sol", "pin", "dor", "gam", "vec") for b in ("ket", "mon", "ter", "lix", "par", "nos", "wid", "fex", "bru", "hal")]


def passage(rng, n=70):
    return [rng.choice(VOCAB) for _ in range(n)]


def noise(rng, n=80):
    return [f"n{rng.randrange(10_000)}" for _ in range(n)]


def retype(rng, words):
    out = [w if rng.random() > 0.07 else rng.choice(VOCAB) for w in words]
    return "  ".join(w.upper() if rng.random() < 0.2 else w + rng.choice(["", ",", "."]) for w in out)


def test_planted(spark, tmp_path):
    rng = random.Random(1)
    items = [passage(rng) for _ in range(12)]
    docs, want = [], set()
    for i in range(120):
        body = noise(rng)
        k = i % 12
        kind = i % 5
        if kind == 0:
            docs.append((i, " ".join(body) + " " + retype(rng, items[k]) + " " + " ".join(noise(rng))))
            want.add((i, k))
        elif kind == 1:
            docs.append((i, " ".join(body) + " " + retype(rng, items[k][15:57]) + " " + " ".join(noise(rng))))
            want.add((i, k))
        elif kind == 2:
            docs.append((i, " ".join(items[k][:35] + body + items[k][35:])))
            want.add((i, k))
        elif kind == 3:
            docs.append((i, " ".join(body + items[k][20:28] + body)))  # a shared phrase is no case
        else:
            docs.append((i, " ".join(body)))
    docs += [docs[0], (None, docs[0][1]), (500, None), (501, ""), (502, "x " * 30_000)]
    path = folder(spark, tmp_path, True, documents=docs, golden_items=[(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, "")])
    got = {tuple(r) for r in p9_found(spark, path).collect()}
    assert got == want


def test_empty(spark, tmp_path):
    assert p9_found(spark, folder(spark, tmp_path, documents=[], golden_items=[(1, "a b c")])).count() == 0
    assert p9_found(spark, folder(spark, tmp_path, documents=[(1, "a b c")], golden_items=[])).count() == 0


def test_items_alike_are_told_apart(spark):
    rng = random.Random(3)
    a = passage(rng)
    b = a[:30] + passage(rng, 40)
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a + b))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "item_id long, passage string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks(docs, items).collect()} == {(1, 1), (2, 2), (3, 1), (3, 2)}


def test_character_forms():
    s = "Ｃａｆé “Ünder” 国x 東京"
    assert words_of(s) == words_of(unicodedata.normalize("NFD", s).upper()) == ["cafe", "under", "国", "x", "東", "京"]


def edited(rng, words, kind, n):
    """The words with n of them changed, left out, or with n new ones put in."""
    out = list(words)
    for p in sorted(rng.sample(range(1, len(out) - 1), n), reverse=True):
        if kind == "changed":
            out[p] = rng.choice(VOCAB)
        elif kind == "put in":
            out.insert(p, rng.choice(VOCAB))
        else:
            del out[p]
    return out


@pytest.mark.parametrize("kind", ["changed", "put in", "left out"])
@pytest.mark.parametrize("n", range(EDITS + 1))
def test_recall_of_edited_windows(kind, n):
    rng = random.Random(9)
    text = passage(rng, 3_000)
    items = Items([0], [" ".join(text)])
    starts = list(range(0, 2_900, 7))
    hit = 0
    for p in starts:
        words = np.append(items.coder.numbers(" ".join(edited(rng, text[p : p + WINDOW], kind, n) + text[p + WINDOW : p + WINDOW + 4])), np.zeros(WINDOW, np.int64))
        _, found = items.meet(words, np.array([0]))
        near = edit_distances(items.window[found], words, np.zeros(len(found), np.int64)) <= EDITS
        hit += p in set(items.place[found[near]].tolist())
    assert hit / len(starts) >= 0.9


@pytest.mark.parametrize("kind", ["changed", "put in", "left out"])
@pytest.mark.parametrize("n", range(EDITS + 1))
def test_recall_of_documents(spark, kind, n):
    # half of an item, with n edits in every twelve words, among other words
    rng = random.Random(4)
    items = [passage(rng) for _ in range(40)]
    docs = []
    for i in range(200):
        half = items[i % 40][17:53]
        text = noise(rng, 30) + [w for p in range(0, 36, 12) for w in edited(rng, half[p : p + 12], kind, n)] + noise(rng, 30)
        docs.append((i, " ".join(text)))
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, passage string"), 0.25)
    pairs = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    want = {(i, i % 40) for i in range(200)}
    assert len(pairs & want) >= 0.9 * len(want) and pairs <= want


def test_edit_distances_equal_the_full_matrix():
    rng = np.random.default_rng(5)
    flat = rng.integers(1, 4, 400)
    at = rng.integers(0, 370, 300)
    a = np.stack([flat[x : x + WINDOW].copy() if k % 3 else rng.integers(1, 4, WINDOW) for k, x in enumerate(at)])
    for row in a:
        row[rng.integers(0, WINDOW)] = 9

    def full(x, y):
        d = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            d, old = [i] + [0] * len(y), d
            for j, e in enumerate(y, 1):
                d[j] = min(old[j] + 1, d[j - 1] + 1, old[j - 1] + (c != e))
        return d

    want = [min(min(full(x, flat[s : s + WINDOW + EDITS])[WINDOW - EDITS :]), EDITS + 1) for x, s in zip(a, at)]
    assert edit_distances(a, flat, at).tolist() == want


def test_equal_and_nested_and_short_items(spark):
    rng = random.Random(8)
    a, b = passage(rng), passage(rng)
    tiny = passage(rng, 5)
    items = [(1, a), (2, a), (3, a[20:45]), (4, b), (5, tiny), (6, ["zz"])]
    docs = [(1, noise(rng) + a + noise(rng)), (2, b + tiny), (3, a[20:45]), (4, ["zz"]), (5, tiny[:1] + noise(rng))]
    frame = lambda rows, schema: spark.createDataFrame([(k, " ".join(w)) for k, w in rows], schema)
    got = leaks(frame(docs, "doc_id long, text string"), frame(items, "item_id long, passage string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 1), (1, 2), (1, 3), (2, 4), (2, 5), (3, 3), (4, 6)}


def test_chunks_code_as_whole_texts():
    items = Items([0], ["Ünder café 国x 東京 data-driven don't x1"])
    for text in ("Ｃａｆé “Ünder” 国x 東京", " data-driven… DON’T\u00a0x1\u200b y", "", "  ", "über/under-data"):
        assert items.coder.numbers(text).tolist() == [items.code.get(w, 0) for w in words_of(text)]


def test_walk_bits_are_fixed():
    assert np.array_equal(Walks(10).bits, Walks(10).bits)
    assert stretches(np.array([1, 2, 3, 4]), np.array([9, 1, 2, 3, 9])) == [(0, 1, 3)]
    assert stretches(np.array([], int), np.array([1])) == []

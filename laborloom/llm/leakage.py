"""Evaluation texts leaking into training text: CGK embedding, bit-sampling LSH over item-sized windows, verification.

The CGK random walk reads a window of words and writes each word once or twice, as a random bit of the step and the
word says; windows within a small edit distance get outputs of small Hamming distance. Repeated samples of the
output's positions are the keys under which windows of items and of documents meet. Windows that meet are verified by
their exact edit distance; of a document and an item with such windows, the shared stretches are aligned and measured.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import scanned, table

#: Words of a window; edits allowed in one; random walks, samples of each walk, positions of each sample. With these, a
#: window of two words changed, put in or left out is met with a probability of 0.93 or more, one of one edit of 0.99.
WINDOW, EDITS, WALKS, SAMPLES, POSITIONS = 12, 2, 8, 3, 4
#: A stretch of so many shared words counts; a document holds an item if such stretches make up this share of it: half
#: of the item, of which a sixth of the words, EDITS of WINDOW, may be changed.
STRETCH, HELD = 3, 0.42
#: Chunks of text whose words are remembered, and their length.
MEMORY, CHUNK = 400_000, 32
#: More items than this would need a sharded index.
MOST_ITEMS = 10_000

_MARKS = re.compile("[­​-‍﻿" + "".join(chr(c) for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))) + "]")
_WORD = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿]|[^\W_぀-ヿ㐀-鿿가-힯฀-๿]+")


def words_of(text: str) -> list[str]:
    """Words in small letters without accents and other marks, in compatibility forms; of scripts without spaces, characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = _MARKS.sub("", text)
    return _WORD.findall(text.casefold())


class Coder:
    """Texts as the numbers of their words, 0 for words that no item has; words of chunks seen before are remembered.

    A text's words are those of its chunks between white space, as no word has any inside.
    """

    def __init__(self, code: dict[str, int]) -> None:
        self.code = code
        self.seen: dict[str, tuple[int, ...]] = {}

    def numbers(self, text: str) -> np.ndarray:
        seen, get = self.seen, self.code.get
        out: list[int] = []
        for chunk in text.split():
            known = seen.get(chunk)
            if known is None:
                known = tuple([get(w, 0) for w in words_of(chunk)])
                if len(chunk) <= CHUNK:
                    if len(seen) >= MEMORY:
                        seen.clear()
                    seen[chunk] = known
            out += known
        return np.array(out, np.int64)


class Walks:
    """The random bits of every walk and the sampled positions, from a fixed seed."""

    def __init__(self, vocabulary: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.steps = 3 * WINDOW
        self.bits = rng.integers(0, 2, (WALKS, self.steps, vocabulary + 2), dtype=np.int8)
        self.at = [[np.sort(rng.choice(2 * WINDOW, POSITIONS, replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)]
        self.salt = rng.integers(1, 2**62, (WALKS, SAMPLES, POSITIONS), dtype=np.int64) | 1

    def keys(self, words: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """For each walk and sample, the key of the window at each start; words beyond the window's end read as one."""
        last = self.bits.shape[2] - 1
        padded = np.append(words, np.zeros(WINDOW, words.dtype))
        for w in range(WALKS):
            i = np.zeros(len(starts), np.int64)
            out = np.empty((2 * WINDOW, len(starts)), np.int64)
            for j in range(2 * WINDOW):
                x = np.where(i < WINDOW, padded[starts + np.minimum(i, WINDOW - 1)], last)
                out[j] = x
                i += self.bits[w, j][x]
            for s in range(SAMPLES):
                h = np.full(len(starts), w * SAMPLES + s, np.int64)
                with np.errstate(over="ignore"):
                    for p, salt in zip(self.at[w][s], self.salt[w, s]):
                        h = (h ^ (out[p] + 1)) * salt
                        h ^= (h >> 31) & 0x1FFFFFFFF
                yield h


class Items:
    """The items' words as numbers, and their windows' keys in sorted arrays."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        self.ids = ids
        words = [words_of(t) for t in texts]
        self.code = {w: k + 1 for k, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.words = [np.array([self.code[w] for w in ws], np.int64) for ws in words]
        self.coder = Coder(self.code)
        self.triples = [triples(ws, len(self.code) + 1) for ws in self.words]
        every = np.concatenate([*self.triples, np.zeros(0, np.int64)])
        of = np.repeat(np.arange(len(ids)), [len(t) for t in self.triples])
        self.bits = np.zeros(1 << 20, bool)
        self.bits[spot(every)] = True
        #: The items' stretches of three words in order, and the item of each.
        order = np.argsort(every, kind="stable")
        self.every, self.of = every[order], of[order]
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.walks = Walks(len(self.code))
        flat, starts, owner, place = [], [], [], []
        at = 0
        for k, ws in enumerate(self.words):
            for p in range(max(len(ws) - WINDOW + 1, 0)):
                starts.append(at + p)
                owner.append(k)
                place.append(p)
            flat.append(np.append(ws, np.zeros(WINDOW, np.int64)))
            at += len(ws) + WINDOW
        self.owner, self.place = np.array(owner, np.int64), np.array(place, np.int64)
        flat = np.concatenate(flat) if flat else np.zeros(WINDOW, np.int64)
        self.window = flat[np.array(starts, np.int64)[:, None] + np.arange(WINDOW)] if starts else np.zeros((0, WINDOW), np.int64)
        #: Items that are shorter than a window, found by their stretches: (stretch or only words, item), sorted.
        short = sorted((int(x), k) for k, ws in enumerate(self.words) if 0 < len(ws) < WINDOW for x in (set(self.triples[k].tolist()) if len(ws) >= STRETCH else [-1 - int(ws[0])]))
        self.short = (np.array([x for x, _ in short], np.int64), np.array([k for _, k in short], np.int64))
        self.tables = []
        for h in self.walks.keys(flat, np.array(starts, np.int64)):
            order = np.argsort(h, kind="stable")
            self.tables.append((h[order], order))

    def meet(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of start, index of item window) of every meeting under any key, each once."""
        found = []
        for (keys, order), h in zip(self.tables, self.walks.keys(words, starts)):
            lo, hi = np.searchsorted(keys, h), np.searchsorted(keys, h, "right")
            n = hi - lo
            hit = n.nonzero()[0]
            if len(hit):
                w = np.repeat(hit, n[hit])
                offset = np.arange(len(w)) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])
                found.append(w * len(self.owner) + order[np.repeat(lo[hit], n[hit]) + offset])
        every = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return every // max(len(self.owner), 1), every % max(len(self.owner), 1)


def triples(words: np.ndarray, base: int) -> np.ndarray:
    """A number for every three words in a row; negative where one is unknown."""
    if len(words) < STRETCH:
        return np.zeros(0, np.int64)
    a, b, c = words[:-2], words[1:-1], words[2:]
    return np.where((a > 0) & (b > 0) & (c > 0), (a * base + b) * base + c, -1)


def spot(numbers: np.ndarray) -> np.ndarray:
    """A place in a table of 2**20 for each number."""
    with np.errstate(over="ignore"):
        return ((numbers * np.int64(-7046029254386353131)) >> 44) & ((1 << 20) - 1)


def edit_distances(a: np.ndarray, flat: np.ndarray, at: np.ndarray, bound: int = EDITS) -> np.ndarray:
    """The edit distance of each row of `a` (n, WINDOW) and the best of the stretches of `flat` that begin at `at`, of
    WINDOW words and up to `bound` more or less; bound + 1 where it is larger. Only the band of the matrix is computed."""
    n, size = a.shape
    wide = 2 * bound + 1
    far = np.int8(bound + 1)
    padded = np.append(flat, np.zeros(size + bound + 1, flat.dtype))
    row = np.full((n, wide), far, np.int8)
    for x in range(bound, wide):
        row[:, x] = x - bound  # no word of a, x - bound words of the text
    for i in range(1, size + 1):
        new = np.full((n, wide), far, np.int8)
        for x in range(wide):
            j = i + x - bound
            if j < 0:
                continue
            best = new[:, x - 1] + 1 if x and j > 0 else np.full(n, far, np.int8)
            if x + 1 < wide:
                best = np.minimum(best, row[:, x + 1] + 1)
            if j > 0:
                best = np.minimum(best, row[:, x] + (a[:, i - 1] != padded[at + j - 1]))
            new[:, x] = np.minimum(best, far)
        row = new
    return row.min(1)


def sharing(three: np.ndarray, owner: np.ndarray, items: Items, held: float) -> np.ndarray:
    """The (document, item) as numbers whose common stretches of three words could make up `held` of the item."""
    n = max(len(items.ids), 1)
    at = np.flatnonzero((three >= 0) & items.bits[spot(three)])
    low, high = np.searchsorted(items.every, three[at], "left"), np.searchsorted(items.every, three[at], "right")
    at, low, high = at[high > low], low[high > low], high[high > low]
    once = np.unique(np.stack([owner[at], low], 1), axis=0, return_index=True)[1] if len(at) else np.zeros(0, np.int64)
    at, low, size = at[once], low[once], (high - low)[once]
    which = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
    pairs, count = np.unique(np.repeat(owner[at], size) * n + items.of[which], return_counts=True)
    return pairs[count * STRETCH >= held * items.length[pairs % n]]


def verified(flat: np.ndarray, at: np.ndarray, window: np.ndarray, pair: np.ndarray, items: Items, chunk: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """The different (document, item), given as numbers `pair`, of the meetings of flat[at:] and an item's window that
    are within EDITS edits of each other.

    Changed words alone are counted first; the edit matrix is for pairs that no meeting has verified by then.
    """
    close = np.zeros(len(at), bool)
    for x in range(0, len(at), chunk):
        close[x : x + chunk] = (items.window[window[x : x + chunk]] != flat[at[x : x + chunk, None] + np.arange(WINDOW)]).sum(1) <= EDITS
    rest = np.flatnonzero(~np.isin(pair, np.unique(pair[close])))
    for x in range(0, len(rest), chunk):
        some = rest[x : x + chunk]
        close[some] = edit_distances(items.window[window[some]], flat, at[some]) <= EDITS
    both = np.unique(pair[close])
    return both // max(len(items.ids), 1), both % max(len(items.ids), 1)


def stretches(item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """(place in the item, place in the document, words) of the stretches of STRETCH words or more that both have, in
    the item's order where two compete. Found greedily, the longest stretch first, on both sides of it in turn."""
    where = defaultdict(list)
    for p, w in enumerate(doc.tolist()):
        if w:
            where[w].append(p)
    found = []
    todo = [(0, len(item), 0, len(doc))]
    it = item.tolist()
    while todo:
        a0, a1, b0, b1 = todo.pop()
        best, bi, bj = 0, 0, 0
        lengths: dict[int, int] = {}
        for i in range(a0, a1):
            new = {}
            for j in where.get(it[i], ()):
                if j < b0:
                    continue
                if j >= b1:
                    break
                n = new[j] = lengths.get(j - 1, 0) + 1
                if n > best:
                    best, bi, bj = n, i - n + 1, j - n + 1
            lengths = new
        if best >= min(STRETCH, len(it)) > 0:
            found.append((bi, bj, best))
            todo.append((a0, bi, b0, bj))
            todo.append((bi + best, a1, bj + best, b1))
    return found


def belongs(span: tuple[int, int, int], size: int, other: list[tuple[int, int, int]]) -> bool:
    """Whether a stretch of an item of `size` words tells of that item, beside another item's stretches.

    It doesn't if the document goes on in the other item's words where this item has others: then it is a phrase that
    both have. A stretch that ends where its item ends tells, so that items within items and equal items are found.
    """
    i, j, n = span
    return not any(y <= j and y + m >= j + n and ((y < j and i > 0) or (y + m > j + n and i + n < size)) for _, y, m in other)


def search(docs: list[str], items: Items, held: float = HELD) -> Iterator[tuple[int, int, float]]:
    """(index of document, index of item, share held) for each document that holds `held` of an item or more.

    Stretches that are parts of longer ones of an item with a larger share count for that item only, as belongs() says.
    """
    coded = [items.coder.numbers(text) if text else np.zeros(0, np.int64) for text in docs]
    gap = np.zeros(WINDOW, np.int64)
    flat = np.concatenate([x for c in coded for x in (c, gap)]) if coded else gap
    size = np.array([len(c) + WINDOW for c in coded], np.int64)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(coded)), size)
    base = len(items.code) + 1
    three = triples(flat, base)
    if not len(three):
        return
    # a window within EDITS of an item's has all but EDITS of its words, and a stretch of STRETCH of them unbroken
    known = np.cumsum(np.append(0, flat > 0))
    whole = np.cumsum(np.append(0, (three >= 0) & items.bits[spot(three)]))
    starts = np.arange(max(len(flat) - WINDOW + 1, 0))
    starts = starts[(known[starts + WINDOW] - known[starts] >= WINDOW - EDITS) & (whole[starts + WINDOW - STRETCH + 1] > whole[starts])]
    s, w = items.meet(flat, starts)
    pair = owner[starts[s]] * max(len(items.ids), 1) + items.owner[w]
    enough = np.isin(pair, sharing(three, owner, items, held))
    d, k = verified(flat, starts[s[enough]], w[enough], pair[enough], items)
    if len(items.short[0]):
        keys, of = items.short
        probes = np.append(three, -1 - flat[flat > 0])
        places = np.append(np.arange(len(three)), np.flatnonzero(flat > 0))
        hit = np.flatnonzero(np.isin(probes, keys) & (probes != -1))
        low, high = np.searchsorted(keys, probes[hit], "left"), np.searchsorted(keys, probes[hit], "right")
        which = np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        d, k = np.append(d, owner[np.repeat(places[hit], high - low)]), np.append(k, of[which])
    both = np.unique(d * max(len(items.ids), 1) + k)
    cases = defaultdict(list)
    have: dict[int, np.ndarray] = {}
    for doc, n in zip((both // max(len(items.ids), 1)).tolist(), (both % max(len(items.ids), 1)).tolist()):
        item = items.words[n]
        if doc not in have:
            have = {doc: np.unique(triples(flat[begin[doc] : begin[doc] + size[doc]], base))}
        # the share of the item in triples that the document has anywhere bounds the share in stretches
        cover = np.zeros(max(len(item), 1), bool)
        mine, theirs = items.triples[n], have[doc]
        hit = np.flatnonzero(theirs[np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)] == mine) if len(theirs) else np.zeros(0, np.int64)
        for j in range(STRETCH):
            cover[hit + j] = True
        if cover.mean() >= held or len(item) < STRETCH:
            cases[doc].append(n)
    for doc, ks in cases.items():
        words = flat[begin[doc] : begin[doc] + size[doc] - WINDOW]
        spans = {n: stretches(items.words[n], words) for n in ks}
        share = {n: sum(m for *_, m in x) / len(items.words[n]) for n, x in spans.items()}
        held_before: list[list[tuple[int, int, int]]] = []
        for n in sorted(ks, key=lambda n: (-share[n], n)):
            if share[n] < held:
                break
            own = sum(x[2] for x in spans[n] if all(belongs(x, len(items.words[n]), o) for o in held_before)) / len(items.words[n])
            if own >= held:
                yield doc, n, own
                held_before.append(spans[n])


def leaks(docs: DataFrame, items: DataFrame, held: float = HELD) -> DataFrame:
    """(doc_id, item_id, share) for every document of `docs` (doc_id, text) and item of `items` (item_id, passage)
    where the document holds `held` of the item or more.

    All items go to every task, so more than MOST_ITEMS raise. Null and empty texts hold nothing and are held by
    none, and documents without an id are left out; repeated rows and extra columns change nothing. Every window of every
    document that can be within EDITS of an item's is looked up. Items shorter than a window are found by exact stretches.
    """
    rows = items.select("item_id", "passage").dropna().distinct().limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items")
    rows = sorted((r["item_id"], r["passage"]) for r in rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Items([r[0] for r in rows], [r[1] for r in rows])
        for pdf in batches:
            ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            for at in range(0, len(ids), 256):
                got = [(ids[at + d], index.ids[k], s) for d, k, s in search(texts[at : at + 256], index, held)]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "share"]).astype({"doc_id": "int64", "item_id": "int64", "share": "float64"})

    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    found = scanned(texts).mapInPandas(run, "doc_id long, item_id long, share double")
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Every document with the items of `golden_items` that it holds."""
    return leaks(table(spark, root, "documents"), table(spark, root, "golden_items")).select("doc_id", "item_id")

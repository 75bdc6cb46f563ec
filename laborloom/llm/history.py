"""Deduplicating new batches against all history: immutable suffix arrays over concatenated texts, merged logarithmically.

Texts are compared within a block: one employer, job and city. Exact copies are found by hash. Of the blocks with
several different texts, each run of arrivals becomes a suffix array: all suffixes of its texts, from each word to the
text's end, in order of block and words. A new text's substrings are searched in every earlier array by bisection; a
match of STRETCH words or more leads to all records in the array's range, and a record is a repeat if enough of its words are in
such matches with the earlier record, from both sides. Arrays are never changed; two of similar size are merged into one.

Of a text's substrings, the commonest are not followed as long as they cover less of it than a repeat must share: a
repeat shares a rarer one too, so no link is lost, and a sentence that all texts of a block have leads to no candidates
by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, table
from .stream import classes

#: Words of a stretch that counts as shared; share of words in such stretches that makes a repeat.
STRETCH, SHARED = 4, 0.6
#: Records of one run of arrivals, texts of a block in one shard, and records of one task.
RUN, SHARD, TASK = 4_096, 2_000, 25_000
#: Matches that are taken from a segment at a time, which bounds memory only.
CHUNK = 2_000_000

# Advertising words that are put after a title, and suffixes that boards append to an id.
_ADVERTS = r"\s*(?:\*+\w*\**|[-–|] ?(?:new|hot|apply (?:today|now)|hiring now|now hiring|urgent(?:ly hiring)?|immediate start))[\s!*]*$"
_SUFFIX = r"(?:[?#].*|:\d+)$"
_SPACELESS = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}])"


def words_of(text: Column) -> Column:
    """The text's words in small letters with single blanks between, without markup; null is empty."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^<>]*>", " ")
    s = F.regexp_replace(s, r"&(?:amp;)?", " and ")
    s = F.replace(F.lower(s), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(s, r"[^\p{L}\p{M}\p{N}]+", " "))


def tokens_of(words: Column | str) -> Column:
    """The words of words_of()'s text as a list; of scripts without spaces, characters."""
    return F.split(F.trim(F.regexp_replace(words, _SPACELESS, " $1 ")), " +")


def stripped(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", ""))


def with_keys(rows: DataFrame) -> DataFrame:
    """(id, block, text, board): 128 bits each of employer, job and city; of the text's words; of source and id.

    `block` is null where the city is missing. Null employers and titles count as empty.
    """
    bits = lambda *cs: F.unhex(F.md5(F.concat_ws("\x01", *cs)))
    title = F.lower(F.coalesce("title", F.lit("")))
    for _ in range(2):
        title = F.regexp_replace(title, _ADVERTS, "")
    city = stripped(F.col("city"))
    return rows.select(
        "id",
        F.when(F.coalesce(city, F.lit("")) != "", bits(words_of(F.col("company")), words_of(title), city)).alias("block"),
        bits(words_of(F.col("description"))).alias("text"),
        F.when(F.col("external_id").isNotNull() & F.col("source").isNotNull(), bits(stripped(F.col("source")), F.regexp_replace(stripped(F.col("external_id")), _SUFFIX, ""))).alias("board"),
    )


class Texts:
    """Records of one task: words as numbers, one after another, with each record's block."""

    def __init__(self, block: np.ndarray, words: np.ndarray, offsets: np.ndarray) -> None:
        # word 0 stands for a text's end
        self.block, self.words, self.offsets = block.astype(np.int64), np.maximum(words.astype(np.uint32), np.uint32(1)), offsets.astype(np.int64)
        self.length = np.diff(self.offsets)
        self.owner = np.repeat(np.arange(len(block)), self.length)
        n = len(self.words)
        self.left = self.offsets[self.owner + 1] - np.arange(n)
        #: Suffixes that lead to candidates: those of STRETCH words or more, or else the whole record.
        self.leads = (self.left >= STRETCH) | ((self.length[self.owner] < STRETCH) & (self.left == self.length[self.owner]))
        padded = np.zeros(n + STRETCH, np.uint64)
        padded[:n] = self.words
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(STRETCH):
                h = (h ^ np.where(self.left > j, padded[j : j + n] + np.uint64(1), np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        #: The suffix at each word, cut after STRETCH words, as a number; which of them count; the records' own ones.
        self.stretch = h
        self.whole = (self.left >= STRETCH) | (self.length[self.owner] < STRETCH)
        self.have = np.unique(mixed(self.owner[self.whole], h[self.whole]))

    def heads(self, at: np.ndarray) -> np.ndarray:
        """The block and the first STRETCH words of the suffixes at `at`, as bytes in rising order, so that comparing
        bytes compares block by block and word by word."""
        padded = np.append(self.words, np.zeros(STRETCH, np.uint32))
        k = np.zeros((len(at), STRETCH + 2), ">u4")
        block = self.block[self.owner[at]]
        k[:, 0], k[:, 1] = (block >> 32) & 0xFFFFFFFF, block & 0xFFFFFFFF
        for j in range(STRETCH):
            k[:, j + 2] = np.where(self.left[at] > j, padded[at + j], 0)
        return np.ascontiguousarray(k).view(f"S{4 * (STRETCH + 2)}").ravel()

    def places(self, first: int, last: int) -> np.ndarray:
        """Where the suffixes of records first to last begin that can match STRETCH words, or else a whole short record."""
        a, b = self.offsets[first], self.offsets[last]
        return a + np.flatnonzero(self.leads[a:b])

    def rarest(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Which of the suffixes at `at`, all those of some records in order, are followed: all but the commonest by `count`.

        Those left out of a record cover less than SHARED of its words together. So a record that shares SHARED of
        them has one of the others: were all that it shares left out, it would share too little.
        """
        if not len(at):
            return np.zeros(0, bool)
        first, last = self.owner[at[0]], self.owner[at[-1]] + 1
        a, b = self.offsets[first], self.offsets[last]
        value = np.full(b - a, -1, np.int64)
        value[at - a] = count
        owner = self.owner[a:b]
        # a word is covered as soon as the commonest suffix over it is left out
        over = value.copy()
        for j in range(1, STRETCH):
            over[j:] = np.maximum(over[j:], np.where(owner[j:] == owner[:-j], value[:-j], -1))
        top = int(over.max()) + 2
        over = np.sort((owner - first) * top + (top - 2 - over)) - (owner - first) * top
        size = self.length[first:last]
        need = np.maximum(np.ceil(SHARED * size - 1e-6).astype(np.int64), 1)
        most = np.full(last - first, top, np.int64)
        some = size >= STRETCH
        most[some] = top - 2 - over[(self.offsets[first:last] - a + need - 1)[some]]
        return count <= most[self.owner[at] - first]


def mixed(number: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers."""
    with np.errstate(over="ignore"):
        y = (x ^ (number.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x165667B19E3779F9)
    return y


def suffix_order(t: Texts, at: np.ndarray) -> np.ndarray:
    """The suffixes at `at`, of whole records in order, sorted by block and words to the record's end, equal ones by
    record. By prefix doubling: ranks by two, four, eight ... words until they settle."""
    if not len(at):
        return at
    a, b = int(t.offsets[t.owner[at[0]]]), int(t.offsets[t.owner[at[-1]] + 1])
    n = b - a
    block = np.unique(t.block[t.owner[a:b]].view(np.uint64), return_inverse=True)[1].astype(np.int64)
    rank = np.unique(block * 2**32 + t.words[a:b].astype(np.int64), return_inverse=True)[1].astype(np.int64)
    left = t.left[a:b]
    known = 1
    while known < int(left.max()) and rank.max() < n - 1:
        nxt = np.zeros(n, np.int64)
        nxt[: n - known] = np.where(left[: n - known] > known, rank[known:] + 1, 0)
        new = np.unique(rank * (n + 1) + nxt, return_inverse=True)[1].astype(np.int64)
        if new.max() == rank.max() and known > 1:  # no rank was divided, so none will be
            break
        rank, known = new, known * 2
    return at[np.lexsort((at, rank[at - a]))]


class Segment:
    """An immutable suffix array over the texts of records first to last of `t`."""

    def __init__(self, t: Texts, first: int, last: int, order: np.ndarray | None = None) -> None:
        self.t, self.first, self.last = t, first, last
        self.order = suffix_order(t, t.places(first, last)) if order is None else order
        self.head = t.heads(self.order)

    def range(self, q: Texts, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the suffixes begin and end that have the same block and STRETCH first words as those of `q` at `at`, by bisection."""
        keys = q.heads(at)
        return np.searchsorted(self.head, keys, "left"), np.searchsorted(self.head, keys, "right")

    def longest(self, q: Texts, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, record) of the longest match of the text of `q` from each of `at` on; 0 and -1 where there is none of STRETCH
        words. The range is narrowed word by word, each time by bisection; of several records the first counts."""
        lo, hi = self.range(q, at)
        size = np.where(hi > lo, np.minimum(STRETCH, q.left[at]), 0)
        todo = np.flatnonzero((hi > lo) & (q.left[at] > STRETCH))
        depth = STRETCH
        padded = np.append(self.t.words, np.zeros(1, np.uint32))

        def bisect(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, right: bool) -> np.ndarray:
            lo, hi = lo.copy(), hi.copy()
            while (lo < hi).any():
                mid = np.minimum((lo + hi) // 2, len(self.order) - 1)
                p = self.order[mid]
                x = np.where(self.t.left[p] > depth, padded[np.minimum(p + depth, len(padded) - 1)], 0)
                up = (lo < hi) & ((x <= w) if right else (x < w))
                hi = np.where((lo < hi) & ~up, mid, hi)
                lo = np.where(up, mid + 1, lo)
            return lo

        while len(todo):
            w = q.words[at[todo] + depth]
            a, b = bisect(lo[todo], hi[todo], w, False), bisect(lo[todo], hi[todo], w, True)
            on = b > a
            todo = todo[on]
            lo[todo], hi[todo] = a[on], b[on]
            depth += 1
            size[todo] = depth
            todo = todo[q.left[at[todo]] > depth]
        record = np.full(len(at), -1)
        for i in np.flatnonzero(size):
            record[i] = self.t.owner[self.order[lo[i] : hi[i]]].min()
        return size, record

    def matches(self, q: Texts, at: np.ndarray, chunk: int = CHUNK) -> Iterator[np.ndarray]:
        """Different (record of `q`, earlier record here that shares STRETCH words) pairs as rows, from about `chunk`
        matches at a time; `at` are all suffixes of some records of `q`. Suffixes that rarest() leaves out are not followed."""
        low, high = self.range(q, at)
        keep = q.rarest(at, high - low) & (high > low)
        at, low, high = at[keep], low[keep], high[keep]
        ends = np.cumsum(high - low)
        i = 0
        while i < len(at):
            before = ends[i - 1] if i else 0
            to = max(i + 1, int(np.searchsorted(ends, before + chunk, "right")))
            size = high[i:to] - low[i:to]
            which = np.arange(size.sum()) - np.repeat(ends[i:to] - size - before, size) + np.repeat(low[i:to], size)
            a, b = np.repeat(q.owner[at[i:to]], size), self.t.owner[self.order[which]]
            ok = b < a
            if ok.any():
                width = int(a.max()) + 1
                code = np.unique(a[ok].astype(np.int64) * width + b[ok])
                yield np.stack([code // width, code % width], 1)
            i = to

    def merged(self, later: Segment) -> Segment:
        """One array over the records of both, which follow each other."""
        return Segment(self.t, self.first, later.last)


class Levels:
    """The segments so far, the oldest and largest first."""

    def __init__(self) -> None:
        self.segments: list[Segment] = []

    def add(self, s: Segment) -> None:
        self.segments.append(s)
        while len(self.segments) > 1 and len(self.segments[-2].order) <= 2 * len(self.segments[-1].order):
            b = self.segments.pop()
            self.segments[-1] = self.segments[-1].merged(b)


def shared(t: Texts, pairs: np.ndarray) -> np.ndarray:
    """For each (a, b), the share of a's words in stretches of STRETCH words that b has too, of the longer's words."""
    out = np.zeros(len(pairs))
    for at in range(0, len(pairs), 20_000):
        a, b = pairs[at : at + 20_000].T
        size = t.length[a]
        ends = np.cumsum(size)
        if not ends[-1]:
            continue
        pos = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(t.offsets[a], size)
        probe = mixed(np.repeat(b, size), t.stretch[pos])
        i = np.minimum(np.searchsorted(t.have, probe), len(t.have) - 1)
        hit = (t.have[i] == probe) & t.whole[pos]
        cover = hit.copy()
        for j in range(1, STRETCH):
            cover[j:] |= hit[:-j] & (t.owner[pos[:-j]] == t.owner[pos[j:]]) & (pos[j:] - pos[:-j] == j)
        total = np.add.reduceat(cover, np.minimum(ends - size, len(cover) - 1), dtype=np.int64) * (size > 0)
        out[at : at + 20_000] = total / np.maximum(np.maximum(size, t.length[b]), 1)
    return out


def replay(t: Texts, run: int = RUN) -> np.ndarray:
    """The first record of each record's posting, for records in order of arrival."""
    n = len(t.block)
    root = np.arange(n)
    levels = Levels()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def link(pairs: np.ndarray) -> None:
        a, b = t.length[pairs].T
        pairs = pairs[np.minimum(a, b) >= SHARED * np.maximum(a, b) - 1e-6]
        for at in range(0, len(pairs), 20_000):
            some = pairs[at : at + 20_000]
            top = root
            while (top[top] != top).any():
                top = top[top]
            some = some[top[some[:, 0]] != top[some[:, 1]]]  # pairs of one posting tell nothing new
            some = some[shared(t, some) >= SHARED]
            for x, y in some[shared(t, some[:, ::-1]) >= SHARED]:
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)

    for first in range(0, n, run):
        last = min(n, first + run)
        own, at = Segment(t, first, last), t.places(first, last)
        for s in [*levels.segments, own]:
            for pairs in s.matches(t, at):
                link(pairs)
        levels.add(own)
    return np.array([find(i) for i in range(n)])


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, root) of the records that are not first, of a task's records sorted by gid."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    whole = pa.Table.from_batches(got).combine_chunks()
    block, gid = whole["block"].to_numpy(), whole["gid"].to_numpy()
    lists = whole["words"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy()
    words = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    root = replay(Texts(block, words.astype(np.int64) & 0xFFFFFFFF, offsets - offsets[0]))
    dup = root != np.arange(len(root))
    yield pa.RecordBatch.from_arrays([pa.array(gid[dup]), pa.array(gid[root[dup]])], ["gid", "root"])


def routes(hot: DataFrame) -> DataFrame:
    """(block, gid, lead): the suffixes of each text (block, gid, t) by which it meets its repeats.

    As in Texts.rarest(), a text's commonest suffixes in the block are left out that together cover less than SHARED of
    it; so two texts that share enough have a suffix in common here. Those that one text alone has are left out, too.
    """
    size = F.size("t")
    grams = F.transform(F.sequence(F.lit(0), F.greatest(size - STRETCH, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice("t", i + 1, STRETCH), " ")))
    each = materialize(hot.select("block", "gid", size.alias("size"), F.posexplode(grams).alias("at", "gram")), "grams")
    counts = each.groupBy("block", "gram").agg(F.count(F.lit(1)).alias("many"))
    texts = each.join(counts, ["block", "gram"]).groupBy("block", "gid", "size").agg(F.array_sort(F.collect_list(F.struct("at", "many", "gram"))).alias("g"))
    ranks = texts.select("block", "gid", "size", F.transform("g", lambda x: F.struct(x["many"], x["gram"])).alias("r"))
    # the commonest suffix over each word; a word is covered as soon as that one is left out
    over = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.array_max(F.slice("r", F.greatest(i - (STRETCH - 1), F.lit(0)) + 1, F.least(i + 1, F.lit(STRETCH)))))
    need = F.greatest(F.ceil(F.lit(SHARED) * F.col("size") - 1e-6).cast("int"), F.lit(1))
    last = F.when(F.col("size") >= STRETCH, F.get(F.sort_array(over, False), need - 1)).otherwise(F.array_max("r"))
    kept = ranks.withColumn("last", last).select("block", "gid", F.explode(F.filter("r", lambda x: x <= F.col("last"))).alias("x")).select("block", "gid", F.col("x.gram").alias("lead")).distinct()
    kept = materialize(kept, "leads")
    return kept.join(kept.groupBy("block", "lead").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), ["block", "lead"], "left_semi")


def near_copies(texts: DataFrame, shard: int = SHARD, task: int = TASK) -> DataFrame:
    """(gid, root) for each text that repeats an earlier one of its block; root is the posting's first text.

    `texts` has (block, n, gid, words): the block's number, how many texts it has, the id by which texts arrived,
    and the words as one string. A block of more than `shard` texts is divided by routes(): two texts that share
    enough meet at a suffix of both, and what is compared there are the whole texts, so that links don't depend on
    a block's size.
    """
    spark = texts.sparkSession
    tokens = tokens_of("words")
    hot = texts.filter(F.col("n") > shard).withColumn("t", tokens)
    rows = texts.filter(F.col("n") <= shard).select("block", "gid", "words")
    some_hot = not hot.isEmpty()
    if some_hot:
        rows = rows.union(hot.join(routes(hot), ["block", "gid"]).select(F.xxhash64("block", "lead").alias("block"), "gid", "words"))
        rows = materialize(rows, "routed")
    n = max(3 * spark.sparkContext.defaultParallelism, -(-rows.count() // task))
    spread = rows.repartition(n, "block").sortWithinPartitions("gid").select("block", "gid", F.transform(tokens, lambda w: F.hash(w)).alias("words"))
    found = spread.mapInArrow(_roots, "gid long, root long")
    if not some_hot:
        return found
    links = classes(materialize(found, "links").select(F.col("gid").alias("a"), F.col("root").alias("b")))
    return links.filter("node <> root").select(F.col("node").alias("gid"), "root")


def first_rows(rows: DataFrame) -> DataFrame:
    """(id, first_id) for every row of `rows` (id, source, external_id, title, company, city, description).

    The first row of a posting has its own id. Rows without a city belong to the posting of their source and
    external id, or, with one of these null, to none but their own. Nulls elsewhere count as empty, repeated ids as
    one row; rows without an id are left out.
    """
    rows = rows.filter(F.col("id").isNotNull())
    keyed = materialize(with_keys(rows), "keys")
    placed = keyed.filter("block IS NOT NULL")
    copies = placed.groupBy("block", "text").agg(F.min("id").alias("gid"))
    copies = materialize(copies, "copies")
    several = copies.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    wanted = copies.join(several, "block").select(F.col("gid").alias("id"), F.xxhash64("block").alias("block"), "n")
    texts = rows.select("id", "description").join(wanted, "id").dropDuplicates(["id"]).select("block", "n", F.col("id").alias("gid"), words_of(F.col("description")).alias("words"))
    near = materialize(near_copies(materialize(texts, "texts")), "near")
    # every copy's first text, then the rows without a city by their board's id
    groups = copies.join(near, "gid", "left").select("block", "text", F.coalesce("root", "gid").alias("first_id"))
    found = placed.join(groups, ["block", "text"]).select("id", "board", "first_id")
    lost = keyed.filter("block IS NULL").select("id", "board")
    boards = lost.filter("board IS NOT NULL").groupBy("board").agg(F.min("id").alias("lost"))
    touched = found.join(boards, "board").groupBy("board").agg(F.min("first_id").alias("of"), F.min("lost").alias("lost"))
    earlier = touched.filter(F.col("lost") < F.col("of")).groupBy(F.col("of").alias("first_id")).agg(F.min("lost").alias("lost"))
    placed_out = found.join(earlier, "first_id", "left").select("id", F.coalesce("lost", "first_id").alias("first_id"))
    of = boards.join(touched.select("board", "of"), "board", "left").select("board", F.least("lost", "of").alias("first_id"))
    return placed_out.union(lost.join(of, "board", "left").select("id", F.coalesce("first_id", "id").alias("first_id")))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Each row of `raw_ingested_jobs` that repeats an earlier posting, with the posting's first row."""
    raw = table(spark, root, "raw_ingested_jobs").select("id", "source", "external_id", "title", "company", "city", "description")
    return first_rows(raw).filter(F.col("first_id") < F.col("id")).select("first_id", F.col("id").alias("dup_id"))

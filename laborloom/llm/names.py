"""Variant spellings of names: a trie join over sharded tries, with Levenshtein automata, then orders of words.

Every order of a family name's words is an entry of the tries, and the order written is looked up, so that a match within the
bound is the check of permutations.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, spread, table
from .automata import Trie
from .stream import groups

# Legal forms and words that name no employer.
LEGAL = frozenset("llc inc incorporated corp corporation co company ltd limited lp llp plc gmbh ag sa group grp the and of hiring regional reg".split())
#: Words of trades; the rule in trade_word() knows their short forms.
TRADE = (
    "agency associates auto body brothers care center child construction consulting credit dental department development distribution district electric engineering farms food freight "
    "furnishings health heating home hotels insurance international laboratories lines management manufacturing markets medical network packaging plumbing property resorts school security "
    "services solutions staffing steel stores supply systems technologies transportation union university works"
).split()
#: Short forms that the rule can't know.
TRADE_FORMS = {"internatl": "international", "cr": "credit", "dept": "department", "labs": "laboratories", "bros": "brothers", "centre": "center", "cu": "credit union", "intl": "international", "mgmt": "management", "elec": "electric", "mfg": "manufacturing"}
# Given names and what people are called for short.
GIVEN = {
    "alexandra": "alex lexi sandra sandy lexie", "charles": "charlie chuck chas chaz", "edward": "ed eddie ned", "elizabeth": "liz beth eliz betty lizzie libby",
    "francisco": "pancho paco fco frank", "guadalupe": "lupe gpe lupita", "jesus": "chuy chucho", "jose": "pepe", "josephine": "jo josie", "katherine": "kathy kate katie kath",
    "margaret": "maggie peg peggy meg marge", "richard": "rick dick rich richie ricky", "robert": "bob rob bobby robbie", "theodore": "ted theo teddy", "william": "will bill billy wm willie",
}
_NICK = {n: full for full, ns in GIVEN.items() for n in [full, *ns.split()]}


def plain(name: str) -> str:
    s = unicodedata.normalize("NFKD", name.casefold())
    return re.sub(r"['’`]", "", "".join(ch for ch in s if not unicodedata.combining(ch)))


@lru_cache(1)
def _trade_trie() -> Trie:
    return Trie((w, w) for w in TRADE)


@lru_cache(100_000)
def trade_word(token: str) -> str | None:
    """The trade's words that a token stands for, or None.

    A token stands for a word if it is the word, two of them together, a short form listed above, the word's first
    three letters or more, its first letter with later consonants in order and no vowel, or, from six letters on,
    within one edit of it, from nine within two. The shortest fitting word wins, then the first in the alphabet.
    """
    if token in TRADE:
        return token
    if token in TRADE_FORMS:
        return TRADE_FORMS[token]
    for w in TRADE:
        if token.startswith(w) and token[len(w) :] in TRADE:
            return f"{w} {token[len(w) :]}"
    near = sorted((d, w) for w, d in _trade_trie().within(token, 0 if len(token) < 6 else 1 if len(token) < 9 else 2))
    if near:
        return near[0][1]
    fits = []
    for w in TRADE:
        stem = token.rstrip("s") if not token.endswith("ss") else token
        if len(stem) >= 3 and w.startswith(stem) and len(stem) < len(w):
            fits.append((0, len(w), w))
        elif len(token) >= 3 and token[0] == w[0] and len(token) < len(w):
            it = iter(w)
            if all(ch in it for ch in token) and (not re.search(r"[aeiou]", token[1:]) or (len(token) >= 5 and len(token) + 3 >= len(w))):
                fits.append((1, len(w), w))
    return min(fits)[2] if fits else None


def read_name(name: str, places: frozenset[str]) -> dict:
    """The parts of an employer's name: given name or initial, family, trade, and initials.

    `places` are folded names of places, which are left out at a name's end. Legal forms, numbers of branches and
    remarks in brackets are left out too. Words may come in any order; a family name in two pieces is put together.
    """
    text = plain(name)
    notes = re.findall(r"\(([a-z]{2,8})\)", text)
    text = re.sub(r"\([^()]*\)|#\s*\d+", " ", text)
    text = re.sub(r"\b([a-z])\.(?=[a-z]\b)", r"\1", text).replace(".", " ")
    joined = lambda m: m[0].replace("-", "") if trade_word(m[0].split("-")[0]) is None else m[0].replace("-", " ")
    text = re.sub(r"[^\W\d_]+(?:-[^\W\d_]+)+", joined, text)
    words = re.findall(r"[^\W_]+", text)
    for k in (3, 2, 1):
        if len(words) > k + 1 and " ".join(words[-k:]) in places:
            words = words[:-k]
            break
    given, initial, family, trade = None, None, [], []
    kept = [w for w in words if w not in LEGAL or w in ("regional", "reg")]
    for w in kept:
        if w in ("regional", "reg"):
            continue
        if len(w) == 1:
            initial = initial or w
        elif w in _NICK and given is None and len(kept) > 1:
            given = _NICK[w]
        elif (t := trade_word(w)) is not None:
            trade.append(t)
        else:
            family.append(w)
    kinds = set(" ".join(trade).split())
    if "school" in kinds and "distribution" in kinds and "district" not in kinds:
        kinds = kinds - {"distribution"} | {"district"}
    if len(kinds) > 1:
        kinds = kinds - {"services"}  # Consulting Services is Consulting
    letters = "".join(w[0] for w in kept) if len(kept) > 2 else ""
    if not family and given and not kinds:
        family, given = [given], None
    return {"given": given or initial or "", "family": "".join(family), "forms": orders(family), "trade": " ".join(sorted(kinds)), "initials": letters, "note": notes[0] if notes else ""}


PARTS = "value string, given string, family string, trade string, initials string, note string, forms array<string>"


def parse_names(values: DataFrame, places: frozenset[str]) -> DataFrame:
    """PARTS of each distinct value in the column `value`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [read_name(v, places) for v in pdf["value"]]
            yield pd.DataFrame([[v, *(r[k] for k in ("given", "family", "trade", "initials", "note", "forms"))] for v, r in zip(pdf["value"], rows)], columns=[c.split()[0] for c in PARTS.split(", ")])

    return spread(values.select("value").filter(F.col("value").isNotNull()).distinct(), "value", per_core=1).mapInPandas(run, PARTS)


def bound(word: str) -> int:
    """Edits allowed between two family names: none below five letters, one below ten, else two."""
    return 0 if len(word) < 5 else 1 if len(word) < 10 else 2


def cuts_of(n: int, d: int) -> list[tuple[int, int]]:
    """The d + 1 pieces of n letters, of which one survives d edits."""
    at = [n * i // (d + 1) for i in range(d + 2)]
    return list(zip(at, at[1:]))


def as_entry(word: str) -> Iterator[str]:
    """The shards that a word is in: one for each of its pieces, for each bound that a query for it may have."""
    n = len(word)
    for d in sorted({bound("x" * m) for m in range(max(n - 2, 0), n + 3)}):
        for i, (a, b) in enumerate(cuts_of(n, d)):
            yield f"{n}/{d}/{i}/{word[a:b]}"


def as_query(word: str) -> Iterator[str]:
    """The shards in which an entry within bound(word) edits is, for each length that it may have.

    A piece that no edit touches stands in the word at most as many places to the side as there are edits before it, seen from
    either end. Two letters swapped across a cut touch both pieces, so the word is also cut with that swap undone.
    """
    d, size = bound(word), len(word)
    for n in range(max(size - d, 1), size + d + 1):
        pieces = cuts_of(n, d)
        for i, (a, b) in enumerate(pieces):
            for shift in range(-d, d + 1):
                left, right = abs(shift), abs(shift - (size - n))
                if left > i or right > d - i or not 0 <= a + shift <= b + shift <= size:
                    continue
                for swap_left in (False, True) if d else (False,):
                    for swap_right in (False, True) if d else (False,):
                        w, x, y = list(word), a + shift, b + shift
                        if swap_left and not (0 < x < size) or swap_right and not (0 < y < size) or swap_left + swap_right > d:
                            continue
                        if swap_left:
                            w[x - 1], w[x] = w[x], w[x - 1]
                        if swap_right:
                            w[y - 1], w[y] = w[y], w[y - 1]
                        yield f"{n}/{d}/{i}/{''.join(w[x:y])}"


def orders(words: list[str]) -> list[str]:
    """The words put together in every order, the written one first; of more than four, in every rotation, forwards and back."""
    if len(words) <= 4:
        return list(dict.fromkeys("".join(p) for p in permutations(words)))
    turns = [words[i:] + words[:i] for i in range(len(words))]
    return list(dict.fromkeys("".join(p) for p in [*turns, *(t[::-1] for t in turns), sorted(words)]))


def trie_join(words: DataFrame) -> DataFrame:
    """(block, a, b, distance) for all different a, b of one block within bound() edits, a < b.

    `words` has distinct (block, word), and may say by `entry` and `query` which words are looked up in which; a pair is
    found from the side that queries. The shards of a block, by pieces of words, are spread over the cluster, so that a block
    with a third of all words is many small tries. In each the queries walk the trie with a Levenshtein automaton.
    """
    if "query" not in words.columns:
        words = words.withColumn("entry", F.lit(True)).withColumn("query", F.lit(True))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for b, w, e, q in zip(pdf["block"], pdf["word"], pdf["entry"], pdf["query"]):
                mine = dict.fromkeys(as_entry(w) if e else (), (True, False))
                for k in as_query(w) if q else ():
                    mine[k] = (k in mine and mine[k][0], True)
                rows += [(f"{b}|{k}", b, w, x, y) for k, (x, y) in mine.items()]
            yield pd.DataFrame(rows, columns=["shard", "block", "word", "entry", "query"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, g in groups(batches, "shard"):
            entries, queries = g["word"][g["entry"]], g["word"][g["query"]]
            if not len(entries) or not len(queries) or (len(g) == 1):
                continue
            trie = Trie(zip(entries, entries))
            rows = [(g["block"].iloc[0], min(q, w), max(q, w), d) for q in queries for w, d in trie.within(q, bound(q)) if w != q]
            if rows:
                yield pd.DataFrame(rows, columns=["block", "a", "b", "distance"])

    sharded = words.select("block", "word", "entry", "query").mapInPandas(emit, "shard string, block string, word string, entry boolean, query boolean")
    found = spread(sharded, "shard", per_core=1).sortWithinPartitions("shard").mapInPandas(search, "block string, a string, b string, distance int")
    return found.groupBy("block", "a", "b").agg(F.min("distance").alias("distance"))


def near_nodes(nodes: DataFrame) -> DataFrame:
    """(a, b, distance) for the nodes (block, node, forms) of one block of which the written form of one is within bound()
    edits of some order of the other's words. `forms` has the written form first."""
    each = nodes.select("block", "node", F.posexplode("forms").alias("at", "word"))
    each = materialize(each.withColumn("query", F.col("at") == 0).drop("at"), "forms")
    words = each.groupBy("block", "word").agg(F.lit(True).alias("entry"), F.max("query").alias("query"))
    found = trie_join(words)
    side = each.select("block", "word", F.col("node"), F.col("query").alias("written"))
    x, y = (side.select("block", F.col("word").alias(w), F.col("node").alias(f"n{w}"), F.col("written").alias(f"w{w}")) for w in "ab")
    pairs = found.join(x, ["block", "a"]).join(y, ["block", "b"]).filter("(wa OR wb) AND na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "distance")
    # the same words in another order: all nodes of a form with the least one of them
    first = each.groupBy("block", "word").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    same = each.join(first, ["block", "word"]).filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"), F.lit(0).alias("distance"))
    return pairs.union(same).groupBy("a", "b").agg(F.min("distance").alias("distance"))


def led(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) for nodes (node, weight): each node follows the neighbour with the most support, if that has more than itself.

    Support is the weight of a node and its neighbours. A node whose leader follows another one follows the best of its
    neighbours that lead, else it stands alone, so that all of a class are near its root and a chain of single edits never
    joins names that are far apart. Ties go to the larger weight, then by hash.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    around = both.join(nodes.select(F.col("node").alias("b"), "weight"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("around"))
    support = F.col("weight") + F.coalesce("around", F.lit(0))
    ranks = materialize(nodes.join(around, "node", "left").select("node", F.struct(support.alias("s"), F.col("weight").alias("w"), F.hash("node").alias("h"), F.col("node").alias("node")).alias("own")), "ranks")
    rank = ranks.select(F.col("node").alias("b"), F.col("own").alias("rank"))
    best = both.join(rank, "b").groupBy(F.col("a").alias("node")).agg(F.max("rank").alias("best"))
    up = ranks.join(best, "node", "left").select("node", F.when(F.col("best") > F.col("own"), F.col("best.node")).alias("up"))
    up = materialize(up, "leaders")
    # the best neighbour that follows none
    heads = both.join(up.filter("up IS NULL").select(F.col("node").alias("b")), "b").join(rank, "b").groupBy(F.col("a").alias("node")).agg(F.max("rank").alias("head"))
    return up.join(heads, "node", "left").select("node", F.when(F.col("up").isNull(), F.col("node")).otherwise(F.coalesce("head.node", "node")).alias("root"))


def link_names(values: DataFrame, places: frozenset[str] = frozenset()) -> DataFrame:
    """(value, employer) for each distinct value in column `value`: values of one employer share a number.

    Same employer: the same trade and a family name within bound() edits in any order of its words, whatever the order of
    the rest, legal form or branch. Names that share these but have different given names are different employers; one
    with an initial then belongs to the one given name that it may stand for, and one without a given name to none. A
    spelling belongs to the one near it that has the most support, so that chains of edits don't join names that are far apart.
    A value without a trade belongs to the one employer whose family name is nearest, if there is only one;
    one that is another's initials belongs to that one, if there is only one. Nulls are left out; values of which
    nothing is left, such as "LLC", are linked with the values of the same letters only.
    """
    parts = parse_names(values, places)
    lone = F.when(F.col("family") == "", F.concat(F.lit("="), F.lower("value"))).otherwise(F.col("family"))
    forms = F.when(F.col("family") == "", F.array(lone)).otherwise(F.col("forms"))
    parts = parts.withColumn("forms", forms).withColumn("family", lone).withColumn("node", F.concat_ws("|", "trade", "family"))
    parts = materialize(parts, "names")
    nodes = parts.groupBy("trade", "family", "node").agg(F.count(F.lit(1)).alias("weight"), F.flatten(F.collect_set("forms")).alias("forms"))
    # the written form stays the first
    nodes = nodes.withColumn("forms", F.array_distinct(F.concat(F.array("family"), "forms")))
    nodes = materialize(nodes, "nodes")
    edges = materialize(near_nodes(nodes.select(F.col("trade").alias("block"), "node", "forms")), "edges")
    roots = led(nodes.select("node", "weight"), edges)
    nodes = materialize(nodes.join(roots, "node").select("trade", "family", "node", "root"), "employers")
    # values without a trade, and initials
    bare = nodes.filter("trade = ''").select(F.col("root").alias("bare"), "family")
    full = nodes.filter("trade <> ''").select("root", F.col("family").alias("other"))
    lone_families, families = bare.select("family").distinct(), full.select(F.col("other").alias("family")).distinct()
    sides_of = families.withColumn("entry", F.lit(True)).withColumn("query", F.lit(False)).union(lone_families.withColumn("entry", F.lit(False)).withColumn("query", F.lit(True)))
    sides_of = sides_of.groupBy("family").agg(F.max("entry").alias("entry"), F.max("query").alias("query"))
    every = materialize(trie_join(sides_of.select(F.lit("").alias("block"), F.col("family").alias("word"), "entry", "query")), "families")
    sides = every.select("a", "b", "distance").union(every.select("b", "a", "distance")).union(lone_families.select(F.col("family").alias("a"), F.col("family").alias("b"), F.lit(0).alias("distance")))
    votes = bare.join(sides, bare["family"] == sides["a"]).join(full, F.col("b") == full["other"]).groupBy("bare", "root").agg(F.min("distance").alias("d"))
    short = parts.filter("trade = '' AND length(family) BETWEEN 2 AND 6").select(F.col("family").alias("key"), "node").distinct().join(nodes.select("node", F.col("root").alias("bare")), "node")
    letters = parts.filter("trade <> ''").select(F.explode(F.array("initials", "note")).alias("key"), "node").filter("length(key) >= 3").distinct()
    letters = letters.join(nodes.select("node", "root"), "node").select("key", "root").distinct()
    votes = votes.union(short.join(letters, "key").select("bare", "root", F.lit(0).alias("d")))
    votes = materialize(votes, "votes")
    best = votes.groupBy("bare").agg(F.min("d").alias("d"))
    sole = votes.join(best, ["bare", "d"]).select("bare", "root").distinct().groupBy("bare").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("to")).filter("n = 1").select(F.col("bare").alias("root"), "to")
    owner = nodes.join(sole, "root", "left").select("node", F.coalesce("to", "root").alias("employer"))
    linked = materialize(parts.join(owner, "node").select("value", "employer", "given"), "linked")
    # given names tell employers apart where one family and trade has several
    named = linked.filter("length(given) > 1").groupBy("employer").agg(F.collect_set("given").alias("all")).filter("size(all) > 1")
    fits = F.filter("all", lambda g: (g == F.col("given")) | ((F.length("given") == 1) & g.startswith(F.col("given"))))
    own = F.when((F.col("given") != "") & (F.size(fits) == 1), F.concat_ws("|", "employer", F.get(fits, F.lit(0))))
    return linked.join(named, "employer", "left").select("value", F.coalesce(F.when(F.col("all").isNotNull(), own), F.col("employer")).alias("employer"))


def places_of(rows: DataFrame, column: str, most: int = 100_000) -> frozenset[str]:
    """Folded names of places in a column; more than `most` raise, as each task gets them all."""
    found = rows.select(column).dropna().distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError("too many places")
    return frozenset(" ".join(re.findall(r"[^\W_]+", plain(r[0]))) for r in found)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """All pairs of different stored spellings of one employer in `job_records`."""
    jr = table(spark, root, "job_records")
    linked = link_names(jr.select(F.col("company").alias("value")), places_of(jr, "city"))
    a, b = linked.select("employer", F.col("value").alias("company_a")), linked.select("employer", F.col("value").alias("company_b"))
    return a.join(b, "employer").filter(F.col("company_a") < F.col("company_b")).select("company_a", "company_b")

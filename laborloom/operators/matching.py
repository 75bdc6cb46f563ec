"""Lookups against small catalogs: exact, cascading, by substring and by likeness."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import spread

#: A catalog of more entries is no small one, and is not sent to every task.
SMALL = 100_000
# The score from which two names match, the weights of its halves, and the confidences of the steps.
FUZZY_MATCH, TOKEN_WEIGHT, PART_WEIGHT = 85.0, 0.6, 0.4
EXACT_CONFIDENCE, PLACEHOLDER_CONFIDENCE = 0.95, 0.40
LOCATION_CONFIDENCE = (0.90, 0.82)


def _ratio(a: str, b: str) -> float:
    return 100.0 * difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0


def token_sort_ratio(a: str, b: str) -> float:
    """Likeness from 0 to 100 of both texts with their words sorted."""
    return _ratio(" ".join(sorted(a.lower().split())), " ".join(sorted(b.lower().split())))


def partial_ratio(a: str, b: str) -> float:
    """The best likeness of the shorter text and a stretch of the longer one of its length."""
    s, t = sorted((a.lower(), b.lower()), key=len)
    if not s:
        return 0.0
    starts = {max(0, m.b - m.a) for m in difflib.SequenceMatcher(None, s, t, autojunk=False).get_matching_blocks()}
    return max(_ratio(s, t[i : i + len(s)]) for i in starts)


def fuzzy_best(names: DataFrame, name: str, catalog: list[tuple[str, str]], least: float = FUZZY_MATCH) -> DataFrame:
    """(name, match_id, score): for each distinct name the catalog's best entry, null below `least`.

    `catalog` is (id, name), at most SMALL; ties go to the smaller id. Names are the scarce side: score them once each.
    """
    if len(catalog) > SMALL:
        raise ValueError("the catalog is too large to go to every task")
    entries = sorted(catalog)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for n in pdf[name]:
                best = max(((TOKEN_WEIGHT * token_sort_ratio(n, c) + PART_WEIGHT * partial_ratio(n, c), i) for i, (_, c) in enumerate(entries)), key=lambda x: (x[0], -x[1]), default=None)
                rows.append((n, entries[best[1]][0] if best and best[0] >= least else None, round(best[0], 4) if best else 0.0))
            yield pd.DataFrame(rows, columns=[name, "match_id", "score"])

    return names.select(name).dropna().distinct().mapInPandas(run, f"{name} string, match_id string, score double")


def fuzzy_matches(names: DataFrame, name: str, catalog: list[tuple[str, str]], least: float = FUZZY_MATCH) -> DataFrame:
    """(name, match_id, score) as fuzzy_best() gives them, of the names that have a match only.

    Entries are scored in falling order of a bound on their score, from the letters both have, until none can be better.
    """
    if len(catalog) > SMALL:
        raise ValueError("the catalog is too large to go to every task")
    entries = sorted(catalog)
    n_letters = 64

    def letters(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), n_letters), np.uint8)
        for k, t in enumerate(texts):
            for ch, n in Counter(t).items():  # letters that share a place only raise the bound
                out[k, ord(ch) % n_letters] = min(255, int(out[k, ord(ch) % n_letters]) + n)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low = [c.lower() for _, c in entries]
        have, size = letters(low), np.array([len(c) for c in low], float)
        flat = np.array([len(" ".join(c.split())) for c in low], float)
        longest = max(map(len, low), default=0)
        for pdf in batches:
            rows = []
            for n in pdf[name]:
                t = n.lower()
                both = np.minimum(have, letters([t])[0]).sum(1, dtype=np.int64).astype(float)
                if max(len(t), longest) > 255:  # counts may have been cut
                    both = np.minimum(size, len(t))
                part = 200 * both / np.maximum(np.minimum(size, len(t)) + both, 1)
                bound = TOKEN_WEIGHT * np.minimum(200 * both / np.maximum(flat + len(" ".join(t.split())), 1), 100) + PART_WEIGHT * part + 1e-6
                order = np.flatnonzero(bound >= least)
                best = (least, 1)  # as (score, -place); 1 stands for none yet
                for i in order[np.argsort(-bound[order], kind="stable")]:
                    if bound[i] < best[0]:
                        break
                    words = token_sort_ratio(n, entries[i][1])
                    if TOKEN_WEIGHT * words + PART_WEIGHT * part[i] + 1e-6 < best[0]:
                        continue
                    score = TOKEN_WEIGHT * words + PART_WEIGHT * partial_ratio(n, entries[i][1])
                    if score > best[0] or (score == best[0] and (best[1] == 1 or -i > best[1])):
                        best = (score, -int(i))
                if best[1] != 1:
                    rows.append((n, entries[-best[1]][0], round(best[0], 4)))
            yield pd.DataFrame(rows, columns=[name, "match_id", "score"])

    return spread(names.select(name).dropna().distinct(), name).mapInPandas(run, f"{name} string, match_id string, score double")


def resolve_names(df: DataFrame, name: str, key, catalog: DataFrame, entry_id: str, entry_name: str, fuzzy: DataFrame | None = None) -> DataFrame:
    """Add resolved_id and confidence: the exact key, else the best likeness, else a placeholder made from the key.

    `key` makes the key of a name's column. `fuzzy` is as from fuzzy_best() on `name`. Null names get null ids.
    """
    exact = catalog.select(key(F.col(entry_name)).alias("__k"), F.col(entry_id).cast("string").alias("__id")).groupBy("__k").agg(F.min("__id").alias("__id"))
    out = df.withColumn("__k", key(F.col(name))).join(exact, "__k", "left")
    if fuzzy is not None:
        out = out.join(fuzzy, name, "left")
    else:
        out = out.withColumn("match_id", F.lit(None).cast("string")).withColumn("score", F.lit(None).cast("double"))
    made = F.when(F.col("__k").isNotNull(), F.concat(F.lit("new-"), F.substring(F.sha2("__k", 256), 1, 16)))
    conf = F.when(F.col("__id").isNotNull(), EXACT_CONFIDENCE).when(F.col("match_id").isNotNull(), F.round(F.col("score") / 100, 4)).when(made.isNotNull(), PLACEHOLDER_CONFIDENCE)
    return out.withColumn("resolved_id", F.coalesce("__id", "match_id", made)).withColumn("confidence", conf).drop("__k", "__id", "match_id", "score")


def cascade_lookup(df: DataFrame, steps: list[tuple[Column, DataFrame]]) -> DataFrame:
    """Add found and step: the value of the first lookup table (key, value) that has the row's key for that step."""
    out = df
    for i, (key, lookup) in enumerate(steps):
        t = lookup.select(F.col(lookup.columns[0]).alias(f"__k{i}"), F.col(lookup.columns[1]).alias(f"__v{i}")).dropna().dropDuplicates([f"__k{i}"])
        out = out.join(t, key == F.col(f"__k{i}"), "left")
    step = F.coalesce(*[F.when(F.col(f"__v{i}").isNotNull(), F.lit(i + 1)) for i in range(len(steps))])
    found = F.coalesce(*[F.col(f"__v{i}") for i in range(len(steps))])
    return out.withColumn("step", step).withColumn("found", found).drop(*[f"__{x}{i}" for i in range(len(steps)) for x in "kv"])


def needles(title: Column, most: int = 4) -> Column:
    """The first words of a title with four letters or more, in small letters, to look for in a catalog."""
    return F.slice(F.array_distinct(F.filter(F.split(F.lower(title), r"[^\p{L}]+"), lambda w: F.length(w) >= 4)), 1, most)


def catalog_candidates(df: DataFrame, key: str, title: str, catalog: DataFrame, code: str, label: str, top: int = 15) -> DataFrame:
    """(key, code, score, rank): catalog entries whose label contains a word of the title, the best `top` first.

    The score is the number of the title's words in the label, twice where the label starts with one; ties by code.
    The catalog's words are joined by equality, so no pair without a common word is made.
    """
    words = df.select(key, F.explode(needles(F.col(title))).alias("w"))
    entries = catalog.select(code, F.explode(F.array_distinct(F.split(F.lower(label), r"[^\p{L}]+"))).alias("w"), F.lower(label).alias("__l"))
    hits = words.join(entries, "w").groupBy(key, code).agg(F.sum(F.when(F.col("__l").startswith(F.col("w")), 2).otherwise(1)).cast("long").alias("score"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.asc(code))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def first_code(df: DataFrame, keys: list[Column], known: DataFrame, columns: list[str], code: str) -> DataFrame:
    """Add `code`: the smallest code that `known` (columns, code) has for the row's keys, or null."""
    names = [f"__k{i}" for i in range(len(keys))]
    t = known.select(*[F.col(c).alias(n) for c, n in zip(columns, names)], F.col(code).alias("__code")).dropna().groupBy(*names).agg(F.min("__code").alias(code))
    return df.drop(code).withColumns(dict(zip(names, keys))).join(t, names, "left").drop(*names)


def substring_candidates(df: DataFrame, key: str, title: str, catalog: DataFrame, code: str, label: str, top: int = 15, letters: int = 4) -> DataFrame:
    """(key, code, score, rank): entries whose label has words of the title in it anywhere, the most words first, then the
    shorter label, then by code; the best `top`. Words have `letters` letters or more.

    A word in a label begins with some `letters` letters of it, so the two are joined on these, and the rest is compared.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(title), "[^a-z]+"), lambda w: F.length(w) >= letters))
    rows = df.select(key, F.explode(words).alias("w")).withColumn("g", F.substring("w", 1, letters))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(label) - (letters - 1), F.lit(1))), lambda i: F.substring(F.lower(label), i, letters)))
    entries = catalog.select(code, F.lower(label).alias("__l"), F.explode(grams).alias("g"))
    hits = rows.join(entries, "g").filter(F.col("__l").contains(F.col("w"))).groupBy(key, code).agg(F.count(F.lit(1)).alias("score"), F.first(F.length("__l")).alias("__size"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.asc("__size"), F.asc(code))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).drop("__size")


def first_theme(df: DataFrame, text: str, themes: list[tuple[str, str]]) -> DataFrame:
    """Add theme: the first of (name, pattern) that the text contains, whatever the case, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(themes):
        out = F.when(F.lower(F.coalesce(text, F.lit(""))).rlike(pattern), name).otherwise(out)
    return df.withColumn("theme", out)

"""Roles of postings told from titles and texts, against small lists of role names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of titles that name a role, the first that is found decides.
TITLE_ROLES = (
    ("machine learning", "Machine Learning"), ("data scientist", "Data Science"), ("data science", "Data Science"), ("data engineer", "Data Engineering"), ("data analyst", "Data Analytics"),
    ("data analytics", "Data Analytics"), ("full stack", "Software Engineering"), ("fullstack", "Software Engineering"), ("backend", "Software Engineering"), ("front end", "Software Engineering"),
    ("frontend", "Software Engineering"), ("software engineer", "Software Engineering"), ("software developer", "Software Engineering"), ("devops", "DevOps"), ("ml platform", "Machine Learning"),
    ("ml engineer", "Machine Learning"), ("platform engineer", "Software Engineering"),
)
# The areas that roles are told from where no other list is given, and how names begin that are no roles.
AREAS = (("ta-data-eng", "Data Engineering"), ("ta-sw-eng", "Software Engineering"), ("ta-ml", "Machine Learning"), ("ta-ds", "Data Science"), ("ta-devops", "DevOps"), ("ta-data-analytics", "Data Analytics"))
NO_ROLES = ("n/a", "not an", "not classified", "unknown")
# Letters of a word that counts, and of one that is looked for inside others.
WORD, INSIDE = 2, 3


def words(text: Column) -> Column:
    """The different words of small letters and digits in the text, of WORD letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= WORD))


def _inside(word: str):
    return lambda c: (F.length(c) >= INSIDE) & (c.contains(word) | F.lit(word).contains(c))


def overlap(name: str, found: Column) -> Column:
    """How many of a name's words the words `found` have, or have as a part, or are a part of."""
    score = F.lit(0)
    for w in sorted({x for x in "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in name.lower()).split() if len(x) >= WORD}):
        hit = F.array_contains(found, w)
        if len(w) >= INSIDE:
            hit = hit | F.exists(found, _inside(w))
        score = score + F.when(hit, 1).otherwise(0)
    return score


def best_of(names: tuple[tuple[str, str], ...], found: Column) -> Column:
    """struct(score, size, id, name) of the name with the most words found; of equal ones the longer, then the larger id."""
    real = [(i, n) for i, n in names if not n.strip().lower().startswith(NO_ROLES)]
    each = [F.struct(overlap(n, found).alias("score"), F.lit(len(n)).alias("size"), F.lit(i).alias("id"), F.lit(n).alias("name")) for i, n in real]
    return F.greatest(*each) if len(each) > 1 else each[0]


def role(title: Column, text: Column, areas: tuple[tuple[str, str], ...] = AREAS, sectors: tuple[tuple[str, str], ...] = (), least: int = 1) -> Column:
    """The role of a posting: by a phrase in the title, else the area whose name overlaps most with the words of title and
    text, else the sector, whose overlap must be one and a half times `least`, else "unclassified"."""
    low = F.lower(F.coalesce(title, F.lit("")))
    hinted = F.lit(None).cast("string")
    for phrase, name in reversed(TITLE_ROLES):
        hinted = F.when(low.contains(phrase), name).otherwise(hinted)
    found = words(F.concat_ws(" ", title, text))
    steps = [hinted]
    for names, bar in ((areas, least), (sectors, max(least, -(-3 * least // 2)))):
        if names:
            best = best_of(names, found)
            steps.append(F.when(best["score"] >= bar, best["name"]))
    return F.coalesce(*steps, F.lit("unclassified"))

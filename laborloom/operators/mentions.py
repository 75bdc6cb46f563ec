"""Mentions of known names and of context in texts, with their spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the text around a mention that are kept, and how many names may go to every task.
AROUND, MOST_NAMES = 60, 200_000

# Families of context, their patterns and the confidence of a signal of each.
CONTEXT = {
    "remote_policy": (r"\b(fully\s+remote|full-?time\s+remote|100%\s+remote|remote-?first|hybrid|hybrid\s+work|2\s+days?\s+onsite|two\s+days?\s+(?:a\s+week\s+)?onsite|on-?site\s+(?:required|only)|work\s+from\s+home|wfh)\b", 0.9),
    "team_size": (r"\b(?:team\s+of\s+(\d+)|(\d+)\s*[-–]\s*(\d+)\s*person\s+team|(\d+)\s*[-–]\s*(\d+)\s*member\s+team|(\d+)\s*person\s+team)\b", 0.88),
    "reporting_structure": (r"\b(reports?\s+to|direct\s+reports?|dotted-?line|matrix\s+reporting|reporting\s+line|manager\s+of)\b", 0.85),
    "work_methodology": (r"\b(agile|scrum|kanban|safe|lean|sprint\s+planning|daily\s+stand-?up)\b", 0.9),
    "ai_adoption_signal": (r"\b(llms?|large\s+language\s+models?|generative\s+ai|gen-?ai|ai-?first|machine\s+learning|ml\s+models?|deep\s+learning)\b", 0.87),
}


_TOKEN = re.compile(r"\w+|[^\w\s]")


@dataclass(frozen=True)
class Name:
    """One way to write a label: how sure it is, and whether it only counts near a word of its context."""

    alias: str
    label: str
    category: str = ""
    confidence: float = 1.0
    context: tuple[str, ...] = ()


class Names:
    """A trie of names by word; a text is walked from each of its words, so that the cost doesn't grow with the number of names."""

    def __init__(self, names: list[Name]) -> None:
        self.root: dict = {}
        for n in sorted(names, key=lambda n: (n.alias.lower(), n.label)):
            node = self.root
            for m in _TOKEN.finditer(n.alias.lower()):
                node = node.setdefault(m[0], {})
            node.setdefault("", []).append(n)

    def found(self, text: str) -> Iterator[tuple[int, int, Name]]:
        """(start, end, name) of every name in the text, as whole words, whatever the case."""
        words = [(m[0].lower(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
        for i, (w, start, _) in enumerate(words):
            node = self.root.get(w)
            if node is None or (start and _inner(text[start - 1])):
                continue
            k = i
            while node is not None:
                end = words[k][2]
                for n in node.get("", ()):
                    if (end == len(text) or not _inner(text[end])) and text[start:end].lower() == n.alias.lower():
                        yield start, end, n
                k += 1
                node = node.get(words[k][0]) if k < len(words) else None

    def kept(self, text: str) -> Iterator[tuple[int, int, Name]]:
        """Those of found() that have their context and don't overlap: the first, of these the longest, then the surest."""
        low = text.lower()
        ok = (x for x in self.found(text) if not x[2].context or any(w in low[max(0, x[0] - AROUND) : x[1] + AROUND] for w in x[2].context))
        end = 0
        for start, stop, n in sorted(ok, key=lambda x: (x[0], x[0] - x[1], -x[2].confidence, x[2].label.lower())):
            if start >= end:
                yield start, stop, n
                end = stop


def _inner(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def name_mentions(df: DataFrame, key: str, fields: list[str], names: list[tuple[str, str]]) -> DataFrame:
    """(key, label, text, field, start_char, end_char, around): mentions of names (alias, label) in the fields.

    At one place the longest name wins, and mentions don't overlap; a label is reported once for each row, at its
    first mention in the order of the fields. Names may be MOST_NAMES at most, as they go to every task.
    """
    return catalogue_mentions(df, key, fields, [Name(a, label) for a, label in names]).drop("category", "confidence")


def catalogue_mentions(df: DataFrame, key: str, fields: list[str], names: list[Name]) -> DataFrame:
    """(key, label, category, confidence, text, field, start_char, end_char, around): each row's labels, once, at their best mention.

    The best mention is the surest, then that of the earlier field, the longer one, the first. At one place of a field the longest name
    wins. Names with a context count only within AROUND characters of one of its words. Null texts have no mentions.
    """
    if len(names) > MOST_NAMES:
        raise ValueError("too many names to go to every task")
    columns = [key, "label", "category", "confidence", "text", "field", "start_char", "end_char", "around"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Names(names)
        for pdf in batches:
            rows = []
            for values in pdf[[key, *fields]].itertuples(index=False):
                best: dict[str, tuple] = {}
                for at, (field, text) in enumerate(zip(fields, values[1:])):
                    for start, end, n in trie.kept(text) if text else ():
                        rank = (n.confidence, -at, end - start, -start)
                        if n.label not in best or rank > best[n.label][0]:
                            best[n.label] = (rank, (values[0], n.label, n.category, n.confidence, text[start:end], field, start, end, text[max(0, start - AROUND) : end + AROUND]))
                rows += [row for _, row in best.values()]
            yield pd.DataFrame(rows, columns=columns)

    kind = dict(df.dtypes)[key]
    return df.select(key, *fields).mapInPandas(run, f"{key} {kind}, label string, category string, confidence double, text string, field string, start_char long, end_char long, around string")


def context_signals(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, family, signal, n, confidence): each family's different signals in the text, in built-in functions."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array(*[F.struct(F.lit(f).alias("family"), F.regexp_extract_all(low, F.lit(f"({p})"), F.lit(1)).alias("s"), F.lit(c).alias("confidence")) for f, (p, c) in CONTEXT.items()])
    rows = df.select(key, F.explode(found).alias("x")).select(key, "x.family", "x.confidence", F.explode("x.s").alias("signal"))
    return rows.groupBy(key, "family", "signal", "confidence").agg(F.count(F.lit(1)).alias("n")).select(key, "family", "signal", "n", "confidence")


def extraction_warnings(skills: str, least: float = 0.75):
    """An array of warnings about an array of skills (skill_name, confidence): blank names, confidences out of range or
    low, names that come twice. A null array gives the warning that it is missing."""
    name = lambda s: F.lower(F.trim(F.coalesce(s["skill_name"], s["label"], F.lit(""))))
    names = F.transform(F.col(skills), name)
    tests = (
        ("missing", F.col(skills).isNull()), ("empty", F.size(skills) == 0), ("blank_name", F.exists(F.col(skills), lambda s: name(s) == "")),
        ("confidence_range", F.exists(F.col(skills), lambda s: (s["confidence"] < 0) | (s["confidence"] > 1) | F.isnan(s["confidence"]))),
        ("low_confidence", F.exists(F.col(skills), lambda s: s["confidence"] < least)), ("repeated_name", F.size(F.array_distinct(names)) < F.size(names)),
    )
    return F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(w)) for w, t in tests]), lambda x: x.isNotNull())


def confident(skills: str, least: float = 0.75):
    """The skills with a confidence of `least` or more and a name."""
    return F.filter(F.col(skills), lambda s: (s["confidence"] >= least) & (F.trim(F.coalesce(s["skill_name"], s["label"], F.lit(""))) != ""))

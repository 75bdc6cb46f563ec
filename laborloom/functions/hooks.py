"""Where a model may be called: an injectable function of batches, with a stand-in, and the checks of its output."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: A model takes a list of prompts and gives a list of answers of the same length.
Model = Callable[[list[str]], list[str]]


def stand_in(prompts: list[str]) -> list[str]:
    """No model: answers with nothing, which every check reads as "not classified"."""
    return ["" for _ in prompts]


def ask(df: DataFrame, key: str, prompt: str, model: Model = stand_in, batch: int = 64) -> DataFrame:
    """(key, answer): each different prompt is asked once, in batches; a failing batch gives null answers."""
    distinct = df.select(prompt).dropna().distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prompts, out = pdf[prompt].tolist(), []
            for at in range(0, len(prompts), batch):
                try:
                    out += model(prompts[at : at + batch])
                except Exception:  # a model's failure is data, not an end
                    out += [None] * len(prompts[at : at + batch])
            yield pd.DataFrame({prompt: prompts, "answer": pd.array(out, "string")})

    answers = distinct.mapInPandas(run, f"{prompt} string, answer string")
    return df.select(key, prompt).join(answers, prompt, "left").select(key, "answer")


def pick_code(answer: str | None, candidates: list[str], unknown: str = "unclassified") -> str:
    """The candidate that an answer names, exactly, by its digits, or within a longer text; else `unknown`."""
    text = (answer or "").strip()
    if text in candidates:
        return text
    digits = {re.sub(r"\D", "", c): c for c in candidates}
    for token in [text, *re.findall(r"\d[\d.\-]*\d", text)]:
        d = re.sub(r"\D", "", token)
        if d and d in digits:
            return digits[d]
    return unknown


def read_records(answer: str | None, fields: tuple[str, ...], confidence: float = 0.75) -> tuple[list[dict], bool]:
    """(records with all fields and enough confidence, whether the answer failed): from a JSON list, or an object
    with one, also within a fence."""
    text = re.sub(r"^```\w*\s*|\s*```$", "", (answer or "").strip())
    try:
        data = json.loads(text)
    except ValueError:
        return [], True
    if isinstance(data, dict):
        data = next((v for v in data.values() if isinstance(v, list)), [])
    rows = [r for r in data if isinstance(r, dict) and all(str(r.get(f) or "").strip() for f in fields) and float(r.get("confidence") or 0) >= confidence] if isinstance(data, list) else []
    return rows, not rows


def summary(label: str, trend: str, fresh: int, stale: int) -> str:
    """A sentence on a label without a model."""
    return f"{label} is {trend}; {fresh} postings are fresh and {stale} are stale."



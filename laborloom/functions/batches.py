"""Runs of equal keys in sorted batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd


def groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[object, pd.DataFrame]]:
    """(key, rows) of each run of equal keys in sorted batches, also where a run goes over a batch's end."""
    held: list[pd.DataFrame] = []
    at = None
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        cuts = [0, *((k[1:] != k[:-1]).nonzero()[0] + 1).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:]):
            if held and k[a] != at:
                yield at, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            at = k[a]
            held.append(pdf.iloc[a:b].reset_index(drop=True))
    if held:
        yield at, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]

"""Labels resolved against a taxonomy in steps, each label once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze

# The steps that resolve a label, and the similarity from which a vector resolves it.
STEPS = {"extension": 1, "exact": 2, "normalised": 3, "embedding": 4, "unresolved": 6}
SIMILAR = 0.92


def exact_key(label: Column) -> Column:
    return F.lower(F.trim(label))


def normal_key(label: Column) -> Column:
    """Small letters, letters and digits only, single blanks."""
    return squeeze(F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]+", " "))


def resolve(labels: DataFrame, label: str, catalog: DataFrame, extensions: DataFrame | None = None, similar: DataFrame | None = None) -> DataFrame:
    """(label, uri, step, confidence) of each distinct label.

    `catalog` is (uri, name) with a row for each preferred, alternative or hidden name; `extensions` is (name, uri);
    `similar` is (label, uri, similarity) from a search by vectors, taken from SIMILAR on. Of several entries with one
    name the smallest uri is taken. Null and blank labels are left out.
    """
    out = labels.select(F.col(label).alias("label")).filter(F.trim("label") != "").distinct()
    steps = [("exact", exact_key, catalog), ("normalised", normal_key, catalog)]
    if extensions is not None:
        steps.insert(0, ("extension", normal_key, extensions))
    found = []
    for name, key, table in steps:
        t = table.select(key(F.col("name")).alias(f"__{name}"), F.col("uri")).dropna().groupBy(f"__{name}").agg(F.min("uri").alias(f"{name}_uri"))
        out = out.join(t, key(F.col("label")) == F.col(f"__{name}"), "left").drop(f"__{name}")
        found.append((name, F.col(f"{name}_uri"), F.lit(1.0)))
    if similar is not None:
        best = similar.filter(F.col("similarity") >= SIMILAR).groupBy("label").agg(F.max_by(F.struct("uri", "similarity"), F.struct("similarity", "uri")).alias("near"))
        out = out.join(best, "label", "left")
        found.append(("embedding", F.col("near.uri"), F.col("near.similarity")))
    uri = F.coalesce(*[u for _, u, _ in found])
    step = F.coalesce(*[F.when(u.isNotNull(), STEPS[n]) for n, u, _ in found], F.lit(STEPS["unresolved"]))
    confidence = F.coalesce(*[F.when(u.isNotNull(), c) for _, u, c in found], F.lit(0.0))
    return out.select("label", uri.alias("uri"), step.alias("step"), confidence.alias("confidence"))


def coverage(resolved: DataFrame) -> DataFrame:
    """(step, n, mean_confidence)."""
    return resolved.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))

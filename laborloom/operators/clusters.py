"""Clusters of vectors with a summary of their members, and candidates for new ones."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import centroids, unit


def cluster(df: DataFrame, key: str, vector: str, k: int, dims: int = 16, least: int = 3, seed: int = 1) -> DataFrame:
    """(key, cluster_id, is_noise): principal components, then bisecting k-means; clusters below `least` are noise.

    Not density clustering, whose libraries are not here, but its output's form. The same seed gives the same clusters.
    """
    v = df.select(F.col(key).alias("key"), array_to_vector(unit(F.col(vector))).alias("features")).dropna()
    reduced = PCA(k=dims, inputCol="features", outputCol="pc").fit(v).transform(v)
    fitted = BisectingKMeans(k=k, seed=seed, featuresCol="pc", predictionCol="cluster_id", minDivisibleClusterSize=2.0 * least).fit(reduced)
    found = fitted.transform(reduced).select("key", "cluster_id")
    small = found.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return found.join(small, "cluster_id").select(F.col("key").alias(key), F.when(F.col("n") >= least, F.col("cluster_id")).otherwise(-1).alias("cluster_id"), (F.col("n") < least).alias("is_noise"))


def most_common(df: DataFrame, group: str, value: str, top: int) -> DataFrame:
    """(group, values): the `top` most frequent values, the most frequent first, ties by name."""
    counts = df.select(group, value).dropna().groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), F.asc(value))
    best = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return best.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(value).alias("v")))), lambda s: s["v"]).alias("values"))


def summarise(members: DataFrame, vector: str, tops: dict[str, int]) -> DataFrame:
    """(cluster_id, members, centroid, one list for each column in `tops`): noise left out."""
    real = members.filter("cluster_id >= 0")
    out = centroids(real, "cluster_id", vector).withColumnRenamed("n", "members")
    for column, top in tops.items():
        out = out.join(most_common(real, "cluster_id", column, top).withColumnRenamed("values", f"top_{column}"), "cluster_id", "left")
    return out


def dominant_label(df: DataFrame, group: str, label: str, share: float = 0.30) -> DataFrame:
    """(group, label, label_share): the most frequent label if its share is `share` or more, else null; ties by name."""
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(group).agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    first = counts.join(total, group).filter(F.col("n") == F.col("most")).groupBy(group).agg(F.min(label).alias("l"), F.first("most").alias("most"), F.first("total").alias("total"))
    s = F.round(F.col("most") / F.col("total"), 6)
    return first.select(group, F.when(s >= share, F.col("l")).alias("label"), s.alias("label_share"))


def novel_groups(noise: DataFrame, group: str, skills: str, employer: str, known: DataFrame, novel: int = 3, employers: int = 2) -> DataFrame:
    """(group, members, novel_skills): groups of noise rows with `novel` skills or more that no cluster has, of
    `employers` or more. `known` has one column, the clusters' skills."""
    long = noise.select(group, employer, F.explode(skills).alias("skill"))
    fresh = long.join(known.select(F.col(known.columns[0]).alias("skill")).distinct(), "skill", "left_anti").groupBy(group).agg(F.array_sort(F.collect_set("skill")).alias("novel_skills"))
    size = noise.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.count_distinct(employer).alias("e"))
    return size.filter(F.col("e") >= employers).join(fresh, group).filter(F.size("novel_skills") >= novel).select(group, "members", "novel_skills")

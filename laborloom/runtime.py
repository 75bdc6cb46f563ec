"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that the operators rely on; a running session keeps whatever else it has.
REQUIRED = {"spark.sql.session.timeZone": "UTC"}


def build_session(app: str = "laborloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow on. On a cluster, leave `master` to spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        **REQUIRED,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Set what every operator relies on; called by each query."""
    for k, v in REQUIRED.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else, on a local master only, one of our own.

    On a cluster a folder of one machine would be written and read in parts, so that raises.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_laborloom_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="laborloom-")
        spark._laborloom_dir = own
        spark.sparkContext.setCheckpointDir(own)
    return own


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage and survives a lost executor, as every executor can read the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/laborloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession, rows: int, per_partition: int, per_core: int = 1) -> int:
    """Partitions for `rows`, at most `per_partition` rows in each, at least `per_core` for each core."""
    return max(per_core * spark.sparkContext.defaultParallelism, -(-rows // per_partition))


#: Bytes of files that one partition of work in Python stands for at most, as a scan's splits.
PART_BYTES = 128 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that the frame is read from, as the optimizer knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))
    return sum(n for n in sizes if n < 2**60)  # tables of unknown size say 2**63 - 1


def parts_for(df: DataFrame, per_core: int = 3) -> int:
    """Partitions for work in Python on `df`: several for each core, and one for PART_BYTES of its input at least."""
    return parallelism(df.sparkSession, input_bytes(df), PART_BYTES, per_core)


def spread(df: DataFrame, *keys: str, per_core: int = 3) -> DataFrame:
    """`df` over several partitions for each core, for work in Python that would else follow the size in bytes.

    AQE merges small partitions by their bytes, and a scan splits files by theirs; neither knows what a row costs. The
    number grows with the input, one partition for PART_BYTES of it at least.
    """
    return df.repartition(parts_for(df, per_core), *keys)


def scanned(df: DataFrame, per_core: int = 3) -> DataFrame:
    """`df`, a scan with narrow steps, in several partitions for each core without a shuffle where its files allow it.

    A scan's splits are already distributed, so a large table's are used as they are; only where there are fewer than
    `per_core` for each core are rows dealt out in turn.
    """
    wanted = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the input tables below `root`."""
    prepare(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")

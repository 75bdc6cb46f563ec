"""The driver's tables as posting-shaped frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import week_of
from .runtime import table


def postings(spark: SparkSession, root: str) -> DataFrame:
    """Orders as postings: company, sector, place, date, seniority, pay; status P is spam, F a repeat of no one."""
    o = table(spark, root, "orders")
    c = table(spark, root, "customer")
    n = table(spark, root, "nation").join(table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        .select(
            F.col("o_orderkey").alias("posting_id"), F.col("o_custkey").alias("company_id"), F.col("c_name").alias("company"), F.col("c_mktsegment").alias("sector"), F.col("n_name").alias("subregion"),
            F.col("r_name").alias("market"), F.col("o_orderdate").alias("date_posted"), week_of(F.col("o_orderdate")).alias("week_start"), F.col("o_orderpriority").alias("seniority"),
            F.col("o_totalprice").alias("salary"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderstatus") == "P", True).when(F.col("o_orderstatus") == "O", False).alias("is_spam"),
        )
    )


def elements(spark: SparkSession, root: str) -> DataFrame:
    """Line items as extracted elements of postings: a skill (brand), a tool (type) and who asked (supplier)."""
    li, p = table(spark, root, "lineitem"), table(spark, root, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("posting_id"), F.col("l_linenumber").alias("position"), F.col("p_brand").alias("skill"), F.col("p_type").alias("tool"), F.col("l_suppkey").alias("supplier_id"),
        (F.col("l_returnflag") == "R").alias("failed"), F.col("l_quantity").alias("quantity"), F.col("p_name").alias("task"),
    )


def skill_rows(spark: SparkSession, root: str) -> DataFrame:
    """Elements of postings that pass the gates, with the posting's week, company and place."""
    from .operators.gates import analytics_gate

    e = elements(spark, root).filter(~F.col("failed"))
    return e.join(analytics_gate(postings(spark, root)), "posting_id")

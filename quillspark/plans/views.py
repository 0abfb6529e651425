"""The driver tables seen as this engine's entities. Each view is cheap and carries only what its users need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents of a customer's project; lines are pages; finished orders are superseded."""
    pages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.count("*").alias("pages"))
    orders = table(spark, d, "orders").select(
        F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("created_at"), F.expr("if(o_orderstatus = 'F', o_orderdate, null)").alias("superseded_at")
    )
    return orders.join(pages, "document_id")


def usage(spark: SparkSession, d: str) -> DataFrame:
    """Events as token usage of four models, one without a price."""
    return table(spark, d, "events").selectExpr(
        "event_id", "event_type as kind", "case event_id % 4 when 0 then 'alpha' when 1 then 'beta' when 2 then 'beta-batch' else 'gamma' end as model", "user_id % 10 as project", "cast(ts as date) as day", "ts",
        "event_id % 1000 as input_tokens", "event_id % 300 as output_tokens", "event_id % 50 as cache_read", "event_id % 20 as cache_write", "event_id % 1000 + event_id % 300 as tokens",
    )


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("alpha", 3.0, 15.0), ("beta", 1.0, 5.0)], "model string, rate_in double, rate_out double")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Parts as chunks whose text carries sheet identifiers."""
    return table(spark, d, "part").selectExpr(
        "p_partkey as chunk_id", "p_partkey % 50 as page_id", "concat('SEE ', upper(substr(p_type, 1, 1)), '-', 100 + p_partkey % 400, ' AND DETAIL ', p_partkey % 9 + 1, '/S-', 500 + p_partkey % 50, ' FOR ', p_name) as text"
    )


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines as pages of an order's project with a discipline."""
    return table(spark, d, "lineitem").selectExpr("l_suppkey as project", "l_orderkey * 10 + l_linenumber as page_id", "l_orderkey * 10 + l_linenumber as combined_page", "concat(l_returnflag, l_linestatus) as discipline")

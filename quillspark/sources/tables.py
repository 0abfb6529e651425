"""Readers and sinks. Schemas are given, never inferred; writes replace whole partitions."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tasks_for(rows: DataFrame, each: int = 1_000_000) -> int:
    """Tasks that rows need so that none holds much more than `each` of them, and that keep all cores busy."""
    return rows.count() // each + rows.sparkSession.sparkContext.defaultParallelism


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Malformed lines give nulls and are kept in _corrupt_record where the schema names it."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def csv(spark: SparkSession, path: str, schema: str, delimiter: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", delimiter).csv(path)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size, modified and content of binary files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def library(spark: SparkSession, path: str, schema: str, group: str) -> DataFrame:
    """A question list in a sheet, nested by its group in the order of the rows' own number."""
    rows = csv(spark, path, schema)
    rest = [c for c in rows.columns if c != group]
    return rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("questions"))


def live(documents: DataFrame) -> DataFrame:
    return documents.filter("superseded_at is null")


def analysable(documents: DataFrame) -> DataFrame:
    return live(documents).filter("include_in_analysis and status = 'completed'")


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Writes df and replaces exactly the partitions that it has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); only a local master may do without it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/quillspark-shared"
    return f"{base.rstrip('/')}/quillspark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: later uses and lost executors read the files."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

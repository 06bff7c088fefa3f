"""Whole text files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_documents(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, file_bytes, text): UTF-8 with U+FFFD in place of bytes that are none."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        "path", F.col("length").alias("file_bytes"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")
    )


def scan_workspace(spark: SparkSession, path: str, workspace: str, columns: list[str]) -> DataFrame:
    """Columns of one workspace of a table; predicate and column list reach the scan."""
    return spark.read.parquet(path).where(F.col("workspace_id") == workspace).select(*columns)


def write_workspaces(df: DataFrame, path: str) -> None:
    """Replace the workspaces that occur in `df`, leave the others as they are."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("workspace_id")
        .parquet(path)
    )

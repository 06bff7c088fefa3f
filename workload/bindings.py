"""How the test tables stand in for chunks, requests and records. Each view exists once as
a DataFrame and once as DuckDB SQL with the same formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from groundwell.functions import vector as V


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table; its schema is read from the file once per process."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    kinds = F.array(*map(F.lit, ("document", "git_commit", "db_schema", "owner_answer")))
    return table(spark, sf, "documents").select(
        i.alias("chunk_id"),
        F.col("text").alias("content"),
        F.concat(F.lit("ws"), i % 4).alias("workspace_id"),
        F.when(i % 3 != 0, F.concat(F.lit("task-"), i % 5)).alias("task_id"),
        F.when(i % 7 == 0, "restricted").otherwise("normal").alias("sensitivity_level"),
        F.get(kinds, (i % 4).cast("int")).alias("source_type"),
        i.alias("source_id"),
        F.when(i % 5 != 0, F.concat(F.lit("owner-"), i % 11)).alias("owner_name"),
    )


CHUNKS = """chunks AS (
  SELECT doc_id AS chunk_id, text AS content, 'ws' || (doc_id % 4) AS workspace_id,
         CASE WHEN doc_id % 3 <> 0 THEN 'task-' || (doc_id % 5) END AS task_id,
         CASE WHEN doc_id % 7 = 0 THEN 'restricted' ELSE 'normal' END AS sensitivity_level,
         CASE doc_id % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'git_commit' WHEN 2 THEN 'db_schema'
              ELSE 'owner_answer' END AS source_type,
         doc_id AS source_id,
         CASE WHEN doc_id % 5 <> 0 THEN 'owner-' || (doc_id % 11) END AS owner_name
  FROM documents)"""


def chunk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vecs = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), V.as_double(F.col("embedding")).alias("vector")
    )
    return vecs.join(chunks(spark, sf).select("chunk_id", "workspace_id"), "chunk_id")


VECTORS = """vectors AS (
  SELECT e.vec_id AS chunk_id, c.workspace_id, e.embedding::DOUBLE[] AS vector
  FROM embeddings e JOIN chunks c ON c.chunk_id = e.vec_id)"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    tasks = F.when(i % 2 == 1, F.lit(None).cast("array<string>")).when(
        i % 10 == 0, F.array().cast("array<string>")
    ).otherwise(F.array(F.lit("task-1"), F.lit("task-2")))
    vecs = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), V.as_double(F.col("embedding")).alias("vector")
    )
    return (
        table(spark, sf, "benchmark")
        .join(vecs, "item_id")
        .select(
            i.alias("query_id"),
            F.col("text").alias("query"),
            "vector",
            F.concat(F.lit("ws"), i % 4).alias("workspace_id"),
            tasks.alias("accessible_task_ids"),
            (i % 3 == 0).alias("can_view_restricted"),
        )
    )


REQUESTS = """requests AS (
  SELECT b.item_id AS query_id, b.text AS query, e.embedding::DOUBLE[] AS vector,
         'ws' || (b.item_id % 4) AS workspace_id,
         CASE WHEN b.item_id % 2 = 1 THEN NULL WHEN b.item_id % 10 = 0 THEN []::VARCHAR[]
              ELSE ['task-1', 'task-2'] END AS accessible_task_ids,
         b.item_id % 3 = 0 AS can_view_restricted
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"""

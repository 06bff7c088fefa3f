"""Usage per day from event logs that are being written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.streaming.appended import read_appended
from groundwell.streaming.tables import earlier_batches, run_available, write_batch

USAGE_SCHEMA = "ts timestamp, workspace_id string, embedding_model string, embedding_tokens double"


def read_events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """JSONL files of a directory as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def read_growing_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSONL files of a directory while lines are appended to them; broken lines are skipped."""
    lines = read_appended(spark, path).where(F.try_parse_json("value").isNotNull())
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def daily_usage(events: DataFrame) -> DataFrame:
    """Tokens per workspace, day and model of the rows at hand."""
    return events.groupBy("workspace_id", F.to_date("ts").alias("date"), "embedding_model").agg(
        F.sum(F.col("embedding_tokens").cast("decimal(12,1)")).alias("embedding_tokens")
    )


def run_daily_usage(events: DataFrame, path: str) -> None:
    """Every batch writes the sums of its own rows, however late they are; `read_daily_usage` adds them up."""
    run_available(
        events, f"{path}/checkpoint", lambda df, i: write_batch(daily_usage(df), f"{path}/days", i)
    )


def read_daily_usage(spark: SparkSession, path: str) -> DataFrame:
    days = spark.read.option("basePath", f"{path}/days").parquet(f"{path}/days/batch=*")
    return days.groupBy("workspace_id", "date", "embedding_model").agg(
        F.sum("embedding_tokens").alias("embedding_tokens")
    )


def run_daily_budget(requests: DataFrame, path: str, limit: int, order: str, key: str) -> None:
    """Marks the first `limit` requests of a day in order of arrival; a limit of 0 or less marks all.

    A batch needs only the counts of the days before it. Ranking cuts every task's rows to
    the limit before the shuffle, so one busy day is no hot spot.
    """
    schema = "day date, granted long"

    def each(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        if limit <= 0:
            everything = df.withColumn("day", F.to_date(order)).withColumn("acquired", F.lit(True))
            write_batch(everything, f"{path}/requests", batch)
            return
        used = earlier_batches(spark, f"{path}/used", schema, batch).groupBy("day").agg(F.sum("granted").alias("used"))
        rows = df.withColumn("day", F.to_date(order))
        w = Window.partitionBy("day").orderBy(order, key)
        first = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
        granted = first.join(used, "day", "left").where(F.col("place") <= limit - F.coalesce("used", F.lit(0)))
        marks = granted.select(key, F.lit(True).alias("acquired"))
        out = rows.join(marks, key, "left").withColumn("acquired", F.coalesce("acquired", F.lit(False)))
        write_batch(out, f"{path}/requests", batch)
        done = spark.read.parquet(f"{path}/requests/batch={batch}")
        write_batch(done.where("acquired").groupBy("day").agg(F.count(F.lit(1)).alias("granted")), f"{path}/used", batch)

    run_available(requests, f"{path}/checkpoint", each)

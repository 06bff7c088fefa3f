"""Streaming queries: the tables are written as files that arrive, and streamed."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.operators import chunking, lexical
from groundwell.session import scratch_dir
from groundwell.streaming import appended, ingest, usage
from workload import bindings as b
from workload import retrieval
from workload.reports import CALLS, USAGE, calls

FILES = 6


def _arriving(df: DataFrame, path: str, order: str) -> DataFrame:
    """Rows written as parquet files by ranges of `order`, read as a stream of files."""
    df.repartitionByRange(FILES, order).write.mode("overwrite").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


def stream_usage_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Files may arrive in any order."""
    root = scratch_dir(spark, "usage")
    rows = calls(spark, sf).select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "workspace_id",
        F.col("model").alias("embedding_model"), "embedding_tokens",
    )
    rows.repartitionByRange(FILES, "ts").write.mode("overwrite").json(f"{root}/in")
    usage.run_daily_usage(usage.read_events(spark, f"{root}/in", usage.USAGE_SCHEMA, 2), f"{root}/out")
    return usage.read_daily_usage(spark, f"{root}/out").select(
        "workspace_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "embedding_model",
        F.col("embedding_tokens").cast("double").alias("embedding_tokens"),
    )


def stream_appended_events(spark: SparkSession, sf: str) -> DataFrame:
    """Event logs, one file per event type, that grow between two runs of the same stream. Their last line is
    cut off in the middle when the first run reads them."""
    root = scratch_dir(spark, "growing")
    rows = calls(spark, sf).select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "workspace_id",
        F.col("model").alias("embedding_model"), "embedding_tokens", "purpose",
    )
    lines = rows.select("purpose", F.to_json(F.struct("ts", "workspace_id", "embedding_model", "embedding_tokens")).alias("value"))
    numbered = lines.withColumn("late", F.pmod(F.xxhash64("value"), F.lit(5)) > 2)
    for whole in (False, True):
        _write_logs(numbered.where(~F.col("late") | F.lit(whole)), f"{root}/in", whole)
        stream = usage.read_growing_events(spark, f"{root}/in", usage.USAGE_SCHEMA)
        usage.run_daily_usage(stream, f"{root}/out")
    return usage.read_daily_usage(spark, f"{root}/out").select(
        "workspace_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "embedding_model",
        F.col("embedding_tokens").cast("double").alias("embedding_tokens"),
    )


def _write_logs(lines: DataFrame, folder: str, whole: bool) -> None:
    """One file per purpose, early lines first. Unless `whole`, the last line of each is cut in the middle, as a
    reader would find it while it is written; the next call's files begin with the same bytes."""

    def write(rows):
        system, root = appended.opened(folder)
        system.create_dir(root, recursive=True)
        for purpose, same in groupby(rows, lambda r: r["purpose"]):
            with system.open_output_stream(f"{root}/{purpose}.jsonl") as log:
                last = b""
                for row in same:
                    log.write(last)
                    last = row["value"].encode() + b"\n"
                log.write(last if whole else last[: len(last) // 2])

    lines.repartition("purpose").sortWithinPartitions("purpose", "late", "value").foreachPartition(write)


def stream_verify_budget(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_dir(spark, "budget")
    rows = b.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    usage.run_daily_budget(_arriving(rows, f"{root}/in", "ts"), f"{root}/out", 100, "ts", "event_id")
    done = spark.read.parquet(f"{root}/out/requests/batch=*")
    return done.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count_if("acquired").alias("acquired"), F.count_if(~F.col("acquired")).alias("limited")
    )


def stream_idempotent_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as pushes of commits, three orders per commit."""
    root = scratch_dir(spark, "pushes")
    rows = b.table(spark, sf, "orders").select(
        F.concat(F.lit("ws"), F.floor(F.col("o_orderkey") / 3) % 4).alias("workspace_id"),
        F.sha1(F.floor(F.col("o_orderkey") / 3).cast("string")).alias("commit_hash"),
        F.col("o_orderdate").cast("timestamp").alias("pushed_at"),
    )
    ingest.run_idempotent(_arriving(rows, f"{root}/in", "pushed_at"), f"{root}/out", ["workspace_id", "commit_hash"])
    return spark.read.parquet(f"{root}/out/rows/batch=*").select("workspace_id", "commit_hash")


def stream_reindex(spark: SparkSession, sf: str) -> DataFrame:
    """Documents arrive, and every third one arrives again with another text."""
    root = scratch_dir(spark, "reindex")
    docs = b.table(spark, sf, "documents").select(
        F.concat(F.lit("ws"), F.col("doc_id") % 4).alias("workspace_id"), F.lit("document").alias("source_type"),
        F.col("doc_id").alias("source_id"), F.lit(0).alias("version"), "text",
    )
    again = docs.where("source_id % 3 = 0").withColumns({"version": F.lit(1), "text": F.replace("text", F.lit("e"), F.lit("EE"))})
    stream = _arriving(docs.unionByName(again), f"{root}/in", "source_id")
    keys = ["workspace_id", "source_type", "source_id", "version"]
    ingest.run_reindex(stream, f"{root}/out", lambda df: chunking.chunk_rows(df, keys, 1500, 200))
    return ingest.current_chunks(spark, f"{root}/out").select(
        "workspace_id", "source_id", "version", "chunk_index", "char_start", F.md5("content").alias("content_md5")
    )


def stream_index_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Sources arrive and are indexed; those of two workspaces arrive again with other texts, and the index follows
    the feed. Each document is one chunk."""
    root = scratch_dir(spark, "feed")
    now = b.chunks(spark, sf).select(*ingest.SOURCE, "chunk_id", "content")
    before = now.withColumns({"version": F.lit(0), "content": F.replace("content", F.lit("e"), F.lit("a"))})
    again = now.where(F.col("workspace_id").isin("ws1", "ws3")).withColumn("version", F.lit(1))
    ingest.run_reindex(_arriving(before, f"{root}/in", "source_id"), f"{root}/out", lambda df: df, buckets=16)
    lexical.build_index(ingest.current_chunks(spark, f"{root}/out"), path=f"{root}/index")
    ingest.mark_consumed(spark, f"{root}/out", "index", ingest.feed_end(spark, f"{root}/out"))
    again.repartitionByRange(FILES, "source_id").write.mode("append").parquet(f"{root}/in")
    grown = spark.readStream.schema(before.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    ingest.run_reindex(grown, f"{root}/out", lambda df: df, buckets=16)
    index = ingest.refresh_from_feed(spark, f"{root}/out", f"{root}/index")
    return lexical.top_k(index, b.requests(spark, sf), retrieval.K).withColumn("score", F.round("score", 6))


QUERIES = {
    f.__name__: f
    for f in (stream_usage_daily, stream_appended_events, stream_verify_budget, stream_idempotent_ingest, stream_reindex, stream_index_refresh)
}

ORACLE = {
    "stream_index_refresh": retrieval.ORACLE["index_refresh"],
    "stream_usage_daily": f"WITH {CALLS} {USAGE}",
    "stream_appended_events": f"WITH {CALLS} {USAGE}",
    "stream_verify_budget": """SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, least(count(*), 100) AS acquired, greatest(count(*) - 100, 0) AS limited FROM events GROUP BY 1""",
    "stream_idempotent_ingest": "SELECT DISTINCT 'ws' || ((o_orderkey // 3) % 4) AS workspace_id, sha1((o_orderkey // 3)::VARCHAR) AS commit_hash FROM orders",
    "stream_reindex": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS version, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', 'EE') ELSE text END AS text FROM documents)
      SELECT 'ws' || (doc_id % 4) AS workspace_id, doc_id AS source_id, version, w AS chunk_index, w * 1300 AS char_start, md5(substring(text, w * 1300 + 1, 1500)) AS content_md5
      FROM (SELECT *, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1500 THEN 1 ELSE 1 + ceil((length(text) - 1500) / 1300)::BIGINT END)) AS w FROM d)""",
}

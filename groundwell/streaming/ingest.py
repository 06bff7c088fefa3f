"""Incremental ingest: pushes that may repeat, and re-indexing of sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.operators import lexical
from groundwell.session import fits_broadcast, materialize
from groundwell.sources.bucketed import BucketTable, table_at
from groundwell.streaming.tables import run_available, write_batch

#: What a source is known by.
SOURCE = ("workspace_id", "source_type", "source_id")


def run_idempotent(pushes: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """Each key is written once, however often and in however many batches it arrives.

    The keys written so far lie in a bucketed table; a batch reads the buckets of its own keys only
    and writes those anew, one file set a bucket however many batches there were. A key is kept with
    the batch that brought it, so a batch that is run again after a failure finds its own keys
    unwritten. A watermark would bound the table, but would also lose a push that comes late.
    """

    def each(df: DataFrame, batch: int) -> None:
        once = df.dropDuplicates(keys)
        write_batch(once.join(known_keys(once, f"{path}/keys", keys, batch), keys, "left_anti"), f"{path}/rows", batch)
        new = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows/batch={batch}").select(*keys).withColumn("batch", F.lit(batch))
        table = table_at(df.sparkSession, f"{path}/keys")
        if table is None:
            BucketTable.create(new, f"{path}/keys", keys, buckets)
        else:
            table.update(new, lambda old, rows: old.where(F.col("batch") < batch).unionByName(rows))
            table.clean()

    run_available(pushes, f"{path}/checkpoint", each)


def known_keys(rows: DataFrame, path: str, keys: list[str], batch: int) -> DataFrame:
    """The keys that batches before `batch` have written, out of the buckets of the keys of `rows`."""
    table = table_at(rows.sparkSession, path)
    if table is None:
        return rows.select(*keys).limit(0)
    return table.read(table.touched(rows)).where(F.col("batch") < batch).select(*keys)


def run_reindex(sources: DataFrame, path: str, chunk, keys: tuple[str, ...] = SOURCE, buckets: int = 64) -> None:
    """Puts the chunks of every arriving version of a source in the place of those it had.

    `chunk` turns a DataFrame of sources into chunk rows that keep the key columns and version. The
    chunks lie in a bucketed table, in which a batch touches the buckets of its own sources only; an
    older version that comes late changes nothing, one without chunks leaves none. Behind the change the
    batch's workspaces are written to a feed, see `refresh_from_feed`.
    """

    def each(df: DataFrame, batch: int) -> None:
        spark, found = df.sparkSession, f"{path}/chunks"
        # The texts are moved once, to find the last version of each source, and written as several steps read them.
        known = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, "version")))
        row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
        write_batch(known.groupBy(*keys).agg(F.max_by(row, "version").alias("row")).select("row.*"), f"{path}/arrived", batch)
        last = spark.read.schema(df.schema).parquet(f"{path}/arrived/batch={batch}")
        table = table_at(spark, found) or BucketTable.create(chunk(last).limit(0), found, list(keys), buckets)

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            # Of the sources that were there before, which may be few, both versions.
            versions = new.select(*keys, F.col("version").alias("_version"))
            met = materialize(old.select(*keys, F.col("version").alias("_later")).distinct().join(versions, list(keys)), "met")
            near = F.broadcast if fits_broadcast(met) else (lambda frame: frame)
            both = old.join(near(met.select(*keys, "_version").distinct()), list(keys), "left")
            stays = both.where("_version IS NULL OR version > _version").drop("_version")
            late = near(met.where("_later > _version").select(*keys).distinct())
            comes = chunk(new.join(late, list(keys), "left_anti"))
            return stays.select(*table.schema.names).unionByName(comes.select(*table.schema.names))

        table.update(last, merge).clean()
        write_batch(df.select("workspace_id").distinct(), f"{path}/touched", batch)

    run_available(sources, f"{path}/checkpoint", each)


def current_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of the last version of every source."""
    return BucketTable(spark, f"{path}/chunks").read()


def feed_end(spark: SparkSession, path: str) -> int:
    """The last batch in the feed, -1 before the first."""
    rows = spark.read.option("basePath", f"{path}/touched").parquet(f"{path}/touched")
    last = rows.agg(F.max("batch")).first()[0]
    return -1 if last is None else last


def consumed(spark: SparkSession, path: str, consumer: str) -> int:
    """The last batch that a consumer has seen, -1 if none."""
    listed = spark.createDataFrame([], "upto int")
    try:
        listed = spark.read.schema("upto int").parquet(f"{path}/consumers/{consumer}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    last = listed.agg(F.max("upto")).first()[0]
    return -1 if last is None else last


def mark_consumed(spark: SparkSession, path: str, consumer: str, upto: int) -> None:
    spark.createDataFrame([(upto,)], "upto int").write.mode("append").parquet(f"{path}/consumers/{consumer}")


def stale_workspaces(spark: SparkSession, path: str, since: int, upto: int | None = None) -> DataFrame:
    """Workspaces whose index has to be derived again for the batches behind `since`, through `upto`."""
    rows = spark.read.option("basePath", f"{path}/touched").parquet(f"{path}/touched")
    rows = rows.where(F.col("batch") > since)
    return (rows if upto is None else rows.where(F.col("batch") <= upto)).select("workspace_id").distinct()


def refresh_from_feed(spark: SparkSession, path: str, index: str, consumer: str = "index", **options) -> lexical.LexicalIndex:
    """Brings the lexical index at `index` up to the feed: the workspaces of the batches that this consumer has not
    seen are indexed anew from the current chunks. The offset moves afterwards, so a refresh that failed is done again."""
    since, upto = consumed(spark, path, consumer), feed_end(spark, path)
    if upto <= since:
        return lexical.LexicalIndex.load(spark, index)
    fresh = lexical.refresh_index(spark, index, current_chunks(spark, path), stale_workspaces(spark, path, since, upto), **options)
    mark_consumed(spark, path, consumer, upto)
    lexical.clean_index(spark, index)
    return fresh

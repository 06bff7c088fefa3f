"""Intermediate tables in the shared scratch folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.session import scratch_dir

#: While a table is written: shuffle files go as soon as its query has ended, not when the driver
#: collects garbage, and Python workers get few rows at a time, as texts may be long.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}
#: A table of at most so many rows of a few numbers or short names may be broadcast.
SMALL_ROWS = 100_000


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """SETTINGS hold inside. Only for queries whose shuffles nothing else reads."""
    before = {key: spark.conf.get(key) for key in SETTINGS}
    try:
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def write(df: DataFrame, path: str) -> None:
    with writing(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df`, written once to shared scratch space, so that it outlives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by `stored` that nothing reads any more."""
    spark: SparkSession = df.sparkSession
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def with_row(docs: DataFrame, **columns: Column) -> DataFrame:
    """Whole rows as the struct `row`, and beside them the given columns; no name can clash with another."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *(c.alias(name) for name, c in columns.items()))


def prefixed(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names the operator uses; others can't clash with its own."""
    return docs.select(*(docs[old].alias(new) for new, old in columns.items()))

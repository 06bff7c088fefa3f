"""Tables that streaming jobs append to, one folder per micro-batch.

A batch that is run again after a failure overwrites its own folder, so every batch
counts once. Nothing is ever rewritten in place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def earlier_batches(spark: SparkSession, path: str, schema: str, batch: int) -> DataFrame:
    """Rows written before `batch`. Every batch writes its folder, an empty one too."""
    if batch == 0:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch int").parquet(path)
    return rows.where(F.col("batch") < batch).drop("batch")


def run_available(
    df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append"
) -> StreamingQuery:
    """Process what is there, batch by batch, and stop."""
    query = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(each)
        .start()
    )
    query.awaitTermination()
    return query

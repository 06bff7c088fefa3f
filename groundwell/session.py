"""Session helpers: local sessions for tests and bench, shared scratch space, size checks."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a table may have before it stops being a broadcast candidate.
BROADCAST_ROWS = 100_000


def local_session(app: str, cores: int | str = 8, memory: str = "12g") -> SparkSession:
    """A local[*] session. Cluster jobs bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    Where neither `spark.checkpoint.dir` (at launch) nor `setCheckpointDir` names one, a local
    session gets a folder of its own; a cluster does not, as its executors share none.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"{master}: set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(os.environ.get("TMPDIR", "/tmp"), "groundwell"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write `df` and go on with what was written."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """A result that several later steps read, written once to the shared scratch space.

    It survives the loss of executors, and as a table its size is known: joins broadcast
    it by themselves if it is small enough.
    """
    return write_table(df, scratch_dir(df.sparkSession, name))


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Count at most `max_rows + 1` rows to decide whether `df` may be broadcast."""
    return df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows


def narrow(big: DataFrame, few: DataFrame, keys: list[str], bounded: bool) -> DataFrame:
    """Rows of `big` whose key occurs in `few`. With a bound on `few`, its keys are broadcast
    and `big` is not shuffled."""
    wanted = few.select(*keys).distinct()
    return big.join(F.broadcast(wanted) if bounded else wanted, keys, "left_semi")


def scan_partitions(scan: DataFrame, growth: int = 4) -> int:
    """Shuffle partitions for a plain table scan: `growth` per input split, as splits follow the
    bytes of the input, and one per core at least."""
    context = scan.sparkSession.sparkContext
    return max(context.defaultParallelism, growth * scan.rdd.getNumPartitions())


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A table scan with fewer splits than cores (a small or single file), spread over the
    cores by `key` before heavy work. A scan with splits enough stays where it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)

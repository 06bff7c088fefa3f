"""Running totals along an integer position, for groups too long for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def running_total(
    df: DataFrame, keys: list[str], position: str, value: str, name: str, *, newest_first: bool = False
) -> DataFrame:
    """Adds `name`: the total of `value` up to and including each row.

    The rows of a group are cut into blocks of BLOCK positions; only block totals are
    ordered per group, the rows themselves per block.
    """
    sign = -1 if newest_first else 1
    block = F.floor(F.col(position) / F.lit(float(BLOCK)))
    df = df.withColumn("_block", block)
    totals = df.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy(sign * F.col("_block")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_block", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"))
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(sign * F.col(position))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        df.join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_offset") + F.sum(value).over(inside))
        .drop("_block", "_offset")
    )

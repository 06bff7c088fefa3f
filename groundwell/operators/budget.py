"""Which rows get one of a limited number of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_group(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows per group. Every task cuts its own rows to the limit before
    they are shuffled, so a large group stays cheap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def mark_selected(df: DataFrame, keys: list[str], row_id: str, order: list[Column], limit: int, name: str) -> DataFrame:
    """All rows with a flag on the first `limit` per group; a limit of 0 or less flags all."""
    if limit <= 0:
        return df.withColumn(name, F.lit(True))
    chosen = best_per_group(df, keys, order, limit).select(row_id).withColumn(name, F.lit(True))
    return df.join(chosen, row_id, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def by_size(lines: str, files: str, diff_length: str, position: str) -> list[Column]:
    """Largest change first: lines, then files, then diff length, then batch order."""
    return [F.desc(lines), F.desc(files), F.desc(diff_length), F.asc(position)]

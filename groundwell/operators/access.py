"""Access rules. A NULL task list means "no task limit", an empty one "unassigned chunks only"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allowed(tasks: Column, can_view: Column, task_id: Column, sensitivity: Column) -> Column:
    """Whether a request may see a chunk. Never NULL for a non-NULL sensitivity."""
    by_task = (
        tasks.isNull() | task_id.isNull() | F.coalesce(F.array_contains(tasks, task_id), F.lit(False))
    )
    return by_task & (F.coalesce(can_view, F.lit(False)) | (sensitivity != "restricted"))


def unrestricted(tasks: Column, can_view: Column) -> Column:
    """True only for a request without a task limit that may see restricted chunks."""
    return tasks.isNull() & F.coalesce(can_view, F.lit(False))


def visible_pairs(candidates: DataFrame, requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates (query_id, chunk_id, ...) that their request may see. Candidates without
    a chunk row are dropped."""
    marks = chunks.select("chunk_id", "task_id", "sensitivity_level")
    who = requests.select("query_id", "accessible_task_ids", "can_view_restricted")
    rule = allowed(
        F.col("accessible_task_ids"), F.col("can_view_restricted"), F.col("task_id"), F.col("sensitivity_level")
    )
    return candidates.join(marks, "chunk_id").join(who, "query_id").where(rule).select(*candidates.columns)


def still_valid(entries: DataFrame, citations: DataFrame, requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cached answers (query_id, entry_id) whose cited chunks the request may all still see.

    citations: entry_id, chunk_id. A cited chunk that is gone also makes the answer
    invalid. An answer without citations is valid.
    """
    cited = entries.select("query_id", "entry_id").join(citations, "entry_id")
    good = visible_pairs(cited, requests, chunks).groupBy("query_id", "entry_id").agg(
        F.count_distinct("chunk_id").alias("good")
    )
    total = cited.groupBy("query_id", "entry_id").agg(F.count_distinct("chunk_id").alias("cited"))
    broken = total.join(good, ["query_id", "entry_id"], "left").where(
        F.coalesce("good", F.lit(0)) < F.col("cited")
    )
    return entries.join(broken, ["query_id", "entry_id"], "left_anti")

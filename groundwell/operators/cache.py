"""Semantic answer cache over tables of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions.text import is_blank
from groundwell.operators import vectors
from groundwell.operators.budget import best_per_group

# Similarity for a direct hit and for a candidate, lifetime, entries per workspace.
DIRECT, CANDIDATE, TTL_SECONDS, MAX_ENTRIES = 0.95, 0.86, 3600.0, 500


def namespace(workspace: Column, role: Column, tasks: Column, can_view: Column, prompt: Column, model: Column) -> Column:
    """Isolation key as text. No task limit and an empty task list are different keys."""
    return F.to_json(
        F.struct(
            workspace.alias("w"), role.alias("r"), F.array_sort(tasks).alias("t"), can_view.alias("v"),
            prompt.alias("p"), model.alias("m"),
        ),
        {"ignoreNullFields": "false"},
    )


def lookup(
    requests: DataFrame,
    entries: DataFrame,
    *,
    direct: float = DIRECT,
    floor: float | None = CANDIDATE,
    ttl: float = TTL_SECONDS,
    small_queries: bool | None = None,
) -> DataFrame:
    """Best live entry per request: query_id, entry_id, similarity, outcome.

    requests: query_id, namespace, vector, at (seconds); entries: entry_id (ascending with
    age), namespace, vector, at. An entry as old as the lifetime is still live, one stored
    after the request is not found. Ties go to the older entry. The outcome is `direct`, `candidate` or `miss`; without a floor there
    are no candidates.
    """
    best = vectors.top_k(
        requests.select("query_id", F.col("namespace").alias("grp"), "vector", F.col("at").cast("double").alias("at")),
        entries.select(
            F.col("entry_id").alias("item_id"), F.col("namespace").alias("grp"), "vector",
            F.col("at").cast("double").alias("at"),
        ),
        1,
        max_age=ttl,
        small_queries=small_queries,
    )
    lowest = direct if floor is None or floor > direct else floor
    near = F.col("similarity") >= lowest
    return requests.select("query_id").join(best, "query_id", "left").select(
        "query_id",
        F.when(near, F.col("item_id")).alias("entry_id"),
        F.when(near, F.col("similarity")).alias("similarity"),
        F.when(F.col("similarity") >= direct, "direct").when(near, "candidate").otherwise("miss").alias("outcome"),
    )


def keep_recent(entries: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Entries that survive eviction: the most recently used per workspace, over all namespaces."""
    return best_per_group(entries, ["workspace_id"], [F.desc("last_used"), F.desc("entry_id")], max_entries).drop("place")


def sizes(entries: DataFrame) -> DataFrame:
    """Entries per workspace, over all namespaces: workspace_id, stored."""
    return entries.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("stored"))


def storable(cached: Column, first_turn: Column, groundable: Column, reason: Column, answer: Column) -> Column:
    """Whether an answer may enter the cache."""
    return ~cached & first_turn & groundable & reason.isNull() & ~is_blank(F.coalesce(answer, F.lit("")))


def band_warning(direct: Column, candidate: Column) -> Column:
    """Warning for thresholds that leave no room for candidates; NULL when there is room."""
    text = lambda sign, end: F.concat(
        F.lit("semantic cache verify never runs: candidate_threshold("), candidate.cast("string"),
        F.lit(f") {sign} threshold("), direct.cast("string"), F.lit(f"); {end}"),
    )
    return F.when(candidate > direct, text(">", "no candidate band")).when(
        candidate == direct, text("==", "candidate band is empty")
    )

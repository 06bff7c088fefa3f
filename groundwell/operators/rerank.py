"""Applying a model's ranking to retrieved candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_ids(reply: Column) -> Column:
    """Integers of `{"ranking": [...]}` or of a bare array; NULL if the reply is neither."""
    value = F.try_parse_json(reply)
    kind = F.schema_of_variant(value)
    listed = F.when(kind.startswith("OBJECT"), F.try_variant_get(value, "$.ranking", "array<variant>")).when(
        kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")
    )
    # Booleans, strings and fractions are no candidate numbers.
    whole = F.filter(listed, lambda v: F.schema_of_variant(v) == "BIGINT")
    return F.transform(whole, lambda v: F.try_variant_get(v, "$", "long"))


def apply_ranking(hits: DataFrame, replies: DataFrame, k: int, *, enabled: bool = True) -> DataFrame:
    """Top k candidates per request in the order of the reply, and a `stage`.

    hits: query_id, rank (from 1, without gaps: the list the model was shown, as hydrated), ...;
    replies: query_id, reply, error (reason or NULL).
    Numbers count from 1; repeated ones and ones out of range are dropped, and the
    remaining places are filled in the order the candidates came. A request without a
    usable reply keeps its order.
    """
    count = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    sized = hits.withColumn("n", count)
    if not enabled:
        return sized.where(F.col("rank") <= k).withColumn("stage", F.lit("disabled")).withColumn(
            "new_rank", F.col("rank")
        ).drop("n")
    told = replies.select("query_id", "error", ranking_ids(F.col("reply")).alias("ids"))
    # No distinct needed: array_position finds the first mention.
    joined = sized.join(told, "query_id", "left").withColumn("pos", F.array_position("ids", F.col("rank").cast("long")))
    w = Window.partitionBy("query_id")
    usable = F.max(F.coalesce(F.col("pos"), F.lit(0))).over(w) > 0
    stage = (
        F.when(F.col("n") <= k, "skipped_few")
        .when(F.col("error").isNotNull(), F.concat(F.lit("fallback:"), F.col("error")))
        .when(~F.col("usable"), "fallback:parse")
        .otherwise("applied")
    )
    staged = joined.withColumn("usable", usable).withColumn("stage", stage)
    place = F.when((F.col("stage") == "applied") & (F.col("pos") > 0), F.col("pos"))
    order = w.orderBy(F.asc_nulls_last("place"), "rank")
    return (
        staged.withColumn("place", place)
        .withColumn("new_rank", F.row_number().over(order))
        .where(F.col("new_rank") <= k)
        .drop("n", "error", "ids", "pos", "usable", "place")
    )

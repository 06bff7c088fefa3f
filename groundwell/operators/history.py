"""Conversation history under a token budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions.text import ceil_tokens
from groundwell.operators.prefix import running_total

# Token budget, and the share of it the first turn may take to be kept.
BUDGET, FIRST_SHARE = 22_000, 0.3


def truncate(
    messages: DataFrame, budget: int = BUDGET, estimate: Callable[[Column], Column] = ceil_tokens
) -> DataFrame:
    """The messages (conv_id, turn, role, text) that are kept, with `tokens` and `truncated`.

    Newest first, messages are kept until the first one that no longer fits. The first two
    are kept in any case if together they take at most 30 % of the budget.
    """
    sized = messages.withColumn("tokens", estimate(F.coalesce("text", F.lit(""))))
    running = running_total(sized, ["conv_id"], "turn", "tokens", "spent", newest_first=True)
    # The two lowest turns of a conversation, as two aggregates of bounded state.
    first = F.min(F.struct("turn", "tokens"))
    heads = sized.groupBy("conv_id").agg(first.alias("a"), F.count(F.lit(1)).alias("n"))
    second = (
        sized.join(heads.select("conv_id", F.col("a.turn").alias("t0")), "conv_id")
        .where(F.col("turn") > F.col("t0"))
        .groupBy("conv_id")
        .agg(F.min(F.struct("turn", "tokens")).alias("b"))
    )
    opening = heads.join(second, "conv_id", "left").select(
        "conv_id",
        "n",
        F.coalesce("b.turn", "a.turn").alias("head_end"),
        (F.col("a.tokens") + F.coalesce("b.tokens", F.lit(0)) <= budget * FIRST_SHARE).alias("keep_head"),
    )
    kept = running.join(opening, "conv_id").where(
        (F.col("spent") <= budget) | (F.col("keep_head") & (F.col("turn") <= F.col("head_end")))
    )
    counts = kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("kept"))
    return (
        kept.join(counts, "conv_id")
        .withColumn("truncated", F.col("kept") < F.col("n"))
        .select("conv_id", "turn", "role", "text", "tokens", "truncated")
    )


def turns(messages: DataFrame) -> DataFrame:
    """Adds the turn number a request gets at this message (two messages make a turn) and
    whether it is the first."""
    counted = running_total(messages.withColumn("_one", F.lit(1)), ["conv_id"], "turn", "_one", "_upto")
    earlier = F.col("_upto") - 1
    return (
        counted.withColumn("turn_no", (F.floor(earlier / 2) + 1).cast("long"))
        .withColumn("is_first_turn", earlier == 0)
        .drop("_one", "_upto")
    )

"""Mixing sources to target weights by thresholds on a hash of the document id.

Each source takes all of its documents as often as its target holds them whole, and once more
those whose hash lies below a threshold. The threshold is found in nested histograms: words are
summed by source and hash bucket, and only the bucket in which the budget runs out is split by the
next bits. Documents are never sorted; the histogram of a source has a bounded number of rows, and
sums are combined before the shuffle, so that a source may hold any share of the rows. As the
threshold of a smaller budget lies below that of a larger one, smaller mixes are part of larger ones.

Defined cases: a null text has no words; a null source is a source of its own, the last; a null id
hashes as the empty string; rows with the same id are taken or left together; a source without
words has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundwell.llm.tables import is_small, prefixed, stored, with_row

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash, of which each histogram resolves some.
HASH_BITS, LEVEL_BITS = 60, 12


@dataclass(frozen=True)
class Mix:
    """Weights go to the sources in order, again and again; `share` of all words is dealt out, and
    no source gets more than `cap` times what it has."""

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    cap: float = 2.0


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def id_hash(doc_id: Column) -> Column:
    """The first 60 bits of the id's MD5, as a number."""
    digits = F.left(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(HASH_BITS // 4))
    return F.conv(digits, 16, 10).cast("bigint")


def _ranked(totals: DataFrame) -> DataFrame:
    """Adds `_rank` from 0 by code point, null last. Sources are ordered in ranges, not in one task."""
    ranges = int(totals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = totals.repartitionByRange(ranges, F.asc_nulls_last("source")).withColumn("_part", F.spark_partition_id())
    parts = stored(parts, "source-ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(F.asc_nulls_last("source"))
    return parts.join(F.broadcast(starts), "_part").select(
        "source", "source_size", (F.row_number().over(inside) - 1 + F.col("_start")).alias("_rank")
    )


def targets(sized: DataFrame, mix: Mix) -> DataFrame:
    """source, source_size, target. What is above a cap is dealt to the others by weight, until nothing is."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = F.array(*(F.lit(float(w)) for w in mix.weights))
    known = stored(
        _ranked(totals).select(
            "source", "source_size", F.get(listed, (F.col("_rank") % len(mix.weights)).cast("int")).alias("_weight")
        ),
        "sources",
    )
    everything, weights = known.agg(F.sum("source_size"), F.sum("_weight")).first()
    cap, part = F.lit(mix.cap) * F.col("source_size"), 0.0
    capped, heavy = 0, 0.0
    while everything and weights > heavy:
        each = (mix.share * everything - mix.cap * capped) / (weights - heavy)
        full = cap <= F.lit(each) * F.col("_weight")
        now, weight = known.agg(F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(full, F.col("_weight")))).first()
        part, done = each, (weight or 0.0) == heavy
        capped, heavy = now or 0, weight or 0.0
        if done:
            break
    # Once everything is at its cap, `part` lets each have it.
    return known.select("source", "source_size", F.least(cap, F.lit(part) * F.col("_weight")).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Adds to `goals` how often a source is taken whole, and below which hash once more."""
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    open_ = goals.select(
        "source",
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"),
        F.lit(0).cast("bigint").alias("prefix"),
    )
    cuts, found = goals.select("source", "whole", "source_size", "target"), []
    rows, few = sized.select("source", "size", "hash"), is_small(goals)
    for bits in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        shift = HASH_BITS - bits
        small = F.broadcast if few else (lambda x: x)
        at = F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix")
        inside = rows.join(small(open_.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")) & at)
        sums = inside.groupBy("source", "left", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi")
        )
        along = Window.partitionBy("source").orderBy("bucket")
        over = sums.withColumn("upto", F.sum("n").over(along)).where(F.col("upto") > F.col("left"))
        # The first bucket that does not fit.
        edge = over.groupBy("source").agg(F.min_by(F.struct("bucket", "lo", "hi", (F.col("left") - F.col("upto") + F.col("n")).alias("left")), "bucket").alias("e"))
        edge = stored(edge.select("source", "e.*"), "boundary")
        # One hash is not split further; a bucket that goes on is not yet decided.
        found.append(edge.where(F.col("lo") == F.col("hi")).select("source", F.col("lo").alias("below")))
        open_ = edge.where(F.col("lo") < F.col("hi")).select("source", "left", F.col("bucket").alias("prefix"))
        if open_.isEmpty():
            break
    known = found[0]
    for more in found[1:]:
        known = known.unionByName(more)
    known = known.withColumnRenamed("source", "_s")
    # A source without a boundary fits whole; its hashes all lie below.
    return (
        cuts.join(known, F.col("source").eqNullSafe(F.col("_s")), "left")
        .withColumn("below", F.coalesce("below", F.lit(1 << HASH_BITS)))
        .drop("_s")
    )


def copies(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Adds source_size, target and how often each row is taken."""
    cuts = stored(thresholds(sized, goals), "thresholds")
    cuts = F.broadcast(cuts) if is_small(cuts) else cuts
    met = sized.join(cuts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    once_more = (F.col("hash") < F.col("below")).cast("bigint")
    return met.withColumn("copies", F.col("whole") + once_more).drop("_s", "whole", "below")


def mix_sources(
    docs: DataFrame, mix: Mix = Mix(), *, doc_id: str = "doc_id", source: str = "source", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and taken (words in the mix)."""
    narrow = prefixed(docs, doc_id=doc_id, source=source, text=text)
    sized = stored(
        narrow.select("doc_id", "source", count_words(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("hash")),
        "sizes",
    )
    return copies(sized, targets(sized, mix)).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken")
    )


def repeat_documents(
    docs: DataFrame, mix: Mix = Mix(), *, doc_id: str = "doc_id", source: str = "source", text: str = "text"
) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns."""
    rows = with_row(docs, source=docs[source], size=count_words(docs[text]), hash=id_hash(docs[doc_id]))
    sized = stored(rows.drop("row"), "sizes")
    cuts = stored(thresholds(sized, targets(sized, mix)), "thresholds").withColumnRenamed("source", "_s")
    cuts = F.broadcast(cuts) if is_small(cuts) else cuts
    met = rows.join(cuts, F.col("source").eqNullSafe(F.col("_s")))
    # A document without words fits any threshold; it is not repeated more often than others may be.
    times = F.least(F.col("whole") + (F.col("hash") < F.col("below")).cast("bigint"), F.lit(math.floor(mix.cap)))
    return met.where(times > 0).select("row", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select("row.*")

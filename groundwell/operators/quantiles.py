"""Exact interpolated percentiles per group, without gathering or shuffling a group.

A first pass counts rows per narrow logarithmic bucket of the value, of which a group has
a bounded number. The few buckets that hold a wanted rank are known after it. One that holds
many rows, as where all values lie close together, is cut into equal parts between its least and
greatest value, again and again, until the part that holds the rank is small or a single value.
Only rows of such parts leave the last pass to be counted and sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.session import materialize

# Buckets per doubling of the value: a bucket is 0.14 % wide.
PER_OCTAVE = 512
# Rows a part may have to be sorted, and parts that a larger one is cut into. A bucket has at most
# 2^44 different doubles, so LEVELS cuts leave a single value; NaN alone cannot be cut.
SORTED, PARTS, LEVELS = 500_000, 4096, 6


def _bucket(v: Column) -> Column:
    """Monotone bucket number on both sides of zero; 1100 octaves cover every double."""
    size = (F.floor(F.log2(F.abs(v)) * PER_OCTAVE) + 1100 * PER_OCTAVE).cast("long")
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("long"))


def _wanted(total: Column, probs: dict[str, float]) -> Column:
    """array<struct<name, rank, weight>>: the one or two ranks each percentile is made of."""
    parts = []
    for name, p in probs.items():
        at = (total - 1) * F.lit(float(p))
        low = F.floor(at)
        for rank, weight in ((low, F.lit(1.0) - (at - low)), (low + 1, at - low)):
            parts.append(
                F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank"), weight.alias("weight"))
            )
    return F.filter(F.array(*parts), lambda w: w["weight"] > 0)


def _held(start: Column, n: Column) -> Column:
    """The wanted ranks among `n` rows that begin at rank `start`."""
    return F.filter(F.col("wanted"), lambda w: (w["rank"] >= start) & (w["rank"] < start + n))


def _spans() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]


def _cut(rows: DataFrame, wide: DataFrame) -> DataFrame:
    """The parts of the `wide` spans that hold a wanted rank."""
    bounds = wide.select("k", "b", F.col("lo").alias("from"), F.col("hi").alias("to"))
    share = (F.col("v") - F.col("from")) / (F.col("to") - F.col("from"))
    parts = (
        rows.join(bounds, ["k", "b"])
        .where(F.col("v").between(F.col("from"), F.col("to")))
        .groupBy("k", "b", "from", F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).alias("part"))
        .agg(*_spans())
    )
    along = Window.partitionBy("k", "b", "from").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    held = wide.select("k", "b", F.col("lo").alias("from"), F.col("start").alias("base"), "wanted")
    found = (
        parts.withColumn("before", F.sum("n").over(along) - F.col("n"))
        .join(held, ["k", "b", "from"])
        .withColumn("start", F.col("base") + F.col("before"))
        .withColumn("wanted", _held(F.col("start"), F.col("n")))
    )
    return materialize(found.where(F.size("wanted") > 0).select("k", "b", "start", "wanted", "n", "lo", "hi"))


def _narrowed(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """`picks` with every span of many rows replaced by its small parts that hold the wanted ranks."""
    done, wide = [], (F.col("n") > SORTED) & (F.col("lo") < F.col("hi"))
    for _ in range(LEVELS):
        if picks.where(wide).isEmpty():
            break
        done.append(picks.where(~wide))
        picks = _cut(rows, picks.where(wide))
    return reduce(DataFrame.unionByName, done, picks)


def percentiles(df: DataFrame, keys: list[str], value: Column, probs: dict[str, float]) -> DataFrame:
    """One row per group that has a value: *keys and one column per name in `probs`.

    Ranks interpolate linearly, as `percentile` does. NULL values are left out, NULL keys
    form a group. `df` is read twice, and once more per cut where values lie close together.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.select(key.alias("k"), value.cast("double").alias("v")).where(F.col("v").isNotNull())
    rows = rows.withColumn("b", _bucket(F.col("v")))

    group = Window.partitionBy("k")
    upto = F.sum("n").over(group.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    counts = rows.groupBy("k", "b").agg(*_spans())
    ranked = counts.select("k", "b", "n", "lo", "hi", (upto - F.col("n")).alias("start"), F.sum("n").over(group).alias("total"))

    def touched(p: float) -> Column:
        """Whether the bucket holds one of the two ranks around a percentile."""
        low = F.floor((F.col("total") - 1) * F.lit(float(p)))
        return (low + 1 >= F.col("start")) & (low < F.col("start") + F.col("n"))

    near = reduce(lambda x, y: x | y, (touched(p) for p in probs.values()))
    # At most three buckets per percentile and group, written as a table of known size.
    picks = materialize(
        ranked.where(near)
        .withColumn("wanted", _wanted(F.col("total"), probs))
        .withColumn("wanted", _held(F.col("start"), F.col("n")))
        .where(F.size("wanted") > 0)
        .select("k", "b", "start", "wanted", "n", "lo", "hi")
    )
    picks = _narrowed(rows, picks).drop("n")
    counted = (
        rows.join(picks.select("k", "b", "lo", "hi"), ["k", "b"])
        .where(F.col("v").between(F.col("lo"), F.col("hi")))
        .groupBy("k", "b", "lo", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    inside = Window.partitionBy("k", "b", "lo").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("start") + F.sum("n").over(inside) - F.col("n")
    found = (
        counted.join(picks, ["k", "b", "lo"])
        .withColumn("first", first)
        .select("k", "v", F.inline(_held(F.col("first"), F.col("n"))))
    )
    out = found.groupBy("k").agg(
        *(F.sum(F.when(F.col("name") == n, F.col("v") * F.col("weight"))).alias(n) for n in probs)
    )
    return out.select(*(F.col(f"k.{c}").alias(c) for c in keys), *probs)

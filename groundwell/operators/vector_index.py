"""A kept table of unit vectors in cells around pivots, searched exactly.

Every vector lies in the cell of its nearest pivot. Angles obey the triangle inequality: with the angle
of a request to a pivot and the least and greatest angle of a cell's vectors to it, no vector of the cell
can be more similar than the cosine of the gap. A search first compares each request with the cells of its
highest bounds, until they hold k vectors, and then with those other cells whose bound reaches the k-th
similarity found. Cells that no request visits are not read: each is a folder of its own.

How much is left out depends on the data: vectors in clusters lie in few cells, random directions of many
dimensions have bounds that reach everywhere, and then all cells are read, as without the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.functions.vector import as_double, normalize
from groundwell.operators import vectors
from groundwell.session import materialize

CELLS = 64
# Vectors that pivots are chosen from: those of the least hashes of their ids. The choice decides on the
# pruning only, never on a result.
SAMPLE = 4_096
# What rounding may cost an angle (an arc cosine near 1 is good to 1.5e-8) and a similarity.
ANGLE_SLACK, TIE = 1e-7, 10.0**-vectors.TIE_DIGITS


def _units(df: DataFrame, key: str) -> DataFrame:
    return df.where("vector IS NOT NULL").select(key, "grp", normalize(as_double(F.col("vector"))).alias("unit"))


def _pivots(units: DataFrame, cells: int) -> np.ndarray:
    """Vectors far from each other: each is the one farthest from those before it."""
    sample = units.orderBy(F.xxhash64("item_id"), "item_id").select("unit").limit(max(SAMPLE, cells)).toArrow()
    m = vectors.matrix(sample.column("unit"))
    m = m[np.linalg.norm(m, axis=1) > 0.0]
    chosen, nearest = [], np.full(len(m), -np.inf)
    while len(chosen) < min(cells, len(m)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, m @ m[chosen[-1]])
        if nearest.min() > 1.0 - TIE:
            break
    return m[chosen]


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def build(items: DataFrame, path: str, cells: int = CELLS) -> VectorIndex:
    """Write the index of `items` (item_id LONG, grp STRING, vector). Rows without a vector are left out;
    zero vectors, similar to nothing, have a cell of their own."""
    spark, units = items.sparkSession, _units(items, "item_id")
    pivots = _pivots(units, cells)
    shared = spark.sparkContext.broadcast(pivots)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = vectors.matrix(batch.column("unit"))
            cell, angle = np.full(len(unit), len(shared.value), np.int32), np.zeros(len(unit))
            there = np.linalg.norm(unit, axis=1) > 0.0
            if there.any():
                angles = _angles(unit[there], shared.value)
                cell[there], angle[there] = angles.argmin(axis=1), angles.min(axis=1)
            columns = [*batch.columns, pa.array(angle), pa.array(cell)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "angle", "cell"])

    rows = units.mapInArrow(placed, "item_id long, grp string, unit array<double>, angle double, cell int")
    rows = rows.hint("rebalance", "cell").sortWithinPartitions("cell", "grp")
    rows.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    bounds = VectorIndex.rows_at(spark, path).groupBy("grp", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")
    )
    bounds.write.mode("overwrite").parquet(f"{path}/bounds")
    kept = [(i, p.tolist()) for i, p in enumerate(pivots)]
    spark.createDataFrame(kept, "cell int, unit array<double>").write.mode("overwrite").parquet(f"{path}/pivots")
    return VectorIndex(spark, path)


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        #: One row per cell, so at most as many as the index was built with.
        self.pivots = vectors.matrix(spark.read.parquet(f"{path}/pivots").orderBy("cell").toArrow().column("unit"))

    @staticmethod
    def rows_at(spark: SparkSession, path: str) -> DataFrame:
        schema = "item_id long, grp string, unit array<double>, angle double, cell int"
        return spark.read.schema(schema).parquet(f"{path}/rows")

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """All vectors, or those of some cells, whose folders alone are read then."""
        rows = self.rows_at(self.spark, self.path)
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def top_k(self, queries: DataFrame, k: int) -> DataFrame:
        """As `vectors.top_k`: (query_id, item_id, similarity, vector_rank) of the k best vectors of each
        request's group. queries: query_id LONG, grp STRING, vector."""
        return vectors.ranked(self.search(queries, k)[0], k)

    def search(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(what was found, the visits (query_id, cell, n vectors, bound) it took)."""
        asked = materialize(self._asked(queries), "vector-requests")
        bounds = self.spark.read.parquet(f"{self.path}/bounds")
        a = F.get("angles", F.col("cell"))
        gap = F.greatest(F.lit(0.0), a - F.col("high"), F.col("low") - a) - ANGLE_SLACK
        # The cell of zero vectors has no pivot: its similarity is 0.
        bound = F.when(a.isNull(), 0.0).otherwise(F.cos(F.greatest(F.lit(0.0), gap)))
        cells = asked.join(bounds, "grp").select("query_id", "grp", "cell", "n", bound.alias("bound"), a.alias("a"))
        best_first = Window.partitionBy("query_id").orderBy(F.desc("bound"), F.asc_nulls_last("a"), "cell")
        before = F.sum("n").over(best_first.rowsBetween(Window.unboundedPreceding, -1))
        cells = materialize(cells.withColumn("first", F.coalesce(before, F.lit(0)) < k).drop("a"), "vector-cells")
        first = cells.where("first")
        found = materialize(self._compared(asked, first, k), "vector-found")
        reached = vectors.ranked(found, k).groupBy("query_id").agg(
            F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("reached")
        )
        worth = F.col("reached").isNull() | (F.col("bound") + TIE >= F.col("reached"))
        rest = materialize(cells.where("NOT first").join(reached, "query_id", "left").where(worth).drop("reached"), "vector-rest")
        visits = first.unionByName(rest).select("query_id", "cell", "n", "bound")
        return found.unionByName(self._compared(asked, rest, k)), visits

    def _asked(self, queries: DataFrame) -> DataFrame:
        pivots = self.spark.sparkContext.broadcast(self.pivots)

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit = vectors.matrix(batch.column("unit"))
                angles = _angles(unit, pivots.value) if len(unit) and len(pivots.value) else np.zeros((len(unit), 0))
                offsets = np.arange(len(unit) + 1, dtype=np.int32) * angles.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(angles.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "angles"])

        return _units(queries, "query_id").mapInArrow(
            measured, "query_id long, grp string, unit array<double>, angles array<double>"
        )

    def _compared(self, asked: DataFrame, visits: DataFrame, k: int) -> DataFrame:
        """Requests and vectors meet by group and cell."""
        wanted = [r["cell"] for r in visits.select("cell").distinct().collect()]
        met = F.concat_ws(":", "cell", "grp").alias("grp")
        q = visits.select("query_id", "cell").join(asked, "query_id").select("query_id", met, "unit")
        v = self.rows(wanted).select("item_id", met, "unit")
        return vectors.compared(q, v, vectors._Best(k))

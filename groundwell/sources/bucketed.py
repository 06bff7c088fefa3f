"""Tables that are changed by key: rows lie in buckets by a hash of their key, a manifest names each bucket's folder.

A change reads and writes the buckets of the keys it brings and no others: their new rows go to a new
folder, and a new manifest, put in place by one rename, makes them the table. Until then, and if the
run fails, readers see the table as it was; a reader that began before goes on with the folders it
knows until `clean` deletes them. Of two changes at once the later rename fails and leaves no trace.
A bucket may hold a key with most rows of the table: files are cut by size, not one a bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from groundwell.sources import manifest


class BucketTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.version, state = manifest.latest(spark, self.path)
        self._load(state)

    def _load(self, state: dict) -> None:
        self.keys, self.buckets = state["keys"], state["buckets"]
        self.schema = StructType.fromJson(state["schema"])
        #: Folder of every bucket that has rows.
        self.folders = {int(k): v for k, v in state["folders"].items()}

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: list[str], buckets: int = 64) -> BucketTable:
        """A new table with the rows of `df`."""
        table = cls.__new__(cls)
        table.spark, table.path, table.version = df.sparkSession, path.rstrip("/"), -1
        table._load({"keys": keys, "buckets": buckets, "schema": df.schema.jsonValue(), "folders": {}})
        return table._commit(table._write(df))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.keys)), F.lit(self.buckets)).cast("int")

    def touched(self, df: DataFrame) -> list[int]:
        """The buckets of the keys of `df`: at most as many numbers as there are buckets."""
        return sorted(r["b"] for r in df.select(self.bucket().alias("b")).distinct().collect())

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        wanted = self.folders if buckets is None else self.folders.keys() & set(buckets)
        paths = [f"{self.path}/{self.folders[b]}" for b in sorted(wanted)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def update(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> BucketTable:
        """The table after `merge(old, new)` took the place of the touched buckets' old rows. What it returns must
        have the columns of the table and only keys of those buckets."""
        touched = self.touched(new)
        written = self._write(merge(self.read(touched), new).select(*self.schema.names))
        return self._commit({b: f for b, f in self.folders.items() if b not in touched} | written)

    def replace(self, new: DataFrame) -> BucketTable:
        """All old rows of every key that `new` brings go, its rows come."""
        return self.update(new, lambda old, rows: old.join(rows.select(*self.keys).distinct(), self.keys, "left_anti").unionByName(rows))

    def delete(self, gone: DataFrame) -> BucketTable:
        return self.update(gone, lambda old, rows: old.join(rows.select(*self.keys).distinct(), self.keys, "left_anti"))

    def clean(self, keep: int = 2) -> None:
        """Deletes manifests but the last `keep`, and the folders that none of those names."""
        names = manifest.names(self.spark, self.path)
        live = {f for n in names[-keep:] for f in manifest.state(self.spark, self.path, n)["folders"].values()}
        for name in names[:-keep]:
            self._delete(f"manifest/{name}")
        for run in self._list("data"):
            for part in self._list(f"data/{run}"):
                if f"data/{run}/{part}" not in live:
                    self._delete(f"data/{run}/{part}")

    def _write(self, df: DataFrame) -> dict[int, str]:
        """Folders of the buckets that `df` has rows of."""
        folder = f"data/{uuid.uuid4().hex}"
        rows = df.withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket")
        rows.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        parts = [f for f in self._list(folder) if f.startswith("_bucket=")]
        return {int(f.partition("=")[2]): f"{folder}/{f}" for f in parts}

    def _commit(self, folders: dict[int, str]) -> BucketTable:
        state = {"keys": self.keys, "buckets": self.buckets, "schema": self.schema.jsonValue(), "folders": folders}
        manifest.commit(self.spark, self.path, self.version + 1, state)
        return BucketTable(self.spark, self.path)

    def _list(self, folder: str) -> list[str]:
        return manifest.listed(self.spark, f"{self.path}/{folder}")

    def _delete(self, name: str) -> None:
        manifest.delete(self.spark, f"{self.path}/{name}")


def table_at(spark: SparkSession, path: str) -> BucketTable | None:
    """The table at `path`, if there is one."""
    try:
        return BucketTable(spark, path)
    except FileNotFoundError:
        return None

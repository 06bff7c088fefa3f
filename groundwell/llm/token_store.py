"""Token ids as files: frequency-ranked, in byte-aligned variable length, with separate control bytes.

Ids are replaced by their rank in the counts of the whole corpus, so that frequent ones take one
byte. A rank takes 1 to 4 bytes, little end first; a control byte holds the lengths of four ranks,
two bits each, the first in the lowest bits. Control and data bytes are kept apart, so a reader
gets all lengths from a 256-row table before it touches the data.

A store is a folder of two Parquet tables: `ranks` (rank, id) and `ids` (shard, seq, doc_id,
n_tokens, control, data), a folder per shard. Shards are ranges of ascending ids, `seq` is the
place in the shard. Parquet is written by Spark's committer, so lost tasks leave nothing behind,
and the folder may be on any file system.

Defined cases: a null text counts as empty and has the end id only; null ids come first; rows with
the same id are ordered by a hash of their text; an empty table gives an empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundwell.llm import words as w
from groundwell.llm.pieces import default_path, encoder
from groundwell.llm.tables import drop, prefixed, stored, writing
from groundwell.session import scratch_dir

END_ID = 0
IDS = "seq long, doc_id long, n_tokens long, control binary, data binary, shard int"
#: For every control byte the lengths of its four ranks.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    used = np.arange(4) < size[:, None]
    return control.astype(np.uint8).tobytes(), ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(size)
    begin, raw = ends - size, np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    out = raw[begin]
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        out[longer] |= raw[begin[longer] + k] << np.uint32(8 * k)
    return out


def _encoded(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in w.blocks(batches, "text"):
            ids, first = encoder(path).encode(*w.buffers(batch.column("text")))
            kind = np.uint16 if len(encoder(path).size) <= 1 << 16 else np.uint32
            raw = [np.append(ids[a:b], END_ID).astype(kind).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            order = pa.array(np.arange(seq, seq + len(raw)))
            wide = pa.array(np.full(len(raw), np.dtype(kind).itemsize, np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), order, batch.column("doc_id"), wide, pa.array(raw, pa.binary())],
                ["shard", "seq", "doc_id", "wide", "ids"],
            )
            seq += len(raw)

    return run


def _ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for wide, raw in zip(batch.column("wide").to_pylist(), batch.column("ids"), strict=True):
        yield np.frombuffer(raw.as_py(), f"<u{wide}")


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for batch in batches:
        for ids in _ids(batch):
            found = np.bincount(ids, minlength=len(total))
            found[: len(total)] += total
            total = found
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])


def _packed(rank_of: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, control, data = [], [], []
            for ids in _ids(batch):
                one, two = pack(rank_of[ids])
                sizes.append(len(ids))
                control.append(one)
                data.append(two)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("shard", "seq", "doc_id")), pa.array(sizes, pa.int64()), pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                ["shard", "seq", "doc_id", "n_tokens", "control", "data"],
            )

    return run


def write_store(
    docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None
) -> None:
    """Encode all documents and write them to the folder `path`.

    The texts are dealt to ranges of ids before they are encoded, so only they are shuffled. The
    counts and the ranks have a row per id of the vocabulary.
    """
    spark = docs.sparkSession
    narrow = prefixed(docs, doc_id=doc_id, text=text)
    narrow = narrow.withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("tie", F.xxhash64("text"))
    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    encoded = ranged.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(
        _encoded(tokenizer or default_path()), "shard int, seq long, doc_id long, wide int, ids binary"
    )
    encoded = stored(encoded, "token-ids")
    counts = encoded.select("wide", "ids").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    listed = counts.orderBy(F.desc("n"), "id").select("id").toPandas()["id"].to_numpy(np.int64)
    rank_of = np.zeros(int(listed.max(initial=0)) + 1, np.uint32)
    rank_of[listed] = np.arange(len(listed), dtype=np.uint32)
    ranks = spark.createDataFrame([(rank, int(number)) for rank, number in enumerate(listed)], "rank int, id int")
    ranks.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")
    packed = encoded.mapInArrow(
        _packed(rank_of), "shard int, seq long, doc_id long, n_tokens long, control binary, data binary"
    )
    with writing(spark):
        packed.write.mode("overwrite").option("compression", "none").partitionBy("shard").parquet(f"{path}/ids")
    drop(encoded)


def _unpacked(by_rank: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [
                by_rank[unpack(c.as_py(), d.as_py(), n)].astype("<u4").tobytes()
                for c, d, n in zip(batch.column("control"), batch.column("data"), batch.column("n_tokens").to_pylist(), strict=True)
            ]
            keep = [batch.column(c) for c in ("shard", "seq", "doc_id", "n_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(ids, pa.binary()), pa.array([zlib.crc32(x) for x in ids], pa.int64())],
                ["shard", "seq", "doc_id", "n_tokens", "ids", "ids_crc32"],
            )

    return run


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """shard, seq, doc_id, n_tokens, ids (little-endian unsigned 32-bit) and ids_crc32 of every document."""
    by_rank = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy(np.uint32)  # a row per vocabulary id
    rows = spark.read.schema(IDS).parquet(f"{path}/ids").select("shard", "seq", "doc_id", "n_tokens", "control", "data")
    return rows.mapInArrow(
        _unpacked(by_rank), "shard int, seq long, doc_id long, n_tokens long, ids binary, ids_crc32 long"
    )


def starts(spark: SparkSession, path: str) -> DataFrame:
    """shard, seq and `start`, the ids of all documents before it. Running totals are taken inside a
    shard, and over one row per shard."""
    sizes = spark.read.schema(IDS).parquet(f"{path}/ids").select("shard", "seq", "n_tokens")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = totals.select("shard", F.coalesce(F.sum("n").over(before(Window.orderBy("shard"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("shard").orderBy("seq"))), F.lit(0))
    return sizes.join(F.broadcast(base), "shard").select("shard", "seq", (F.col("base") + inside).alias("start"))


def token_digests(docs: DataFrame, **columns: str) -> DataFrame:
    """Write a store to scratch space and read it back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "token-store")
    write_store(docs, path, **columns)
    read = read_store(spark, path).select("shard", "seq", "doc_id", "n_tokens", "ids_crc32")
    return read.join(starts(spark, path), ["shard", "seq"]).select("doc_id", "start", "n_tokens", "ids_crc32")

"""Substring dedup: words inside passages that also start earlier are removed.

Levels: a quarter, a half and the whole of the final length (5, 10 and 20 words). Of the half windows
it is enough to take one in every final window, the one with the least hash, and of the quarter windows
the least in each of those: equal windows choose equally. The quarter windows are counted by hash, and
only half windows that stand on a repeated one go on. Of these the half windows repeated at that length
are candidates; they are extended to twice the length and, first, to everything around them that a final
window can reach. Candidates with the same surroundings agree in all final windows they stand for, so
all but the first of them are repeats. What is left, first places whose half window also has other
surroundings, is extended window by window. No place that can hold a repeat is dropped at any level;
doubling ends at the final length, as longer repeats consist of repeated windows.

Hashes have 64 bits for candidates and 96 where they decide. Counts and first places are
aggregates combined before the shuffle; a passage in a third of all documents is one hot key of
an aggregate or of a join that adaptive execution splits. Documents are hashed in numpy from their
Arrow buffers.

Defined cases: a null text has no words; a text shorter than a window keeps all; a null id counts
as the smallest; rows with the same id are at the same place, so they don't repeat each other at one place;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm import words as w
from groundwell.llm.tables import drop, prefixed, stored

WINDOW = 20
#: Bases of the second, independent hash, and of the two of surroundings.
SECOND, AROUND = 0xC2B2AE3D27D4EB4F, (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


class Places:
    """Windows of the texts of a block and the half window each stands on."""

    def __init__(self, batch: pa.RecordBatch, window: int):
        self.half, self.window = window // 2, window
        self.quarter = min(self.half, max(1, window // 4))
        data, at = w.buffers(batch.column("text"))
        starts, ends, first = w.bounds(data, at)
        self.words, self.first = w.hashes(data, starts, ends), first
        self.text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        n = len(self.words)
        halves = w.windows(self.words, self.half)
        self.halves = halves
        # Final windows that lie in one text.
        self.begin = np.arange(max(0, n - window + 1))
        if len(self.begin):
            self.begin = self.begin[self.text[self.begin] == self.text[self.begin + window - 1]]
        least, self.anchor = halves[self.begin] if len(self.begin) else halves[:0], self.begin.copy()
        for step in range(1, window - self.half + 1):
            here = halves[self.begin + step]
            less = here < least
            least = np.where(less, here, least)
            self.anchor[less] = self.begin[less] + step

    def anchors(self) -> np.ndarray:
        """Chosen half windows, each once. They ascend with the windows."""
        return self.anchor[np.flatnonzero(np.diff(self.anchor, prepend=-1))]

    def seeds(self, anchors: np.ndarray) -> np.ndarray:
        """The least quarter window inside each chosen half window."""
        quarters = w.windows(self.words, self.quarter)
        least = quarters[anchors]
        for step in range(1, self.half - self.quarter + 1):
            least = np.minimum(least, quarters[anchors + step])
        return least

    def around(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words a window on the anchor can reach, and of where the anchor lies in them."""
        text = self.text[anchors]
        low = np.maximum(anchors - (self.window - self.half), self.first[text])
        high = np.minimum(anchors + self.window, self.first[text + 1])
        shape = (anchors - low).astype(np.uint64) * np.uint64(1 << 20) + (high - low).astype(np.uint64)
        out = []
        for base in AROUND:
            total = np.zeros(len(self.words) + 1, np.uint64)
            np.cumsum(self.words * w.powers(base, len(self.words)), out=total[1:])
            back = w.powers(w.inverse(base), len(self.words) + 1)
            out.append(w.mix((total[high] - total[low]) * back[low] + shape * np.uint64(base)))
        return out[0], out[1]

    def named(self, batch: pa.RecordBatch, places: np.ndarray) -> list[pa.Array]:
        """The id, the tie and the word number within the text of each place."""
        rows = self.text[places]
        number = pa.array((places - self.first[rows]).astype(np.int32))
        return [*(batch.column(c).take(pa.array(rows)) for c in ("id", "tie")), number]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _short(x: np.ndarray) -> pa.Array:
    return pa.array((x >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _quarters(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.blocks(batches, "text"):
            places = Places(batch, window)
            yield pa.RecordBatch.from_arrays([_signed(places.seeds(places.anchors()))], ["q"])

    return run


def _surroundings(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.blocks(batches, "text"):
            places = Places(batch, window)
            anchors = places.anchors()
            c1, c2 = places.around(anchors)
            seeds, halves = _signed(places.seeds(anchors)), _signed(places.halves[anchors])
            found = [seeds, halves, _signed(c1), _short(c2), *places.named(batch, anchors)]
            yield pa.RecordBatch.from_arrays(found, ["q", "h", "c1", "c2", "id", "tie", "place"])

    return run


def _flat(lists: pa.Array, first: np.ndarray, rows: int) -> np.ndarray:
    """Positions per text to places in the block; null lists count as empty."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    return lists.flatten().to_numpy() + np.repeat(first[:rows], sizes)


def _extended(window: int):
    """Both hashes of every window that stands on one of the given half windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.blocks(batches, "text"):
            places = Places(batch, window)
            wanted = np.zeros(len(places.words) + 1, bool)
            wanted[_flat(batch.column("open"), places.first, batch.num_rows)] = True
            begin = places.begin[wanted[places.anchor]]
            one, two = (w.windows(places.words, window, base)[begin] for base in (AROUND[0], SECOND))
            found = [_signed(one), _short(two), *places.named(batch, begin)]
            yield pa.RecordBatch.from_arrays(found, ["c1", "c2", "id", "tie", "place"])

    return run


def _removed(window: int):
    """doc_id, n_words, n_removed and the words that are left."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.blocks(batches, "text"):
            places = Places(batch, window)
            n, rows = len(places.words), batch.num_rows
            whole, single = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
            whole[_flat(batch.column("whole"), places.first, rows)] = True
            single[_flat(batch.column("single"), places.first, rows)] = True
            begin = places.begin[whole[places.anchor] | single[places.begin]]
            depth = np.zeros(n + 1, np.int64)
            np.add.at(depth, begin, 1)
            np.add.at(depth, begin + window, -1)
            keep = np.cumsum(depth[:n]) == 0
            size = np.diff(places.first)
            kept = np.add.reduceat(np.append(keep, False).astype(np.int64), places.first[:-1]) * (size > 0)
            texts = []
            for row, text in enumerate(batch.column("text").cast(pa.binary())):
                a, b = places.first[row], places.first[row + 1]
                listed = (text.as_py() or b"").split()
                if kept[row] < b - a:
                    listed = [x for x, k in zip(listed, keep[a:b].tolist(), strict=True) if k]
                texts.append(b" ".join(listed))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(size - kept), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "text"],
            )

    return run


def _first(places: DataFrame) -> DataFrame:
    return places.groupBy("c1", "c2").agg(F.min(F.struct("id", "place")).alias("first"))


def _later(places: DataFrame, first: DataFrame) -> DataFrame:
    """Places of which an equal one comes earlier."""
    return places.join(first, ["c1", "c2"]).where(F.struct("id", "place") > F.col("first")).select("id", "tie", "place")


def repeats(texts: DataFrame, window: int) -> DataFrame:
    """Per id and tie the half windows whose windows all start earlier elsewhere (`whole`), and single
    windows that do (`single`), as word numbers. texts: id, tie (tells texts of one id apart), text."""
    twice = lambda df, c: df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(c)
    known = stored(twice(texts.select("text").mapInArrow(_quarters(window), "q long"), "q"), "quarter-windows")
    around = texts.mapInArrow(_surroundings(window), "q long, h long, c1 long, c2 int, id long, tie int, place int")
    survivors = stored(around.join(known, "q", "left_semi").drop("q"), "half-windows")
    drop(known)
    candidates = stored(survivors.join(twice(survivors, "h"), "h", "left_semi"), "candidates")
    drop(survivors)
    first = stored(_first(candidates), "first-places")
    whole = stored(_later(candidates, first), "whole")
    # First places of different surroundings of one half window.
    chosen = candidates.join(first, ["c1", "c2"]).where(F.struct("id", "place") == F.col("first"))
    chosen = stored(chosen.select("h", "id", "tie", "place").distinct(), "chosen")
    many = chosen.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    open_ = chosen.join(many, "h", "left_semi").groupBy("id", "tie").agg(F.collect_set("place").alias("open"))
    open_ = stored(open_, "open")
    drop(candidates)
    drop(first)
    extended = texts.join(open_, ["id", "tie"])
    extended = extended.mapInArrow(_extended(window), "c1 long, c2 int, id long, tie int, place int")
    extended = stored(extended, "windows")
    single = stored(_later(extended, _first(extended)), "single")
    drop(extended)
    marks = whole.select("id", "tie", F.col("place").alias("whole"), F.lit(None).cast("int").alias("single")).unionByName(
        single.select("id", "tie", F.lit(None).cast("int").alias("whole"), F.col("place").alias("single"))
    )
    return marks.groupBy("id", "tie").agg(F.collect_set("whole").alias("whole"), F.collect_set("single").alias("single"))


def drop_repeats(docs: DataFrame, window: int = WINDOW, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and `text`, the words left joined by one space."""
    narrow = prefixed(docs, doc_id=doc_id, text=text)
    narrow = narrow.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("tie", F.hash("text"))
    marks = stored(repeats(narrow.select("id", "tie", "text"), window), "repeats")
    return narrow.join(marks, ["id", "tie"], "left").select("doc_id", "text", "whole", "single").mapInArrow(
        _removed(window), "doc_id long, n_words long, n_removed long, text string"
    )

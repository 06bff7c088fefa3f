"""Benchmark decontamination: passages within a share of edited words of a benchmark item.

The CGK embedding walks over a sequence with one random bit per step and symbol: the symbol at the
current place is written out and the place moves on if the bit is set. After an edit the walks of
two sequences soon fall into step again, so few edits become few differing coordinates. Symbols are
words here. Sampling a few coordinates of the embedding gives a hash; a window whose hash is that of
an item in one of the rounds is a candidate, and the number of rounds follows from the target
recall. Candidates are verified by the edit distance of the item to any stretch of words around the
window, so everything returned is exact, and exact copies are never missed.

The longer two walks are, the less they agree, so an item of more than STRETCH words is cut into
stretches of equal size that are walked each by itself: if at most a share of the item's words is
edited, that holds for one of its stretches at least.

Items are grouped by size and windows are as long as the smallest stretch of a group. A window is
walked only if enough of its words occur in the group's items at all, and enough of the words that
few items have: no match can fail that, as all but the allowed edits of the item's words are in it. Items come from the driver in blocks of
WORDS_AT_ONCE words, and each block is one pass over the documents, without a shuffle.

Defined cases: null texts and texts without words match nothing; an item of fewer than five words
must occur unchanged; a document is reported once for each item, with its best place, the first of
equals; repeated rows are reported one by one; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm import words as w
from groundwell.llm.tables import prefixed, stored, with_row

WORDS_AT_ONCE = 500_000
#: Bytes that end a word; A-Z are lower-cased.
GAP = np.zeros(256, bool)
GAP[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Items of a group differ in size by less than this factor.
GROUP = 1.2
#: Longest stretch of an item that is walked as one.
STRETCH = 80
#: Words in more than one of so many items are common.
COMMON = 50
#: Stands for what lies behind a text.
PAD = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Search:
    """A match may differ by `edits` of the item's words. Two embeddings at that distance agree in a
    coordinate with probability `agree` at least (measured); `samples` coordinates make a hash."""

    edits: float = 0.2
    recall: float = 0.99
    agree: float = 0.4
    samples: int = 2
    seed: int = 7

    @property
    def rounds(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.agree**self.samples))


def allowed(size: int, edits: float) -> int:
    return int(edits * size + 1e-9)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and the words before each text."""
    starts, ends, first = w.bounds(data, at, GAP)
    return w.hashes(LOWER[data], starts, ends), first


class Group:
    """Items of similar size with their hashes for every round."""

    def __init__(self, items: list[tuple[int, np.ndarray]], number: int, search: Search, common: set[int]):
        self.items = items
        self.listed = [x.tolist() for _, x in items]
        sizes = [len(x) for _, x in items]
        count = -(-max(sizes) // STRETCH)
        self.size = min(sizes) // count
        self.least = self.size - allowed(-(-max(sizes) // count), search.edits)
        self.vocabulary = np.unique(np.concatenate([x for _, x in items]))
        # Of its uncommon words a match has all but the allowed edits, within `reach`.
        uncommon = [sum(x not in common for x in listed) for listed in self.listed]
        self.least_uncommon = min(u - allowed(n, search.edits) for u, n in zip(uncommon, sizes, strict=True))
        self.uncommon = np.array([x for x in self.vocabulary.tolist() if x not in common], np.uint64)
        self.reach = max(sizes) + allowed(max(sizes), search.edits)
        # A window may be that of a later stretch: so far back a match can begin.
        self.back = 0 if count == 1 else self.reach
        # A walk is at half its steps; it should not run over the end of the item.
        self.steps = max(1, int(1.6 * self.size))
        rng = np.random.default_rng([search.seed, number])
        self.salts = rng.integers(0, 1 << 63, (search.rounds, self.steps), dtype=np.uint64)
        few = min(search.samples, self.steps)
        self.samples = [np.sort(rng.choice(self.steps, few, replace=False)) for _ in range(search.rounds)]
        flat = np.concatenate([x for _, x in items])
        ends = np.cumsum(sizes)
        # Item of each stretch, and its first word in the item.
        self.item = np.repeat(np.arange(len(items)), count)
        self.offset = (np.array(sizes)[:, None] * np.arange(count) // count).ravel()
        self.buckets = []
        for k in range(search.rounds):
            found = self.walk(flat, (ends - sizes)[self.item] + self.offset, ends[self.item], k)
            order = np.argsort(found, kind="stable")
            self.buckets.append((found[order], order))

    def walk(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        """Hash of the sampled coordinates of round `k`, for the sequences that begin at `begin`."""
        place, out = begin.copy(), np.zeros(len(begin), np.uint64)
        last = int(self.samples[k][-1])
        wanted = set(self.samples[k].tolist())
        for step in range(last + 1):
            here = np.where(place < end, words[np.minimum(place, len(words) - 1)], PAD)
            if step in wanted:
                out = w.mix(out + here + np.uint64(step))
            place += (w.mix(here ^ self.salts[k, step]) & np.uint64(1)).astype(np.int64)
        return out


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of `item` to a stretch of `text`, and where the first such stretch begins."""
    n, along = len(text), np.arange(len(text) + 1)
    cost, begin = np.zeros(n + 1, np.int64), along.copy()
    for row, word in enumerate(item):
        stay = np.concatenate([[row + 1], cost[:-1] + (text != word)])
        down = cost + 1
        new = np.minimum(stay, down)
        from_ = np.where(stay <= down, np.concatenate([[0], begin[:-1]]), begin)
        # Words of the text that the item lacks: carried along from the left.
        slack = new - along
        low = np.minimum.accumulate(slack)
        origin = np.maximum.accumulate(np.where(slack == low, along, 0))
        cost, begin = low + along, from_[origin]
    best = int(cost.min())
    return best, int(begin[np.flatnonzero(cost == best)].min())


def groups_of(items: list[tuple[int, np.ndarray]], search: Search) -> list[Group]:
    by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
    seen = Counter(x for _, words in items for x in set(words.tolist()))
    common = {x for x, n in seen.items() if n * COMMON > len(items)}
    for number, words in items:
        if len(words):
            by_size.setdefault(int(math.log(len(words)) / math.log(GROUP) + 1e-9), []).append((number, words))
    return [Group(listed, size, search, common) for size, listed in sorted(by_size.items())]


def candidates(group: Group, words: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray) -> set[tuple[int, int]]:
    """Pairs (window begin, stretch of the group's items) whose hashes agree in a round."""
    out: set[tuple[int, int]] = set()
    for k, (keys, order) in enumerate(group.buckets):
        found = group.walk(words, begin, end, k)
        low, high = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
        for i in np.flatnonzero(high > low):
            out.update((int(begin[i]), int(j)) for j in order[low[i] : high[i]])
    return out


def _tables(groups: list[Group]) -> tuple:
    """The groups, their words, which of them each group has, and a table by the words' low bits."""
    vocabulary = np.unique(np.concatenate([g.vocabulary for g in groups]))
    listed = [[np.append(np.isin(vocabulary, x), False) for x in (g.vocabulary, g.uncommon)] for g in groups]
    # A table by the low bits tells most other words before they are looked up.
    some = np.zeros(1 << 20, bool)
    some[(vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return groups, vocabulary, listed, some


def _matches(tables: Broadcast, search: Search):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, vocabulary, listed, some = tables.value
        for batch in w.blocks(batches, "text"):
            words, first = word_hashes(*w.buffers(batch.column("text")))
            n, rows = len(words), []
            known = np.full(n, len(vocabulary))
            maybe = np.flatnonzero(some[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(vocabulary, words[maybe]), len(vocabulary) - 1)
            hit = vocabulary[place] == words[maybe]
            known[maybe[hit]] = place[hit]
            text = np.repeat(np.arange(len(first) - 1), np.diff(first))
            end = first[1:][text]
            for group, (mine, uncommon) in zip(groups, listed, strict=True):
                upto = np.concatenate([[0], np.cumsum(mine[known])])
                begin = np.flatnonzero(upto[np.minimum(np.arange(n) + group.size, end)] - upto[:-1] >= max(1, group.least))
                upto = np.concatenate([[0], np.cumsum(uncommon[known])])
                last = np.minimum(begin + group.reach, end[begin])
                front = np.maximum(begin - group.back, first[text[begin]])
                begin = begin[upto[last] - upto[front] >= group.least_uncommon]
                if not len(begin):
                    continue
                best: dict[tuple[int, int], tuple[int, int]] = {}
                checked: set[tuple[int, int]] = set()
                for window, s in sorted(candidates(group, words, first, begin, end[begin])):
                    j = int(group.item[s])
                    number, item = group.items[j]
                    row, most = int(text[window]), allowed(len(item), search.edits)
                    # Windows of items that would begin close together are verified over one stretch.
                    reach, at = max(1, most), window - int(group.offset[s])
                    cell = at // reach
                    if (row, cell, j) in checked:
                        continue
                    checked.add((row, cell, j))
                    low = max(int(first[row]), cell * reach - most)
                    high = min(int(first[row + 1]), (cell + 1) * reach + len(item) + most)
                    # All but the edited words of the item must be there at all.
                    there = set(words[low:high].tolist())
                    if sum(x in there for x in group.listed[j]) < len(item) - most:
                        continue
                    cost, where = best_stretch(item, words[low:high])
                    if cost <= most:
                        found = (cost, low + where - int(first[row]))
                        best[row, number] = min(best.get((row, number), found), found)
                rows += [(row, number, *found) for (row, number), found in best.items()]
            rows.sort()
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            row, number, cost, where = (pa.array(c, pa.int64()) for c in columns)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(row), number, where, cost], ["doc_id", "item_id", "first_word", "edits"]
            )

    return run


def _items(benchmark: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items in blocks of bounded size."""
    block: list[tuple[int, np.ndarray]] = []
    words = 0
    for row in benchmark.where(F.col("text").isNotNull()).toLocalIterator():
        raw = np.frombuffer(row["text"].encode(), np.uint8)
        block.append((row["item_id"], word_hashes(raw, np.array([0, len(raw)]))[0]))
        words += len(block[-1][1])
        if words >= WORDS_AT_ONCE:
            yield block
            block, words = [], 0
    yield block


def contaminated(
    docs: DataFrame, benchmark: DataFrame, search: Search | None = None, *,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, first_word (where it begins, words
    from 0) and edits (words to change)."""
    search = search or Search()
    narrow = prefixed(docs, doc_id=doc_id, text=text)
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id long, first_word long, edits long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _items(prefixed(benchmark, item_id=item_id, text=item_text)):
        if groups := groups_of(block, search):
            tables = docs.sparkSession.sparkContext.broadcast(_tables(groups))
            out = out.unionByName(narrow.mapInArrow(_matches(tables, search), schema))
    return out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, search: Search | None = None, *, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    hits = contaminated(docs, benchmark, search, doc_id=doc_id, text=text).select(F.col("doc_id").alias("hit")).distinct()
    rows = with_row(docs, id=docs[doc_id])
    return rows.join(stored(hits, "contaminated"), F.col("id").eqNullSafe(F.col("hit")), "left_anti").select("row.*")

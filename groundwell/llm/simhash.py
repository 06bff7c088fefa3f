"""SimHash near-dedup with vantage-point trees over the distinct fingerprints.

A tree looks at some bits of a fingerprint only. A node has a vantage point and puts what lies
within its radius inside, the rest outside. By the triangle inequality two fingerprints of at
most r differing bits in the tree's mask have distances to the vantage point that differ by at
most r, so whoever lies outside by no more than r is put inside as well: linked fingerprints meet
in a shard. Over all 64 bits unrelated fingerprints lie 32 +- 4 bits from any point, a margin of 4
would send a third of them both ways at every node and prune next to nothing. The masks are
therefore blocks of bits: of b blocks, 4 differing bits leave b - 4 untouched, so there is a tree
whose mask has no difference, whose margin is 0, and which prunes all other branches. With more
blocks masks get longer and trees more numerous; any number of blocks finds every link.

Only distinct fingerprints are compared, in numpy and by whole shards. For components a shard hands on a
spanning forest of its links, never its pairs (`links`). Who needs the pairs themselves gets them from `stars`,
all of a small group, and of a large one those with a few of its fingerprints, until asked for the rest. A shard
above SHARD_ROWS is dealt to cells of two of its parts each. Components are found by contracting the links in tables.

Defined cases: a null text counts as empty; texts without words have fingerprint 0 and are linked
like any other; null ids are members but never the smallest; repeated rows are copies; an empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.tables import prefixed, stored

SEED, BITS = 42, 64
#: Fingerprints of a shard that meet in one task.
SHARD_ROWS = 20_000
#: Distinct fingerprints up to which so many blocks are used.
BLOCKS = ((20_000_000, 5), (5_000_000_000, 6), (1 << 62, 7))
#: Levels of a tree whose margin is not 0, as every one of them makes copies.
OVERLAPPING_LEVELS = 6
#: Found pairs that are kept before they are reduced to a forest, and shingles that are counted at once.
PAIRS_AT_ONCE, SHINGLES_AT_ONCE = 1 << 20, 1 << 16


def fingerprint(text: bytes, width: int = 4) -> int:
    """Bit i is set if it is set in more than half of the shingle hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(sizes + 1) - sizes - 1
    ends = (begins + sizes)[width - 1 :].tolist()
    begins, total = begins.tolist(), np.zeros(BITS, np.int64)
    for k in range(0, len(ends), SHINGLES_AT_ONCE):
        spans = zip(begins[k : k + SHINGLES_AT_ONCE], ends[k : k + SHINGLES_AT_ONCE], strict=False)
        some = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * total > len(ends), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        found = np.array([fingerprint(t.as_py() or b"") for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and its fingerprint `fp` as a signed number. docs: doc_id, text."""
    return docs.mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def masks(blocks: int, radius: int) -> list[int]:
    """For every choice of blocks that `radius` differing bits can leave untouched, its bits. With no
    more blocks than differing bits, single blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    return [sum(chosen) for chosen in itertools.combinations(parts, max(1, blocks - radius))]


def margin(blocks: int, radius: int) -> int:
    """Differing bits that some mask has at most."""
    return 0 if blocks > radius else radius // blocks


def shards(fps: np.ndarray, mask: int, within: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Descend the tree of `mask`: positions in `fps` and the shards they go to."""
    bits = mask.bit_count()
    levels = bits + bits // 2 if within == 0 else OVERLAPPING_LEVELS
    points = np.random.default_rng(seed).integers(0, 1 << 63, levels, dtype=np.uint64) * np.uint64(2)
    points |= np.random.default_rng(seed + 1).integers(0, 2, levels, dtype=np.uint64)
    row, path = np.arange(len(fps)), np.zeros(len(fps), np.int64)
    for point in points:
        far = np.bitwise_count((fps[row] ^ point) & np.uint64(mask)).astype(np.int64) - bits // 2
        outside = far > 0
        both = outside & (far <= within)
        row, path = np.concatenate([row, row[both]]), np.concatenate([path * 2 + outside, path[both] * 2])
    return row, path


def _shards_of(trees: list[int], within: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for number, mask in enumerate(trees):
                row, path = shards(fps, mask, within, 1000 + 2 * number)
                tree, at = np.full(len(row), number, np.int32), pa.array(row)
                columns = [pa.array(tree), pa.array(path), *(c.take(at) for c in batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "shard", *batch.schema.names])

    return run


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places one that stands for its component under the links a-b."""
    up = np.arange(n)
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return up
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        up[np.maximum(x, y)] = np.minimum(x, y)
        while (up[up] != up).any():
            up = up[up]


def _forest(key: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of whole shards a place that stands for its component. Each one is compared with
    the next one of its shard, the one after that, and so on."""
    n, shard = len(fps), np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).any(axis=1)]))
    a, b, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    left = np.arange(n)
    for step in range(1, n):
        left = left[left < n - step]
        left = left[shard[left] == shard[left + step]]
        if not len(left):
            break
        near = left[np.bitwise_count(fps[left] ^ fps[left + step]) <= radius]
        a.append(near)
        b.append(near + step)
        size += len(near)
        if size > PAIRS_AT_ONCE:
            up = roots(n, np.concatenate(a), np.concatenate(b))
            a = [np.flatnonzero(up != np.arange(n))]
            b, size = [up[a[0]]], 0
    return roots(n, np.concatenate(a), np.concatenate(b))


def _whole_shards(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Rows in order of shards, cut only between shards, and their keys."""
    keys, rows = np.zeros((0, 3), np.int64), []
    for batch in batches:
        more = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("tree", "shard", "cell")], axis=1)
        # The last shard may go on in the next batch.
        same = (more == more[-1:]).all(axis=1)
        upto = int(np.argmax(same)) if len(same) else 0
        if len(keys) and len(more) and (more[0] != keys[-1]).any():
            yield keys, pa.concat_batches(rows)
            keys, rows = keys[:0], []
        if upto:
            yield np.concatenate([keys, more[:upto]]), pa.concat_batches([*rows, batch.slice(0, upto)])
            keys, rows = keys[:0], []
        keys = np.concatenate([keys, more[upto:]])
        rows.append(batch.slice(upto))
    if len(keys):
        yield keys, pa.concat_batches(rows)


def _links_of(radius: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _whole_shards(batches):
            fps = rows.column("fp").to_numpy().view(np.uint64)
            up = _forest(key, fps, radius)
            low = np.flatnonzero(up != np.arange(len(fps)))
            ends = [pa.array(fps[low].view(np.int64)), pa.array(fps[up[low]].view(np.int64))]
            yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    return run


def _star_pairs(fps: np.ndarray, first: list[bytes | None], n: np.ndarray, radius: int, most: int | None) -> Iterator[tuple]:
    """Places (i, many j) of one component to be compared, and whether i is a head, which stands for others."""
    mute = np.array([f is None for f in first])
    asks, whole = np.flatnonzero(~mute).tolist(), most is None or n.sum() <= most
    done = np.zeros(len(fps), bool)
    for i in asks if whole else sorted(asks, key=first.__getitem__):
        near = np.bitwise_count(fps ^ fps[i]) <= radius
        near[i] = n[i] > 1
        if whole:
            near &= ~done
            done[i] = True
        else:
            # What is near a head stands back, unless it is all that asks for a mute one.
            if done[i]:
                near &= mute & ~done
            done |= near
        if near.any():
            yield i, np.flatnonzero(near), not whole


def _stars_of(radius: int, most: int | None):
    def of_shards(key: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps, n = rows.column("fp").to_numpy().view(np.uint64), rows.column("n").to_numpy()
        up = _forest(key, fps, radius)
        order = np.argsort(up, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], up[order][1:] != up[order][:-1]]))
        ends = np.append(begins[1:], len(order))
        some = (ends - begins > 1) | (n[order[begins]] > 1)
        a, b, heads, size = [], [], [], 0
        for begin, end in zip(begins[some], ends[some], strict=True):
            at = order[begin:end]
            first = rows.column("first").take(pa.array(at)).to_pylist()
            for i, near, head in _star_pairs(fps[at], first, n[at], radius, most):
                a.append(np.full(len(near), fps[at[i]]))
                b.append(fps[at[near]])
                heads.append(np.full(len(near), head))
                size += len(near)
                if size > PAIRS_AT_ONCE:
                    yield batch(a, b, heads)
                    a, b, heads, size = [], [], [], 0
        if size:
            yield batch(a, b, heads)

    def batch(a: list[np.ndarray], b: list[np.ndarray], heads: list[np.ndarray]) -> pa.RecordBatch:
        columns = [np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64), np.concatenate(heads)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "head"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _whole_shards(batches):
            yield from of_shards(key, rows)

    return run


def _meeting(distinct: DataFrame, radius: int, blocks: int | None, found: Callable, schema: str) -> DataFrame:
    """What `found` makes of the rows of `distinct` by whole shards. Where they have a column `first`, shards in
    which it is null throughout are left out."""
    if blocks is None:
        count = distinct.count()
        blocks = next(b for most, b in BLOCKS if count <= most) + max(0, radius - 4)
    trees = masks(blocks, radius)
    types = "".join(f", {f.name} {f.dataType.simpleString()}" for f in distinct.schema)
    dealt = stored(distinct.mapInArrow(_shards_of(trees, margin(blocks, radius)), f"tree int, shard long{types}"), "shards")
    if "first" in distinct.columns and not distinct.where("first IS NULL").isEmpty():
        asked = dealt.where("first IS NOT NULL").select("tree", "shard").distinct()
        dealt = dealt.join(asked, ["tree", "shard"], "left_semi")
    large = dealt.groupBy("tree", "shard").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > SHARD_ROWS)
    large = stored(large.select("tree", "shard", F.ceil(F.col("rows") / (SHARD_ROWS / 2)).cast("int").alias("parts")), "large-shards")
    if large.isEmpty():
        cells = dealt.withColumn("cell", F.lit(0))
    else:
        # Every two parts of a large shard meet in a cell of their own.
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != F.col("part"))
        cell = F.transform(others, lambda j: F.least(j, F.col("part")) * F.col("parts") + F.greatest(j, F.col("part")) + 1)
        cells = (
            dealt.join(large, ["tree", "shard"], "left")
            .withColumn("part", part)
            .withColumn("cell", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(cell)))
            .select(*dealt.columns, "cell")
        )
    rows = cells.repartition("tree", "shard", "cell").sortWithinPartitions("tree", "shard", "cell")
    return rows.select("tree", "shard", "cell", *distinct.columns).mapInArrow(found, schema)


def links(distinct: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """Links (a, b) that connect all fingerprints of at most `radius` differing bits. distinct: fp."""
    return _meeting(distinct, radius, blocks, _links_of(radius), "a long, b long")


def stars(distinct: DataFrame, radius: int = 4, blocks: int | None = None, *, most: int | None) -> DataFrame:
    """Pairs (a, b) of fingerprints of at most `radius` differing bits, a = b where it has several members; a pair may
    come more than once. distinct: fp, first (the least member that asks, null if none does), n (its members).

    Only pairs with a fingerprint that asks. Of a connected group of a shard with at most `most` members (None:
    of any group) all of them, each in one direction. In a larger one, some fingerprints that ask are heads, taken by
    `first`, none within `radius` of another; all their pairs (head, b) come, with `head` true, and one such pair for
    what does not ask and is near no head, but near one that asks.
    """
    return _meeting(distinct, radius, blocks, _stars_of(radius, most), "a long, b long, head boolean")


def components(edges: DataFrame) -> DataFrame:
    """v and the `root` of its component, for every end of an edge (a, b).

    Every vertex goes to its least neighbour if that is less, and on to the root of the tree so
    made; edges are redrawn between roots until none is left. A component of any size is no group
    of its own anywhere.
    """
    edges = stored(edges.distinct(), "edges")
    members = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("least"))
        up = _to_roots(up.select("v", F.least("v", "least").alias("root")))
        if members is None:
            members = up
        else:
            then = up.select(F.col("v").alias("root"), F.col("root").alias("next"))
            members = members.join(then, "root", "left").select("v", F.coalesce("next", "root").alias("root"))
            members = stored(members, "members")
        for end in ("a", "b"):
            edges = edges.join(up.withColumnRenamed("v", end), end).drop(end).withColumnRenamed("root", end)
        edges = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
        if edges.isEmpty():
            return members


def _to_roots(up: DataFrame) -> DataFrame:
    """Follow v to `root` until nothing moves; each time paths become half as long."""
    while True:
        up = stored(up, "parents")
        above = up.select(F.col("v").alias("root"), F.col("root").alias("next"))
        moved = stored(up.join(above, "root").select("v", "root", "next"), "grandparents")
        up = moved.select("v", F.col("next").alias("root"))
        if moved.where("root <> next").isEmpty():
            return up


def near_duplicates(
    docs: DataFrame, radius: int = 4, *, doc_id: str = "doc_id", text: str = "text", blocks: int | None = None
) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest id of its component)."""
    marked = stored(fingerprints(prefixed(docs, doc_id=doc_id, text=text)), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    members = components(links(distinct.select("fp"), radius, blocks)).withColumnRenamed("v", "fp")
    rooted = distinct.join(members, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(named, "root").select("fp", "component_id"), "components")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")

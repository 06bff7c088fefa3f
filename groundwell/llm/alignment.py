"""Alignment of two tokenizers: documents are cut where a token of each ends, links are counted.

Fragments. Any byte range of a document gives a fragment: the tokens up to the first place where
tokens of both end (open to the left), the groups between such places (closed), and the tokens
behind the last one (open to the right). Two neighbouring fragments make one again: what is open
between them is grouped anew. This is associative and an empty fragment changes nothing, so the
fragments of a document can be composed in any tree. A document of more than CHUNK bytes is dealt
out in chunks, which different tasks encode; the fragments are composed FAN at a time, level by
level. A chunk begins, for each tokenizer by itself, at the first place behind a multiple of CHUNK
where its text can be cut without other tokens coming out, so the two ranges of a chunk differ.

Links. A link is a pair of tokens that share bytes. Blocks of documents hold the pairs of their
links once; pairs are counted by an aggregate over blocks, and what was counted goes back to each
block. A pair that every document holds costs one row a block, and no list of pairs is collected.

Defined cases: texts that are null, empty, or not given back by the bytes of either tokenizer have
no tokens and no groups; null ids and repeated rows are worked on one by one; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, fields
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm import words as w
from groundwell.llm.pieces import SOLID, TEXTS, TOGETHER, Encoder, default_path
from groundwell.llm.pieces import cuts as byte_cuts
from groundwell.llm.tables import drop, prefixed, stored

#: Bytes of text that one task encodes of a long document, and fragments that are composed at once.
CHUNK, FAN = 64 << 10, 16
#: Links that are numbered together.
BLOCK_LINKS = 1_000_000
#: Distinct pieces of text whose ids a worker keeps of each tokenizer.
KEPT = 500_000
#: U+2581, which the second tokenizer can't tell from a space.
_BAR = "▁".encode()


def piece_cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the piece tokenizer's pieces of text begin: at texts, and at single spaces inside them."""
    begin = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        begin[1:-2] = (data[:-2] != 0x20) & (data[1:-1] == 0x20) & SOLID[data[2:]]
    begin[at[1:][at[1:] > 0] - 1] = False
    begin[at[:-1]] = True
    return np.flatnonzero(begin[:-1])


class Tokens(Encoder):
    """A tokenizer with the bytes of every id, which encodes every distinct piece once per worker."""

    bytes_of: tuple[np.ndarray, np.ndarray]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin."""
        begin = self.cuts(data, at)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        end = np.append(begin[1:], len(data))
        which, keys = pd.factorize(w.hashes(data, begin, end))
        order = np.argsort(keys)
        keys, which = keys[order], np.argsort(order)[which]
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[place] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            if len(self.keys) + int(new.sum()) > KEPT:
                self._empty()
                new[:] = True
            example = np.empty(len(keys), np.int64)
            example[which] = np.arange(len(which))
            raw, example = data.tobytes(), example[new]
            self._learn(keys[new], [raw[a:b] for a, b in zip(begin[example].tolist(), end[example].tolist(), strict=True)])
            place = np.searchsorted(self.keys, keys)
        count = self.count[place][which]
        upto = np.cumsum(count)
        ids = self.ids[np.repeat(self.begin[place][which] - (upto - count), count) + np.arange(upto[-1])]
        return ids, np.concatenate([[0], upto])[np.searchsorted(begin, at)]


class ByteTokens(Tokens):
    """The byte-level tokenizer."""

    def __init__(self, path: str):
        super().__init__(path)
        chars = _byte_of_char()
        self.bytes_of = _table({i: bytes(chars[c] for c in t) for t, i in self.tokenizer.get_vocab().items()})

    cuts = staticmethod(byte_cuts)


class PieceTokens(Tokens):
    """The piece tokenizer with byte fallback. Its pieces hold spaces in front only, so a text can be cut
    before a single space. A piece's first space is the one that the library itself adds."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        count = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(count)]
        bar = _BAR.decode()
        if any(bar in name.lstrip(bar) for name in names):
            raise ValueError(f"{path}: pieces with spaces inside")
        self.bytes_of = _table({
            i: bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(bar, " ").encode()
            for i, n in enumerate(names) if not (self.model.is_control(i) or self.model.is_unknown(i))
        })
        self.size = np.diff(self.bytes_of[1])
        self._empty()

    cuts = staticmethod(piece_cuts)

    def _ids_of(self, texts: list[str]) -> np.ndarray:
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        return np.fromiter((i for ids in found for i in ids), np.uint32, sum(map(len, found)))

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        # A piece with a space at its end is encoded alone: the next one's space would join it.
        alone = np.fromiter((p[-1:] == b" " or len(p) < 2 or not SOLID[p[1]] for p in pieces), bool, len(pieces))
        order = np.concatenate([np.flatnonzero(alone), np.flatnonzero(~alone)])
        texts = [pieces[i].decode() for i in order[: int(alone.sum())].tolist()]
        rest = order[int(alone.sum()) :].tolist()
        for k in range(0, len(rest), TOGETHER):
            texts.append(b"".join([pieces[i] for i in rest[k : k + TOGETHER]]).decode())
        flat = np.concatenate([self._ids_of(texts[k : k + TEXTS]) for k in range(0, len(texts), TEXTS)])
        ends = np.searchsorted(np.cumsum(self.size[flat]), np.cumsum([len(pieces[i]) for i in order.tolist()])) + 1
        upto, count = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        upto[order], count[order] = ends, np.diff(ends, prepend=0)
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.begin = np.insert(self.begin, place, len(self.ids) + upto - count)
        self.count = np.insert(self.count, place, count)
        self.ids = np.concatenate([self.ids, flat])


def _byte_of_char() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves,
    the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _table(of: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids in a row, and where each id's begin."""
    listed = [of.get(i, b"") for i in range(max(of) + 1)]
    return np.frombuffer(b"".join(listed), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in listed])])


def spelled(tokens: Encoder, ids: np.ndarray) -> np.ndarray:
    """The bytes of the ids in a row."""
    flat, at = tokens.bytes_of
    size = (at[1:] - at[:-1])[ids]
    upto = np.cumsum(size)
    return flat[np.repeat(at[ids] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]


@lru_cache(2)
def pair_of(first: str, second: str) -> tuple[ByteTokens, PieceTokens]:
    """The two tokenizers of this worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteTokens(first), PieceTokens(second)


def _empty() -> np.ndarray:
    return np.zeros(0, np.int64)


@dataclass
class Fragment:
    """Ids and byte ends of the open tokens of both tokenizers, and the closed groups as ids and sizes."""

    known: bool = False  # whether tokens of both end at some place inside
    left_a: np.ndarray = field(default_factory=_empty)
    left_a_ends: np.ndarray = field(default_factory=_empty)
    left_b: np.ndarray = field(default_factory=_empty)
    left_b_ends: np.ndarray = field(default_factory=_empty)
    a: np.ndarray = field(default_factory=_empty)
    b: np.ndarray = field(default_factory=_empty)
    a_sizes: np.ndarray = field(default_factory=_empty)
    b_sizes: np.ndarray = field(default_factory=_empty)
    right_a: np.ndarray = field(default_factory=_empty)
    right_a_ends: np.ndarray = field(default_factory=_empty)
    right_b: np.ndarray = field(default_factory=_empty)
    right_b_ends: np.ndarray = field(default_factory=_empty)

    def __add__(self, other: Fragment) -> Fragment:
        mine = ("right_a", "right_a_ends", "right_b", "right_b_ends") if self.known else _LEFT
        a, a_ends, b, b_ends = (np.concatenate([getattr(self, x), getattr(other, y)]) for x, y in zip(mine, _LEFT, strict=True))
        both = _common(a_ends, b_ends)
        if not self.known and not len(both):
            return Fragment(False, a, a_ends, b, b_ends)
        in_a = np.searchsorted(a_ends, both, "right")
        in_b = np.searchsorted(b_ends, both, "right")
        first_a, first_b = (0, 0) if self.known else (in_a[0], in_b[0])
        last_a, last_b = (in_a[-1], in_b[-1]) if len(both) else (0, 0)
        left = [getattr(self, x) for x in _LEFT] if self.known else [a[:first_a], a_ends[:first_a], b[:first_b], b_ends[:first_b]]
        start = [] if self.known else [0]
        sizes_a, sizes_b = np.diff(in_a, prepend=0)[len(start) :], np.diff(in_b, prepend=0)[len(start) :]
        inner = (a[first_a:last_a], b[first_b:last_b], sizes_a, sizes_b)
        closed = [np.concatenate([getattr(self, x), y, getattr(other, x)]) for x, y in zip(_CLOSED, inner, strict=True)]
        right = [getattr(other, x) for x in _RIGHT] if other.known else [a[last_a:], a_ends[last_a:], b[last_b:], b_ends[last_b:]]
        return Fragment(True, *left, *closed, *right)

    def whole(self) -> tuple[np.ndarray, ...]:
        """Groups of a document all of whose fragments were composed: its begin closes what is open to the left."""
        if len(self.right_a) or len(self.right_b):
            raise ValueError("the tokenizers end at different bytes")
        lead = (self.left_a, self.left_b, np.array([len(self.left_a)] * self.known), np.array([len(self.left_b)] * self.known))
        return tuple(np.concatenate([x, getattr(self, y)]).astype(np.int64) for x, y in zip(lead, _CLOSED, strict=True))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers that both ascending arrays hold."""
    if not len(a) or not len(b):
        return _empty()
    least = min(a[0], b[0])
    marked = np.zeros(max(a[-1], b[-1]) - least + 1, bool)
    marked[a - least] = True
    return b[marked[b - least]]


_LEFT = ("left_a", "left_a_ends", "left_b", "left_b_ends")
_CLOSED = ("a", "b", "a_sizes", "b_sizes")
_RIGHT = ("right_a", "right_a_ends", "right_b", "right_b_ends")
_ARRAYS = [f.name for f in fields(Fragment) if f.name != "known"]
_FRAGMENT = "known boolean, " + ", ".join(f"{x} array<{'long' if 'ends' in x else 'int'}>" for x in _ARRAYS)


def fragment(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Fragment:
    """Of the tokens of a byte range, with their ends in the document."""
    return Fragment(False, a, a_ends, b, b_ends) + Fragment()


def _arrays(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*rows, _empty()]), pa.int64()).cast(kind))


def _spaced(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts with a space in front, but those without characters."""
    size = np.diff(at)
    out = np.concatenate([[0], np.cumsum(size + (size > 0))])
    spaced = np.full(out[-1], 0x20, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(out[:-1] + 1 - at[:-1], size)] = data
    return spaced, out


def _encoded(tokens: Tokens, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the ids before each text. The texts must be given back by their ids."""
    ids, first = tokens.encode(data, at)
    back = spelled(tokens, ids)
    if len(back) != len(data) or (back != data).any():
        raise ValueError("a tokenizer changes texts in a way that is not known here")
    return ids, first


def _given_back(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts, those emptied that the tokenizers don't give back: the ones with a character that stands for a space."""
    raw = data.tobytes()
    if _BAR not in raw:
        return data, at
    good = np.array([_BAR not in raw[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
    return data[np.repeat(good, np.diff(at))], np.concatenate([[0], np.cumsum(np.diff(at) * good)])


def _align(path: tuple[str, str], batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of a block of texts: ids of both, group sizes of both, and where each text's begin among ids of the
    first, of the second, and among the groups."""
    one, two = pair_of(*path)
    data, at = _given_back(*_spaced(*w.buffers(batch.column("text"))))
    (a, a_first), (b, b_first) = _encoded(one, data, at), _encoded(two, data, at)
    # Every text's end is an end of both, so all texts together are grouped as one would be.
    a_ends, b_ends = np.cumsum(np.diff(one.bytes_of[1])[a]), np.cumsum(np.diff(two.bytes_of[1])[b])
    groups = fragment(a, a_ends, b, b_ends).whole()
    closes = np.cumsum(groups[2])
    return *groups, a_first, b_first, np.searchsorted(closes, a_first, "right")


def _short(path: tuple[str, str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.blocks(batches, "text"):
            a, b, a_sizes, b_sizes, a_at, b_at, g_at = _align(path, batch)
            lists = [
                pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(np.int32)))
                for x, at in ((a, a_at), (b, b_at), (a_sizes, g_at), (b_sizes, g_at))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", *_CLOSED])

    return run


def _chunked(chunk: int):
    """Rows of (doc_id, row, seq, begin and end of both tokenizers' ranges, bytes from the lesser begin)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.blocks(batches, "text", 1):
            data, at = _given_back(*_spaced(*w.buffers(batch.column("text"))))
            raw, nominal, wide = data.tobytes(), np.arange(0, max(len(data), 1), chunk), {}
            for name, cuts in (("a", byte_cuts), ("b", piece_cuts)):
                safe = np.append(cuts(data, at), len(data))
                wide[name] = np.append(safe[np.searchsorted(safe, nominal)], len(data)).tolist()
            row = uuid.uuid4().hex
            for seq in range(len(wide["a"]) - 1):
                (a, a_end), (b, b_end) = (x[seq : seq + 2] for x in wide.values())
                begin = min(a, b)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array([x]) for x in (row, seq, a, a_end, b, b_end, raw[begin : max(a_end, b_end)]))],
                    ["doc_id", "row", "seq", "a", "a_end", "b", "b_end", "bytes"],
                )

    return run


def _fragments(path: tuple[str, str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1)
                at = {x: r.column(x)[0].as_py() for x in ("a", "a_end", "b", "b_end")}
                data, begin, ends = np.frombuffer(r.column("bytes")[0].as_buffer(), np.uint8), min(at["a"], at["b"]), []
                for name, tokens in zip("ab", pair_of(*path), strict=True):
                    mine = data[at[name] - begin : at[f"{name}_end"] - begin]
                    ids, _ = _encoded(tokens, mine, np.array([0, len(mine)]))
                    ends += [ids, at[name] + np.cumsum(np.diff(tokens.bytes_of[1])[ids])]
                yield _fragment_row(r.select(["doc_id", "row", "seq"]), fragment(*ends))

    return run


def _fragment_row(keys: pa.RecordBatch, found: Fragment) -> pa.RecordBatch:
    lists = [_arrays([getattr(found, x)], pa.int64() if "ends" in x else pa.int32()) for x in _ARRAYS]
    return pa.RecordBatch.from_arrays([*keys.columns, pa.array([found.known]), *lists], [*keys.schema.names, "known", *_ARRAYS])


def _composed(fan: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("seq")
        parts = []
        for k in range(group.num_rows):
            row = group.slice(k, 1)
            parts.append(Fragment(row.column("known")[0].as_py(), *(row.column(x)[0].values.to_numpy(zero_copy_only=False) for x in _ARRAYS)))
        head = group.slice(0, 1).select(["doc_id", "row"]).append_column("seq", pa.array([group.column("seq")[0].as_py() // fan]))
        return pa.Table.from_batches([_fragment_row(head.combine_chunks().to_batches()[0], reduce(Fragment.__add__, parts))])

    return run


def _closed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            found = Fragment(row.column("known")[0].as_py(), *(row.column(x)[0].values.to_numpy(zero_copy_only=False) for x in _ARRAYS))
            yield pa.RecordBatch.from_arrays([row.column("doc_id"), *(_arrays([x], pa.int32()) for x in found.whole())], ["doc_id", *_CLOSED])


def compose(fragments: DataFrame, fan: int = FAN) -> DataFrame:
    """One fragment for each `row`, composed level by level; `seq` numbers its fragments from 0."""
    while (most := fragments.agg(F.max("seq")).first()[0]) is not None and most > 0:
        level = F.floor(F.col("seq") / fan).alias("level")
        done = stored(fragments.groupBy("row", level).applyInArrow(_composed(fan), fragments.schema), "fragments")
        drop(fragments)
        fragments = done
    return fragments


def _aligned(narrow: DataFrame, path: tuple[str, str], chunk: int, fan: int, then: Callable, out: str) -> DataFrame:
    """What `then` makes of the rows of `align`, in the task that aligns a document or composes its last fragments."""
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    is_long = F.octet_length("text") > chunk
    chunks = narrow.where(is_long).mapInArrow(
        _chunked(chunk), f"doc_id {id_type}, row string, seq long, a long, a_end long, b long, b_end long, bytes binary"
    )
    chunks = stored(chunks, "chunks")
    # A chunk's rows lie behind one another in a file; its bytes are work for several tasks.
    dealt = chunks.repartition("row", "seq")
    found = stored(dealt.mapInArrow(_fragments(path), f"doc_id {id_type}, row string, seq long, {_FRAGMENT}"), "fragments")
    drop(chunks)
    long = compose(found, fan).mapInArrow(lambda batches: then(_closed(batches)), out)
    short = narrow.where(~is_long | F.col("text").isNull()).mapInArrow(lambda batches: then(_short(path)(batches)), out)
    return short.unionByName(long)


def _narrow(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return prefixed(docs, doc_id=doc_id, text=text).withColumn("text", F.col("text").cast("string"))


def align(
    docs: DataFrame, *, first: str | None = None, second: str | None = None, chunk: int = CHUNK, fan: int = FAN,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, a, b (ids of the text behind a space, by the first and by the second tokenizer), a_sizes,
    b_sizes (how many of them each group has, in order)."""
    path = (first or default_path(), second or default_path("piece_bpe_32k.model"))
    narrow = _narrow(docs, doc_id, text)
    out = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{x} array<int>" for x in _CLOSED)
    return _aligned(narrow, path, chunk, fan, iter, out)


def rendered(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, tables: list) -> pa.Array:
    """`id,` for every id, with `|` behind the last of the first tokenizer in a group and `;` behind the group."""
    total = len(a) + len(b)
    before = np.cumsum(a_sizes + b_sizes) - a_sizes - b_sizes
    out, mark = np.empty(total, np.int64), np.zeros(total, np.int8)
    a_place = np.repeat(before - (np.cumsum(a_sizes) - a_sizes), a_sizes) + np.arange(len(a))
    b_place = np.repeat(before + a_sizes - (np.cumsum(b_sizes) - b_sizes), b_sizes) + np.arange(len(b))
    out[a_place], out[b_place] = a, b
    mark[before + a_sizes - 1], mark[before + a_sizes + b_sizes - 1] = 1, 2
    return tables[0].take(pa.array(out * 3 + mark))


@lru_cache(1)
def _names(size: int) -> list:
    return [pa.array([f"{i}{end}" for i in range(size) for end in ",|;"], pa.large_string())]


def _linked(path: tuple[str, str], block_links: int):
    """Per document its counts, digest, and its links' pairs by their number in the block; the block's
    pairs and their counts stand in its first row."""

    def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = np.cumsum([0, *(len(x) + len(y) for x, y in zip(batch.column("a"), batch.column("b"), strict=True))])
        row = 0
        while row < batch.num_rows:
            upto = max(row + 1, int(np.searchsorted(size, size[row] + block_links, "right")) - 1)
            yield batch.slice(row, upto - row)
            row = upto

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = pair_of(*path)
        names = _names(max(len(one.bytes_of[1]), len(two.bytes_of[1])) - 1)
        for batch in (part for whole in batches for part in blocks(whole)):
            flat, upto = {}, {}
            for x in _CLOSED:
                lists = batch.column(x)
                at = lists.offsets.to_numpy().astype(np.int64)
                flat[x], upto[x] = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), at - at[0]
            a, b, a_sizes, b_sizes = flat.values()
            a_ends, b_ends = np.cumsum(np.diff(one.bytes_of[1])[a]), np.cumsum(np.diff(two.bytes_of[1])[b])
            # Every link's last common byte is the end of a token of one or of both.
            size = int(a_ends[-1]) if len(a_ends) else 0
            in_a, in_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
            in_a[a_ends], in_b[b_ends] = True, True
            ends = np.flatnonzero(in_a | in_b)
            of = lambda marked: np.cumsum(marked, dtype=np.int32)[ends] - marked[ends]
            which, kinds = pd.factorize(a[of(in_a)] << 32 | b[of(in_b)])
            times = np.bincount(which, minlength=len(kinds))
            link_at = np.searchsorted(ends, np.concatenate([[0], a_ends])[upto["a"]], "right")
            # Texts come in order, so their pairs do.
            base = np.arange(batch.num_rows + 1) * max(len(kinds), 1)
            numbered, own = pd.factorize(np.repeat(base[:-1], np.diff(link_at)) + which)
            own_times = np.bincount(numbered, minlength=len(own))
            own_at = np.concatenate([[0], np.cumsum(np.bincount(own // max(len(kinds), 1), minlength=batch.num_rows))])
            own = own - np.repeat(base[:-1], np.diff(own_at))
            digests = _digests(rendered(a, b, a_sizes, b_sizes, names), upto["a"] + upto["b"])
            group_first = np.zeros(batch.num_rows + 1, np.int32)
            group_first[1:] = len(kinds)
            listed = lambda at, x, kind: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x).cast(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), *(pa.array(np.diff(x)) for x in (upto["a"], upto["b"], upto["a_sizes"], link_at)), digests,
                    pa.array([uuid.uuid4().hex] * batch.num_rows), listed(own_at, own, pa.int32()), listed(own_at, own_times, pa.int32()),
                    listed(group_first, kinds, pa.int64()), listed(group_first, times, pa.int64()),
                ],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "pair", "times", "kinds", "kind_times"],
            )

    return run


def _digests(tokens: pa.Array, at: np.ndarray) -> pa.Array:
    """Of each text's rendered ids, without the mark behind the last one; of no ids an empty string."""
    ends = np.frombuffer(tokens.buffers()[1] or bytes(8), np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
    data = tokens.buffers()[2]
    raw = memoryview(data) if data is not None else memoryview(b"")
    cuts = ends[at].tolist()
    return pa.array([hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.string())


def _scored(rows: pa.Table, looked: pa.Table) -> pa.Table:
    """Sums over each document's links of what the block's pairs were found to have."""
    rows = rows.combine_chunks()
    looked = looked.sort_by("pos")
    count, best = (looked.column(x).to_numpy() for x in ("count", "best"))
    pair, times = rows.column("pair").combine_chunks(), rows.column("times").combine_chunks()
    at = pair.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    which, times = pair.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    sums = [np.concatenate([[0], np.cumsum(times * x[which])])[at] for x in (best.astype(np.int64), count)] if len(which) else [np.zeros(len(at), np.int64)] * 2
    out = rows.drop_columns(["block", "pair", "times"])
    for name, total in zip(("n_best", "count_sum"), sums, strict=True):
        out = out.append_column(name, pa.array(np.diff(total)))
    return out


def link_scores(
    docs: DataFrame, *, first: str | None = None, second: str | None = None, chunk: int = CHUNK, fan: int = FAN,
    block_links: int = BLOCK_LINKS, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent one of its
    second id, ties included), count_sum (of the pairs' counts over all documents, over its links) and
    groups_sha256 (of `a1,a2|b1;a3|b2,b3`). A document's groups themselves come from `align`."""
    path = (first or default_path(), second or default_path("piece_bpe_32k.model"))
    narrow = _narrow(docs, doc_id, text)
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    counts = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    linked = _aligned(
        narrow, path, chunk, fan, _linked(path, block_links),
        f"doc_id {id_type}, {counts}, block string, pair array<int>, times array<int>, kinds array<long>, kind_times array<long>",
    )
    linked = stored(linked, "links")
    held = linked.where(F.size("kinds") > 0).select("block", F.posexplode(F.arrays_zip("kinds", "kind_times")).alias("pos", "k"))
    held = held.select("block", "pos", F.col("k.kinds").alias("pair"), F.col("k.kind_times").alias("times"))
    counted = held.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("second", F.col("pair").bitwiseAND(0xFFFFFFFF))
    top = counted.groupBy("second").agg(F.max("count").alias("top"))
    found = counted.join(top, "second").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    looked = held.select("block", "pos", "pair").join(found, "pair").select(F.col("block").alias("looked"), "pos", "count", "best")
    rows = linked.drop("kinds", "kind_times")
    done = rows.groupBy("block").cogroup(looked.groupBy("looked"))
    return done.applyInArrow(_scored, f"doc_id {id_type}, {counts}, n_best long, count_sum long")

"""Words of whole Arrow batches of texts as numpy arrays: boundaries and 64-bit hashes.

A word is a run of bytes other than space and U+0009 to U+000D. The texts of a batch are read
from their Arrow buffer at once; batches are cut by bytes, so that the arrays made from a block
stay small whatever the number of rows, and a text longer than a block is hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text makes a block of its own.
BLOCK_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15
_LETTERS = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Of each base its largest table so far.
_TABLES: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    base = int(base)
    if base not in _TABLES or len(_TABLES[base]) < n:
        out = np.full(1 << max(n - 1, 1).bit_length(), np.uint64(base))
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _TABLES[base] = out
    return _TABLES[base][:n]


def inverse(base: int) -> int:
    """Of an odd number modulo 2**64."""
    return pow(int(base), -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit integers over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    wide = np.int32 if pa.types.is_string(column.type) else np.int64
    at = np.frombuffer(column.buffers()[1] or bytes(8), wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    found = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return found, at - at[0]


def blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of at most `limit` bytes of text or of one row."""
    for batch in batches:
        at = buffers(batch.column(text))[1]
        row = 0
        while row < batch.num_rows:
            upto = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            yield batch.slice(row, upto - row)
            row = upto


def bounds(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the words before each text (one entry more than texts)."""
    inside = ~space[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = at[(at > 0) & (at < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every batch and process."""
    out = np.empty(len(starts), np.uint64)
    row = 0
    while row < len(starts):
        begin = starts[row]
        upto = int(np.searchsorted(starts, begin + BLOCK_BYTES))
        piece = data[begin : ends[upto - 1]]
        power = powers(_BASE, len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_LETTERS[piece] * power[:-1], out=total[1:])
        s, e = starts[row:upto] - begin, ends[row:upto] - begin
        back = powers(inverse(_BASE), len(piece) + 1)
        out[row:upto] = mix((total[e] - total[s]) * back[s] + (e - s).astype(np.uint64))
        row = upto
    return out


def windows(words: np.ndarray, length: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A 64-bit hash of every `length` consecutive entries of `words` (across texts as well)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(base, len(words)), out=total[1:])
    return mix((total[length:] - total[:n]) * powers(inverse(base), n) + np.uint64(length))

"""Fill-in-middle: texts are cut at unit borders and rearranged so that the middle comes last.

A unit is a word with the white space before it, or white space at the end of a text. All steps are
pyarrow.compute over whole batches: a byte that no UTF-8 text holds is set behind every unit and the
texts are split at it into list arrays; the lists are flattened with the index of their parent, a
unit's ordinal is its place less its parent's first place, units are filtered by role (prefix,
middle, suffix), the lists are rebuilt from the counts and joined. Where a text is cut and which form
it takes follow from a hash of its id alone, so reruns agree and nothing is shuffled.

Defined cases: a null text counts as empty and gives an empty text in plain form; a null id is
hashed as an empty one; a text that holds a marker stays plain, so that every output can be taken
apart again; repeated rows are worked on one by one; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.llm import words as w
from groundwell.llm.tables import prefixed

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MARKERS = ("<P>", "<S>", "<M>")
#: Of 100 documents so many are rearranged, and of 100 of those so many with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
_END = b"\xff"


def units(texts: pa.Array) -> pa.Array:
    """The units of binary texts as lists, each with one empty entry behind its units."""
    ended = pc.replace_substring_regex(texts, pattern=UNIT, replacement=b"\\0" + _END)
    return pc.split_pattern(ended, pattern=_END)


def _lists(upto: np.ndarray, values: pa.Array) -> pa.Array:
    wide = pa.types.is_large_binary(values.type)
    kind, offset = (pa.LargeListArray, np.int64) if wide else (pa.ListArray, np.int32)
    return kind.from_arrays(pa.array(upto.astype(offset)), values)


def parts(lists: pa.Array, low: pa.Array, high: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of each list of units, cut before ordinals `low` and `high`."""
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    length = pc.list_value_length(lists).cast(pa.int64())
    first = pa.array(np.concatenate([[0], np.cumsum(length)])[:-1].astype(np.int64))
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(first, parent))
    begin, end = pc.take(low, parent), pc.take(high, parent)
    in_prefix, in_suffix = pc.less(ordinal, begin), pc.greater_equal(ordinal, end)
    in_middle = pc.and_not(pc.invert(in_prefix), in_suffix)
    counts = (low, pc.subtract(high, low), pc.subtract(length, high))
    return [
        pc.binary_join(_lists(np.concatenate([[0], np.cumsum(count)]), pc.filter(flat, mask)), b"")
        for mask, count in zip((in_prefix, in_middle, in_suffix), counts, strict=True)
    ]


def _rearranged(markers: tuple[str, str, str]):
    p, s, m = (pa.scalar(x.encode()) for x in markers)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.blocks(batches, "text"):
            text = pc.fill_null(batch.column("text"), "").cast(pa.binary())
            lists = units(text)
            n = pc.subtract(pc.list_value_length(lists).cast(pa.int64()), 1)
            more = pc.add(n, 1)
            cut = [pc.subtract(h, pc.multiply(pc.divide(h, more), more)) for h in (batch.column("h1"), batch.column("h2"))]
            moved = pc.and_(batch.column("chosen"), pc.greater(pc.binary_length(text), 0))
            for marker in (p, s, m):
                moved = pc.and_not(moved, pc.match_substring(text, marker.as_py()))
            low, high = (pc.filter(f(*cut), moved) for f in (pc.min_element_wise, pc.max_element_wise))
            prefix, middle, suffix = parts(pc.filter(lists, moved), low, high)
            first = pc.filter(batch.column("suffix_first"), moved)
            end = pa.scalar(b"")
            out = pc.if_else(
                first,
                pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, end),
                pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, end),
            )
            none = pa.nulls(batch.num_rows, pa.int64())
            chars = [pc.replace_with_mask(none, moved, pc.utf8_length(x.cast(pa.string())).cast(pa.int64())) for x in (prefix, middle)]
            form = pc.replace_with_mask(pa.array(["plain"] * batch.num_rows), moved, pc.if_else(first, "spm", "psm"))
            output = pc.replace_with_mask(text, moved, out).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), n, form, *chars, output],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def _check(markers: tuple[str, str, str]) -> None:
    """An output can be taken apart only if no marker can arise where a text and a marker meet."""
    tails = [(a[k:], b) for a, b in product(markers, markers) for k in range(1, len(a))]
    if len(set(markers)) < 3 or not all(markers) or any(b.startswith(tail) for tail, b in tails):
        raise ValueError(f"markers {markers} are empty, equal or can overlap")


def fill_in_middle(
    docs: DataFrame, *, seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
    markers: tuple[str, str, str] = MARKERS, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output."""
    _check(markers)
    narrow = prefixed(docs, doc_id=doc_id, text=text)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    hashed = narrow.select(
        "doc_id", F.col("text").cast("string").alias("text"), h[0].alias("h1"), h[1].alias("h2"),
        (h[2] % 100 < rate).alias("chosen"), (h[3] % 100 < suffix_first).alias("suffix_first"),
    )
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return hashed.mapInArrow(
        _rearranged(markers), f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that `fill_in_middle` was given, from its output and form."""
    p, s, m = markers

    def behind(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands behind the markers `first`, `second` and the last one, in this order."""
        one = F.substring_index(output, second, 1).substr(F.lit(len(first) + 1), F.length(output))
        rest = F.substring_index(output, second, -1)
        return one, F.substring_index(rest, m, 1), F.substring_index(rest, m, -1)

    psm, spm = behind(p, s), behind(s, p)
    return (
        F.when(form == "plain", output).when(form == "psm", F.concat(psm[0], psm[2], psm[1])).otherwise(F.concat(spm[1], spm[2], spm[0]))
    )

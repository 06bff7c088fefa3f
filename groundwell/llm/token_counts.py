"""Token counts by section: documents are encoded whole and once, tokens go to sections by their spans.

A token's characters are those its bytes belong to. Sections are spans of characters of the same
text. Both are ordered, so the interval join of a block of documents is a search of the token ends
among the section ends. A token that touches several sections is allocated by an explicit rule:
`first`, to the section of its first character; `last`, to that of its last; `most`, to the one
with most of its characters, the earlier of equals. Every token is counted once; one that begins,
or for `last` ends, between sections goes to a section without name.

Defined cases: null texts and null fields count as empty; a section without characters has no
tokens; sections of a document come in order and do not overlap; repeated rows are counted one by
one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm import words as w
from groundwell.llm.pieces import default_path, encoder
from groundwell.llm.tables import prefixed

RULES = ("first", "last", "most")


def allocate(rule: str, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, or -1, and whether it crosses a border. All spans ascend; `end` and `high` are exclusive."""
    one = np.searchsorted(high, begin, "right")  # the section that holds the first character, if it began
    last = np.searchsorted(low, end, "left") - 1  # the one that holds the last, if it goes on
    holds_first = (one < len(low)) & (low[np.minimum(one, len(low) - 1)] <= begin) if len(low) else np.zeros(len(begin), bool)
    holds_last = (last >= 0) & (high[np.maximum(last, 0)] >= end) if len(low) else np.zeros(len(begin), bool)
    out = np.where(holds_last, last, -1) if rule == "last" else np.where(holds_first, one, -1)
    crossing = (holds_first | holds_last | (last >= one)) & ~(holds_first & holds_last & (one == last))
    if rule == "most":
        for k in np.flatnonzero(crossing):
            near = range(one[k], last[k] + 1)
            shares = [min(end[k], high[j]) - max(begin[k], low[j]) for j in near]
            outside = end[k] - begin[k] - sum(shares)
            best = max(shares, default=0)
            out[k] = one[k] + shares.index(best) if best > 0 and best >= outside else -1
    return out, crossing


def _counts(path: str, rule: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.blocks(batches, "text"):
            data, at = w.buffers(batch.column("text"))
            ids, first = encoder(path).encode(data, at)
            size = encoder(path).size[ids]
            ends = np.cumsum(size)
            # Characters that begin before each byte.
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            begin_char, end_char = chars[np.minimum(ends - size + 1, len(data))] - 1, chars[ends]
            base = chars[at]
            sections = batch.column("sections")
            sections = sections.combine_chunks() if isinstance(sections, pa.ChunkedArray) else sections
            upto = sections.offsets.to_numpy().astype(np.int64)
            upto = upto - upto[0]
            flat = sections.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(upto))
            low = flat.field("begin").to_numpy() + base[row]
            high = flat.field("end").to_numpy() + base[row]
            full = np.flatnonzero(high > low)
            which, crossing = allocate(rule, begin_char, end_char, low[full], high[full])
            found = np.append(full, -1)[which]
            tokens = np.bincount(found[found >= 0], minlength=len(row))
            crossed = np.bincount(found[(found >= 0) & crossing], minlength=len(row))
            text = np.repeat(np.arange(batch.num_rows), np.diff(first))
            outside = np.bincount(text[found < 0], minlength=batch.num_rows)
            lists = [pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(x)) for x in (tokens, crossed)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), flat_names(flat, upto), *lists, pa.array(outside), pa.array(np.diff(first))],
                ["doc_id", "names", "tokens", "crossing", "outside", "n_tokens"],
            )

    return run


def flat_names(flat: pa.StructArray, upto: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), flat.field("name"))


def section_tokens(docs: DataFrame, *, rule: str = "first", tokenizer: str | None = None) -> DataFrame:
    """One row per document and section: doc_id, section (its number), name, n_tokens, n_crossing, and one
    with section null if tokens lie outside. docs: doc_id, text, sections (array of name, begin, end)."""
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {RULES}")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sections = F.coalesce("sections", F.array().cast("array<struct<name:string,begin:bigint,end:bigint>>"))
    sections = F.transform(
        sections,
        lambda s: F.struct(s["name"].alias("name"), s["begin"].cast("bigint").alias("begin"), s["end"].cast("bigint").alias("end")),
    )
    counted = docs.select("doc_id", "text", sections.alias("sections")).mapInArrow(
        _counts(tokenizer or default_path(), rule),
        f"doc_id {id_type}, names array<string>, tokens array<bigint>, crossing array<bigint>, outside long, n_tokens long",
    )
    numbered = F.transform(
        F.arrays_zip("names", "tokens", "crossing"),
        lambda x, i: F.struct(i.alias("section"), x["names"].alias("name"), x["tokens"].alias("n_tokens"), x["crossing"].alias("n_crossing")),
    )
    none = F.struct(
        F.lit(None).cast("int").alias("section"), F.lit(None).cast("string").alias("name"),
        F.col("outside").alias("n_tokens"), F.lit(0).cast("bigint").alias("n_crossing"),
    )
    rows = F.when(F.col("outside") > 0, F.concat(numbered, F.array(none))).otherwise(numbered)
    return counted.select("doc_id", F.explode(rows).alias("s")).select("doc_id", "s.*")


def with_fields(docs: DataFrame, fields: list[str], *, doc_id: str = "doc_id", separator: str = "\n") -> DataFrame:
    """doc_id, text and sections: the fields joined to one text, each with the separator behind it."""
    narrow = prefixed(docs, doc_id=doc_id, **{f"f{k}": name for k, name in enumerate(fields)})
    parts = [F.concat(F.coalesce(F.col(f"f{k}").cast("string"), F.lit("")), F.lit(separator)) for k in range(len(fields))]
    text = narrow.select("doc_id", *(p.alias(f"f{k}") for k, p in enumerate(parts)))
    begin, sections = F.lit(0), []
    for k, name in enumerate(fields):
        end = begin + F.length(f"f{k}")
        sections.append(F.struct(F.lit(name).alias("name"), begin.cast("bigint").alias("begin"), end.cast("bigint").alias("end")))
        begin = end
    return text.select("doc_id", F.concat(*(f"f{k}" for k in range(len(fields)))).alias("text"), F.array(*sections).alias("sections"))

"""Documents to chunks: split by meaning, merge small pieces, window long ones."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions.text import WS, is_blank, strip, windows

# Chunk sizes and overlaps, and which document types use which split.
TEXT_SIZE, TEXT_OVERLAP = 1500, 200
CODE_SIZE, CODE_OVERLAP = 800, 100
MERGE_SHARE = 0.2
MARKDOWN_TYPES = ("markdown", "md")
SQL_TYPES = ("sql",)
DIFF_TYPES = ("git_diff",)
CODE_TYPES = ("python", "javascript", "typescript", "java", "kotlin", "go", "rust", "cpp", "c")

# Split patterns. `d` keeps Java's line rule at "\n" only.
PARAGRAPH = rf"(?U)\n{WS}*\n"
SENTENCE = rf"(?U)(?<=[.!?。]){WS}+"
BLANK_LINES = r"\n{2,}"
HEADER = rf"(?Umd)^(#{{1,4}}){WS}+"
STATEMENT = rf"(?U);{WS}*\n"
DIFF_FILE = r"(?md)^(?=diff --git )"
PYTHON_START = r"(?md)^(?=(?:def |class |async def ))"
C_STYLE_START = (
    rf"(?Umd)^(?={WS}*(?:(?:public|private|protected|static|async|export|function|const|let|var){WS}+)*"
    rf"(?:(?:fun|func|fn|def|class|interface|enum|struct|impl){WS}|\w+{WS}+\w+{WS}*\())"
)


def _full(parts: Column) -> Column:
    return F.filter(parts, lambda p: ~is_blank(p))


def _several(parts: Column, otherwise: Column) -> Column:
    return F.when(F.size(parts) > 1, parts).otherwise(otherwise)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, PARAGRAPH, -1), strip), lambda p: p != "")


def split_text(text: Column) -> Column:
    """Paragraphs; the ones longer than a chunk as sentences."""
    return F.flatten(
        F.transform(
            paragraphs(text),
            lambda p: F.when(F.length(p) <= TEXT_SIZE, F.array(p)).otherwise(_full(F.split(p, SENTENCE, -1))),
        )
    )


def split_markdown(text: Column) -> Column:
    """Sections between headers, with each header mark a piece of its own; sections longer
    than a chunk as paragraphs. A section that again starts with a header mark keeps the
    mark that follows it."""
    bodies = F.split(text, HEADER, -1)
    marks = F.regexp_extract_all(text, F.lit(HEADER), F.lit(1))

    def with_mark(body: Column, mark: Column) -> Column:
        return (
            F.when(mark.isNull(), F.array(body))
            .when(body.rlike(rf"(?U)\A#{{1,4}}{WS}"), F.array(F.concat(body, mark)))
            .otherwise(F.array(body, mark))
        )

    pieces = F.flatten(F.zip_with(bodies, marks, with_mark))
    sections = F.filter(F.transform(pieces, strip), lambda s: s != "")
    return F.flatten(
        F.transform(
            sections, lambda s: F.when(F.length(s) <= TEXT_SIZE, F.array(s)).otherwise(paragraphs(s))
        )
    )


def split_code(text: Column, doc_type: Column) -> Column:
    """Pieces that start at a definition; blank-line blocks where there is at most one."""
    pieces = F.when(doc_type == "python", _full(F.split(text, PYTHON_START, -1))).otherwise(
        _full(F.split(text, C_STYLE_START, -1))
    )
    return _several(pieces, _full(F.split(text, BLANK_LINES, -1)))


def split_sql(text: Column) -> Column:
    """Statements, each with its closing semicolon."""
    parts = F.filter(F.transform(F.split(text, STATEMENT, -1), strip), lambda p: p != "")
    closed = F.transform(parts, lambda p: F.when(p.endswith(";"), p).otherwise(F.concat(p, F.lit(";"))))
    return _several(closed, F.array(text))


def split_diff(text: Column) -> Column:
    return _several(_full(F.split(text, DIFF_FILE, -1)), F.array(text))


def merge_runs():
    """Arrow function (text, segments, size) -> array<struct<first, n, at>>.

    Which neighbouring segments form one piece depends on the length reached so far, a
    fold along the document, and so does the search for each piece in the text. Both are
    linear here; an `aggregate` expression would copy its growing array at every step.
    """

    @F.arrow_udf("array<struct<first:int,n:int,at:int>>")
    def runs(texts: pa.Array, segments: pa.Array, sizes: pa.Array) -> pa.Array:
        # Of a batch, only the texts of one row at a time become Python strings.
        columns, ends = ([], [], []), [0]
        for text, parts, size in zip(texts, segments, sizes):
            text, parts, size = text.as_py(), parts.as_py(), size.as_py()
            small = size * MERGE_SHARE
            found, start, width = [], 0, 0
            for i, length in enumerate(map(len, parts)):
                joins = i > 0 and min(length, width) < small and width + length + 1 <= size
                if not joins and i > 0:
                    found.append((start, i))
                start, width = (start, width + length + 1) if joins else (i, length)
            if len(parts):
                found.append((start, len(parts)))
            cursor = 0
            for first, stop in found:
                body = "\n".join(parts[first:stop])
                at = text.find(body, cursor)
                at = cursor if at < 0 else at
                for column, value in zip(columns, (first, stop - first, at)):
                    column.append(value)
                cursor = at + len(body)
            ends.append(len(columns[0]))
        rows = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], ["first", "n", "at"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return runs


def chunk(docs: DataFrame, keys: list[str], text: str = "text", doc_type: str = "doc_type") -> DataFrame:
    """(*keys, chunk_index, char_start, char_end, content); blank documents give no rows."""
    kind = F.col("_type")
    coded = kind.isin(*SQL_TYPES, *DIFF_TYPES, *CODE_TYPES)
    segments = (
        F.when(kind.isin(*MARKDOWN_TYPES), split_markdown(F.col("_text")))
        .when(kind.isin(*SQL_TYPES), split_sql(F.col("_text")))
        .when(kind.isin(*DIFF_TYPES), split_diff(F.col("_text")))
        .when(kind.isin(*CODE_TYPES), split_code(F.col("_text"), kind))
        .otherwise(split_text(F.col("_text")))
    )
    staged = (
        docs.where(F.col(text).rlike(rf"(?U)[^{WS[1:]}"))
        .select(*keys, strip(F.col(text)).alias("_text"), F.col(doc_type).alias("_type"))
        .withColumn("_segments", segments)
        .withColumn("_segments", F.when(F.size("_segments") > 0, F.col("_segments")).otherwise(F.array("_text")))
        .withColumn("_size", F.when(coded, CODE_SIZE).otherwise(TEXT_SIZE))
        .withColumn("_runs", merge_runs()("_text", "_segments", "_size"))
    )

    bodies = F.transform(
        F.col("_runs"),
        lambda r: F.struct(
            r["at"].alias("at"),
            F.array_join(F.slice(F.col("_segments"), r["first"] + 1, r["n"]), "\n").alias("body"),
        ),
    )
    staged = staged.withColumn("_bodies", bodies)

    def windowed(piece: Column) -> Column:
        cut = F.when(F.col("_size") == CODE_SIZE, windows(piece["body"], CODE_SIZE, CODE_OVERLAP)).otherwise(
            windows(piece["body"], TEXT_SIZE, TEXT_OVERLAP)
        )
        return F.transform(cut, lambda w: F.struct((piece["at"] + w["at"]).alias("at"), w["body"].alias("body")))

    pieces = F.flatten(F.transform(F.col("_bodies"), windowed))
    # The outer form: posexplode would infer a filter that evaluates the pieces twice.
    rows = staged.select(*keys, F.posexplode_outer(pieces).alias("chunk_index", "_piece"))
    return rows.where(F.col("_piece").isNotNull()).select(
        *keys,
        "chunk_index",
        F.col("_piece.at").alias("char_start"),
        (F.col("_piece.at") + F.length("_piece.body")).alias("char_end"),
        F.col("_piece.body").alias("content"),
    )


def chunk_rows(docs: DataFrame, keys: list[str], size: int, overlap: int, text: str = "text") -> DataFrame:
    """Plain sliding windows over the whole text, without a split by meaning."""
    rows = docs.select(*keys, F.posexplode_outer(windows(F.col(text), size, overlap)).alias("chunk_index", "w"))
    return rows.where(F.col("w").isNotNull()).select(
        *keys,
        "chunk_index",
        F.col("w.at").alias("char_start"),
        (F.col("w.at") + F.length("w.body")).alias("char_end"),
        F.col("w.body").alias("content"),
    )

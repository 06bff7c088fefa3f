"""Cross-site line dedup: lines found on many sites are boilerplate.

The spread of a line is the number of distinct sites that have it. HyperLogLog sketches per line
hash are merged by aggregation, partly before the shuffle, so that a line on half of all rows
costs a task no more than any other. Where a sketch lies so near the threshold that its error
could decide, the distinct sites of that line are counted exactly.

Defined cases: a null text has no lines; lines are compared without spaces, tabs and carriage
returns at their ends and lines without anything else stay; a null site is a site of its own;
rows with the same id are handled one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.llm.tables import prefixed, stored

#: log2 of a sketch's registers, and the standard errors within which a line is counted exactly.
LG_REGISTERS, ERRORS = 12, 6
TRIM = " \t\r"


def line_hash(line: Column) -> Column:
    """128 bits: two 64-bit hashes of the trimmed line."""
    trimmed = F.btrim(line, F.lit(TRIM))
    return F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit(1), trimmed).alias("b"))


def _hashes(text: Column) -> Column:
    """An entry per line of the text, null for a line without content."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(F.btrim(x, F.lit(TRIM)) != "", line_hash(x)))


def boilerplate(docs: DataFrame, min_sites: int) -> DataFrame:
    """Hashes (a, b) of lines on `min_sites` distinct sites or more. docs: text, site."""
    lines = docs.select(F.explode(F.array_compact(_hashes(F.col("text")))).alias("h"), F.coalesce("site", F.lit("\0")).alias("site"))
    lines = lines.select("h.a", "h.b", "site")
    spread = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_REGISTERS)))
    band = max(1.0, ERRORS * 1.04 / math.sqrt(1 << LG_REGISTERS) * min_sites)
    likely = lines.groupBy("a", "b").agg(spread.alias("spread")).where(F.col("spread") >= min_sites - band)
    likely = stored(likely, "line-spread")
    near = likely.where(F.col("spread") <= min_sites + band).select("a", "b")
    exact = lines.join(near, ["a", "b"], "left_semi").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    certain = likely.where(F.col("spread") > min_sites + band).select("a", "b")
    return certain.unionByName(exact.where(F.col("n") >= min_sites).select("a", "b"))


def drop_boilerplate(
    docs: DataFrame, min_sites: int = 5, *, doc_id: str = "doc_id", text: str = "text", site: str = "source"
) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed and the text that is left (null if it was null).

    Only the numbers of lines to remove travel; rows are told apart by id and text.
    """
    narrow = prefixed(docs, doc_id=doc_id, text=text, site=site)
    known = stored(boilerplate(narrow.select("text", F.col("site").cast("string").alias("site")), min_sites), "boilerplate")
    keyed = narrow.select("doc_id", "text", F.xxhash64("text").alias("key"))
    rows = keyed.select("doc_id", "key", F.posexplode(_hashes(F.col("text"))).alias("line", "h")).where(F.col("h").isNotNull())
    hits = rows.select("doc_id", "key", "line", "h.a", "h.b").join(known, ["a", "b"], "left_semi")
    hits = hits.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_set("line").alias("gone"))
    hits = stored(hits, "lines-to-remove")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    lines = F.split("text", "\n")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.filter(lines, lambda x, i: ~F.array_contains("gone", i))
    # A sort-merge join whatever the size of the hits, so that the plan does not change with the input.
    return keyed.hint("merge").join(hits, same, "left").select(
        "doc_id",
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
        F.size(gone).cast("bigint").alias("n_removed"),
        F.when(F.size(gone) == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )

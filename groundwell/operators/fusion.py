"""Hybrid retrieval for a whole batch of requests in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwell.functions.text import Tokenizer, tokenize
from groundwell.operators import lexical, vectors
from groundwell.operators.access import allowed, unrestricted
from groundwell.operators.lexical import LexicalIndex
from groundwell.operators.vector_index import VectorIndex
from groundwell.session import fits_broadcast, materialize, narrow

# Fusion constant, first page factor, widest page factor.
RRF_K, PAGE_FACTOR, MAX_PAGE_FACTOR = 60, 3, 12


def rrf(vector_hits: DataFrame, lexical_hits: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Reciprocal-rank fusion, which is a full outer join of two ranked lists.

    vector_hits: *keys, chunk_id, similarity, vector_rank; lexical_hits: *keys, chunk_id,
    bm25_rank. Equal sums go to the better vector rank, then to the better BM25 rank.
    Returns *keys, rank (from 1), chunk_id, rrf_score, vector_score.
    """
    none_int, none_double = F.lit(None).cast("int"), F.lit(None).cast("double")
    both = vector_hits.select(
        *keys, "chunk_id", "similarity", "vector_rank", none_int.alias("bm25_rank")
    ).unionByName(
        lexical_hits.select(
            *keys, "chunk_id", none_double.alias("similarity"), none_int.alias("vector_rank"), "bm25_rank"
        )
    )

    def part(rank: str):
        return F.coalesce(F.sum(1.0 / (F.lit(RRF_K + 1) + F.col(rank))), F.lit(0.0))

    fused = both.groupBy(*keys, "chunk_id").agg(
        F.round(part("vector_rank") + part("bm25_rank"), 12).alias("rrf_score"),
        F.coalesce(F.max("similarity"), F.lit(0.0)).alias("vector_score"),
        F.min("vector_rank").alias("vr"),
        F.min("bm25_rank").alias("br"),
    )
    order = Window.partitionBy(*keys).orderBy(
        F.desc("rrf_score"), F.asc_nulls_last("vr"), F.asc_nulls_last("br")
    )
    return (
        fused.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(*keys, "rank", "chunk_id", "rrf_score", "vector_score")
    )


def candidates(
    requests: DataFrame,
    index: LexicalIndex | None,
    chunk_vectors: DataFrame | VectorIndex,
    depth: int,
    tokenizer: Tokenizer = tokenize,
    small_queries: bool | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Ranked vector and BM25 candidates to `depth`, both before any access rule."""
    asked = requests.select("query_id", F.col("workspace_id").alias("grp"), "vector")
    if isinstance(chunk_vectors, VectorIndex):
        vec = chunk_vectors.top_k(asked, depth)
    else:
        items = chunk_vectors.select(F.col("chunk_id").alias("item_id"), F.col("workspace_id").alias("grp"), "vector")
        vec = vectors.top_k(asked, items, depth, small_queries=small_queries)
    vec = vec.withColumnRenamed("item_id", "chunk_id")
    if index is None:
        return vec, None
    # A small batch of requests may still hold long texts, so the terms are counted apart.
    return vec, lexical.top_k(index, requests, depth, tokenizer, False if small_queries is False else None)


def hybrid(
    requests: DataFrame,
    chunks: DataFrame,
    index: LexicalIndex | None,
    chunk_vectors: DataFrame | VectorIndex,
    k: int = 5,
    tokenizer: Tokenizer = tokenize,
    small_queries: bool | None = None,
) -> DataFrame:
    """Top k chunks per request under its access rules.

    requests: query_id, workspace_id, query, vector, accessible_task_ids,
    can_view_restricted. Without an index the vector list alone is used.

    Both lists are read to the wider page once. A request takes the first page, or the
    wider one if it is restricted, the first page filled fewer than k places, and a list
    had a full first page, so more could follow. Vector ranks count what the access rule
    left over, BM25 ranks the list before it.
    Returns query_id, rank, chunk_id, rrf_score, vector_score, refetched.
    """
    first, wide = PAGE_FACTOR * k, min(2 * PAGE_FACTOR, MAX_PAGE_FACTOR) * k
    if small_queries is None:
        small_queries = fits_broadcast(requests, vectors.QUERY_BLOCK)
    vec, lex = candidates(requests, index, chunk_vectors, wide, tokenizer, small_queries)
    pool = vec.withColumn("bm25_rank", F.lit(None).cast("int"))
    if lex is not None:
        pool = pool.unionByName(lex.drop("score"), allowMissingColumns=True)
    pool = pool.groupBy("query_id", "chunk_id").agg(
        F.max("similarity").alias("similarity"),
        F.max("vector_rank").alias("raw_vr"),
        F.max("bm25_rank").alias("br"),
    )
    # At most 2 * wide rows per request, and read twice: to find their chunks, and to rank.
    pool = materialize(pool)
    marks = narrow(chunks.select("chunk_id", "task_id", "sensitivity_level"), pool, ["chunk_id"], small_queries)
    tasks, can_view = F.col("accessible_task_ids"), F.col("can_view_restricted")
    rule = allowed(tasks, can_view, F.col("task_id"), F.col("sensitivity_level"))
    judged = (
        pool.join(marks, "chunk_id", "left")
        .join(requests.select("query_id", "accessible_task_ids", "can_view_restricted"), "query_id")
        .withColumn("open", unrestricted(tasks, can_view))
        .withColumn("ok", F.col("open") | F.coalesce(rule, F.lit(False)))
    )
    w = Window.partitionBy("query_id")
    vr, br, ok = F.col("raw_vr"), F.col("br"), F.col("ok")
    kept = F.count_if(ok & (F.coalesce(vr < first, F.lit(False)) | F.coalesce(br < first, F.lit(False)))).over(w)
    full = (F.count_if(vr < first).over(w) >= first) | (F.count_if(br < first).over(w) >= first)
    paged = judged.withColumn("refetched", ~F.col("open") & (kept < k) & full).withColumn(
        "page", F.when(F.col("refetched"), wide).otherwise(first)
    )
    vec_place = F.when(ok & (vr < F.col("page")), vr)
    ranked = paged.withColumn("br", F.when(ok & (br < F.col("page")), br)).withColumn(
        "vr",
        F.when(
            vec_place.isNotNull(),
            F.row_number().over(w.orderBy(F.asc_nulls_last(vec_place))) - 1,
        ),
    )
    part = lambda rank: F.coalesce(1.0 / (F.lit(RRF_K + 1) + rank), F.lit(0.0))
    fused = ranked.where(F.col("vr").isNotNull() | F.col("br").isNotNull()).select(
        "query_id", "chunk_id", "refetched", "vr", "br",
        F.round(part(F.col("vr")) + part(F.col("br")), 12).alias("rrf_score"),
        F.when(F.col("vr").isNotNull(), F.col("similarity")).otherwise(0.0).alias("vector_score"),
    )
    order = w.orderBy(F.desc("rrf_score"), F.asc_nulls_last("vr"), F.asc_nulls_last("br"))
    return (
        fused.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "chunk_id", "rrf_score", "vector_score", "refetched")
    )

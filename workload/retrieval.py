"""Retrieval queries: lexical, vector, hybrid, access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.functions.text import tokenize
from groundwell.operators import fusion, lexical, vector_index, vectors
from groundwell.operators.access import allowed
from groundwell.session import fits_broadcast, scan_partitions, scratch_dir
from workload import bindings as b

# Depth of the candidate lists: five results, first page times three, wide page times six.
K, WIDE = 5, 30

TOKENS = "regexp_extract_all(lower({0}), '[가-힣]+|[a-z0-9_]+')"

# Same formulas as the lexical operator, for every query term of every request.
BM25 = f"""
tok AS (SELECT workspace_id, chunk_id, {TOKENS.format('content')} AS tokens FROM chunks),
docs AS (SELECT workspace_id, chunk_id, tokens, len(tokens) AS dl FROM tok WHERE len(tokens) > 0),
post AS (SELECT workspace_id, chunk_id, dl, term, count(*) AS tf
         FROM (SELECT workspace_id, chunk_id, dl, unnest(tokens) AS term FROM docs) GROUP BY ALL),
corpus AS (SELECT workspace_id, count(*) AS n, avg(dl) AS avgdl FROM docs GROUP BY 1),
dfs AS (SELECT p.workspace_id, term, count(*) AS df, any_value(n) AS n
        FROM post p JOIN corpus c USING (workspace_id) GROUP BY 1, 2),
raw AS (SELECT *, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs),
terms AS (SELECT r.workspace_id, r.term, r.df,
                 CASE WHEN r.raw < 0 THEN 0.25 * f.m ELSE r.raw END AS idf
          FROM raw r JOIN (SELECT workspace_id, avg(raw) AS m FROM raw GROUP BY 1) f USING (workspace_id))"""

BM25_RANKED = f"""{BM25},
qt AS (SELECT query_id, workspace_id, term, count(*) AS qtf
       FROM (SELECT query_id, workspace_id, unnest({TOKENS.format('query')}) AS term FROM requests) GROUP BY ALL),
scored AS (SELECT q.query_id, p.chunk_id,
             round(sum(q.qtf * t.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / c.avgdl))), 9) AS score
           FROM qt q JOIN terms t USING (workspace_id, term) JOIN post p USING (workspace_id, term)
                JOIN corpus c USING (workspace_id)
           GROUP BY 1, 2),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS bm25_rank
                       FROM scored WHERE score > 0) WHERE bm25_rank < {WIDE})"""

VEC_RANKED = f"""
sims AS (SELECT q.query_id, v.chunk_id, round(list_cosine_similarity(q.vector, v.vector), 9) AS similarity
         FROM requests q JOIN vectors v USING (workspace_id)),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) - 1 AS vector_rank
                       FROM sims) WHERE vector_rank < {WIDE})"""

BASE = f"WITH {b.CHUNKS},\n{b.VECTORS},\n{b.REQUESTS}"

RRF = """
pool AS (SELECT query_id, chunk_id, max(similarity) AS similarity, max(vector_rank) AS vr, max(bm25_rank) AS br
         FROM (SELECT query_id, chunk_id, similarity, vector_rank, NULL AS bm25_rank FROM vec
               UNION ALL SELECT query_id, chunk_id, NULL, NULL, bm25_rank FROM lex) GROUP BY 1, 2)"""

HYBRID_ACL = f"""{RRF},
judged AS (
  SELECT p.*, (q.accessible_task_ids IS NULL AND q.can_view_restricted) AS open,
         coalesce((q.accessible_task_ids IS NULL OR c.task_id IS NULL
                   OR list_contains(q.accessible_task_ids, c.task_id))
                  AND (q.can_view_restricted OR c.sensitivity_level <> 'restricted'), false) AS ok
  FROM pool p JOIN requests q USING (query_id) LEFT JOIN chunks c USING (chunk_id)),
need AS (
  SELECT query_id, NOT bool_and(open)
         AND count(*) FILTER ((open OR ok) AND (coalesce(vr < 15, false) OR coalesce(br < 15, false))) < 5
         AND (count(*) FILTER (vr < 15) >= 15 OR count(*) FILTER (br < 15) >= 15) AS refetched
  FROM judged GROUP BY 1),
paged AS (SELECT j.*, n.refetched, CASE WHEN n.refetched THEN 30 ELSE 15 END AS page
          FROM judged j JOIN need n USING (query_id) WHERE j.open OR j.ok),
vok AS (SELECT query_id, chunk_id, refetched, similarity,
               row_number() OVER (PARTITION BY query_id ORDER BY vr) - 1 AS vr
        FROM paged WHERE vr < page),
lok AS (SELECT query_id, chunk_id, refetched, br FROM paged WHERE br < page),
fused AS (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.chunk_id, l.chunk_id) AS chunk_id,
                 coalesce(v.refetched, l.refetched) AS refetched, v.vr, l.br,
                 round(coalesce(1.0::DOUBLE / (61 + v.vr), 0) + coalesce(1.0::DOUBLE / (61 + l.br), 0), 12) AS rrf_score,
                 coalesce(v.similarity, 0.0) AS vector_score
          FROM vok v FULL JOIN lok l ON v.query_id = l.query_id AND v.chunk_id = l.chunk_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
                                 ORDER BY rrf_score DESC, vr ASC NULLS LAST, br ASC NULLS LAST) AS rank FROM fused)
         WHERE rank <= 5)"""

HITS = f"{BASE},{BM25_RANKED},{VEC_RANKED},{HYBRID_ACL}"


# Where the index of a folder of tables lies, for the application that built it.
_KEPT: dict[tuple[str, str], str] = {}


def build(spark: SparkSession, sf: str, chunks: DataFrame | None = None, **options) -> str:
    """Build an index and return its path."""
    path = scratch_dir(spark, "index")
    chunks = b.chunks(spark, sf) if chunks is None else chunks
    lexical.build_index(chunks, partitions=scan_partitions(chunks), path=path, **options)
    return path


def index_of(spark: SparkSession, sf: str) -> lexical.LexicalIndex:
    """The index of the tables' chunks: built by the first query that needs it, then loaded."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _KEPT:
        _KEPT[key] = build(spark, sf)
    return lexical.LexicalIndex.load(spark, _KEPT[key])


def hybrid_hits(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    chunks = b.chunks(spark, sf)
    return fusion.hybrid(
        b.requests(spark, sf), chunks, index_of(spark, sf), b.chunk_vectors(spark, sf), k
    )


def hybrid_rrf_acl(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid_hits(spark, sf).select(
        "query_id", "rank", "chunk_id",
        F.round("rrf_score", 6).alias("rrf_score"), F.round("vector_score", 6).alias("vector_score"), "refetched",
    )


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    index = index_of(spark, sf)
    vec, lex = fusion.candidates(b.requests(spark, sf), index, b.chunk_vectors(spark, sf), 3 * K)
    return fusion.rrf(vec, lex, K).select(
        "query_id", "rank", "chunk_id",
        F.round("rrf_score", 6).alias("rrf_score"), F.round("vector_score", 6).alias("vector_score"),
    )


def vector_only_acl(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval with the lexical branch off."""
    hits = fusion.hybrid(b.requests(spark, sf), b.chunks(spark, sf), None, b.chunk_vectors(spark, sf), K)
    return hits.select("query_id", "rank", "chunk_id", F.round("vector_score", 6).alias("vector_score"), "refetched")


def bm25_context(spark: SparkSession, sf: str) -> DataFrame:
    """Every other chunk is indexed with a generated context in front."""
    context = F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit("about "), F.col("source_type")))
    path = build(spark, sf, b.chunks(spark, sf).withColumn("context", context), context="context")
    return lexical.top_k(lexical.LexicalIndex.load(spark, path), b.requests(spark, sf), K).withColumn(
        "score", F.round("score", 6)
    )


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    index = index_of(spark, sf)
    return lexical.top_k(index, b.requests(spark, sf), K).withColumn("score", F.round("score", 6))


def bm25_topk_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """The same search by bounds of blocks, whatever the size of the tables."""
    found = lexical.top_k(index_of(spark, sf), b.requests(spark, sf), K, prune=True)
    return found.withColumn("score", F.round("score", 6))


def index_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """An index of older texts of which two workspaces are refreshed with the texts of now."""
    chunks = b.chunks(spark, sf)
    path = build(spark, sf, chunks.withColumn("content", F.replace("content", F.lit("e"), F.lit("a"))))
    touched = chunks.select("workspace_id").distinct().where(F.col("workspace_id").isin("ws1", "ws3"))
    index = lexical.refresh_index(spark, path, chunks, touched)
    return lexical.top_k(index, b.requests(spark, sf), K).withColumn("score", F.round("score", 6))


def bm25_corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    index = index_of(spark, sf)
    corpus = F.broadcast(index.corpus) if fits_broadcast(index.corpus) else index.corpus
    return index.terms.join(corpus, "workspace_id").select(
        "workspace_id", "term", "df", "n",
        F.round("avgdl", 6).alias("avgdl"), F.round(lexical.idf(), 6).alias("idf"),
    )


def tokenize_terms(spark: SparkSession, sf: str) -> DataFrame:
    text = b.table(spark, sf, "documents").select("text").unionAll(
        b.table(spark, sf, "conversations").select("text")
    )
    return text.select(F.explode_outer(tokenize(F.col("text"))).alias("term")).where("term is not null").groupBy("term").agg(
        F.count(F.lit(1)).alias("n")
    )


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.top_k(
        b.requests(spark, sf).select("query_id", F.col("workspace_id").alias("grp"), "vector"),
        b.chunk_vectors(spark, sf).select(
            F.col("chunk_id").alias("item_id"), F.col("workspace_id").alias("grp"), "vector"
        ),
        K,
    ).select("query_id", F.col("item_id").alias("chunk_id"), F.round("similarity", 6).alias("similarity"), "vector_rank")


def vector_topk_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a kept table of unit vectors in cells."""
    rows = b.chunk_vectors(spark, sf).select(F.col("chunk_id").alias("item_id"), F.col("workspace_id").alias("grp"), "vector")
    index = vector_index.build(rows, scratch_dir(spark, "vector-index"))
    asked = b.requests(spark, sf).select("query_id", F.col("workspace_id").alias("grp"), "vector")
    return index.top_k(asked, K).select("query_id", F.col("item_id").alias("chunk_id"), F.round("similarity", 6).alias("similarity"), "vector_rank")


def acl_visible_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Visible chunks per workspace and kind of access right."""
    rights = b.requests(spark, sf).select("workspace_id", "accessible_task_ids", "can_view_restricted").distinct()
    rule = allowed(
        F.col("accessible_task_ids"), F.col("can_view_restricted"), F.col("task_id"), F.col("sensitivity_level")
    )
    # Chunks enter the join as counts per access mark, a handful of rows per workspace.
    marks = b.chunks(spark, sf).groupBy("workspace_id", "task_id", "sensitivity_level").agg(
        F.count(F.lit(1)).alias("n")
    )
    keys = ["workspace_id", F.array_join("accessible_task_ids", ",").alias("tasks"), "can_view_restricted"]
    return (
        rights.join(marks, "workspace_id")
        .groupBy(*keys)
        .agg(F.sum(F.when(rule, F.col("n")).otherwise(0)).alias("visible"), F.sum("n").alias("total"))
    )


QUERIES = {
    "bm25_topk": bm25_topk,
    "bm25_topk_pruned": bm25_topk_pruned,
    "bm25_context": bm25_context,
    "index_refresh": index_refresh,
    "vector_only_acl": vector_only_acl,
    "bm25_corpus_stats": bm25_corpus_stats,
    "tokenize_terms": tokenize_terms,
    "vector_topk": vector_topk,
    "vector_topk_indexed": vector_topk_indexed,
    "hybrid_rrf": hybrid_rrf,
    "hybrid_rrf_acl": hybrid_rrf_acl,
    "acl_visible_chunks": acl_visible_chunks,
}

ORACLE = {
    "bm25_topk": f"{BASE},{BM25_RANKED} SELECT query_id, chunk_id, round(score, 6) AS score, bm25_rank FROM lex WHERE bm25_rank < {K}",
    "bm25_topk_pruned": f"{BASE},{BM25_RANKED} SELECT query_id, chunk_id, round(score, 6) AS score, bm25_rank FROM lex WHERE bm25_rank < {K}",
    "bm25_context": (f"{BASE},{BM25_RANKED}").replace(
        "regexp_extract_all(lower(content)",
        "regexp_extract_all(lower(CASE WHEN chunk_id % 2 = 0 THEN 'about ' || source_type || chr(10) ELSE '' END || content)",
    ) + f" SELECT query_id, chunk_id, round(score, 6) AS score, bm25_rank FROM lex WHERE bm25_rank < {K}",
    "index_refresh": (f"{BASE},{BM25_RANKED}").replace(
        "regexp_extract_all(lower(content)",
        "regexp_extract_all(lower(CASE WHEN workspace_id IN ('ws1', 'ws3') THEN content ELSE replace(content, 'e', 'a') END)",
    ) + f" SELECT query_id, chunk_id, round(score, 6) AS score, bm25_rank FROM lex WHERE bm25_rank < {K}",
    "vector_only_acl": f"{BASE},{VEC_RANKED}, lex AS (SELECT NULL::BIGINT AS query_id, NULL::BIGINT AS chunk_id, NULL::BIGINT AS bm25_rank WHERE false),{HYBRID_ACL} SELECT query_id, rank, chunk_id, round(vector_score, 6) AS vector_score, refetched FROM hits",
    "bm25_corpus_stats": f"{BASE},{BM25} SELECT workspace_id, term, df, n, round(avgdl, 6) AS avgdl, round(idf, 6) AS idf FROM terms JOIN corpus USING (workspace_id)",
    "tokenize_terms": f"SELECT term, count(*) AS n FROM (SELECT unnest({TOKENS.format('text')}) AS term FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)) GROUP BY 1",
    "vector_topk": f"{BASE},{VEC_RANKED} SELECT query_id, chunk_id, round(similarity, 6) AS similarity, vector_rank FROM vec WHERE vector_rank < {K}",
    "vector_topk_indexed": f"{BASE},{VEC_RANKED} SELECT query_id, chunk_id, round(similarity, 6) AS similarity, vector_rank FROM vec WHERE vector_rank < {K}",
    "hybrid_rrf": f"""{BASE},{BM25_RANKED},{VEC_RANKED},{RRF}
      SELECT query_id, rank, chunk_id, round(s, 6) AS rrf_score, round(vs, 6) AS vector_score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vr ASC NULLS LAST, br ASC NULLS LAST) AS rank
        FROM (SELECT query_id, chunk_id, vr, br, CASE WHEN vr IS NULL THEN 0.0 ELSE similarity END AS vs,
                     round(coalesce(1.0::DOUBLE / (61 + vr), 0) + coalesce(1.0::DOUBLE / (61 + br), 0), 12) AS s
              FROM (SELECT query_id, chunk_id, similarity, CASE WHEN vr < 15 THEN vr END AS vr, CASE WHEN br < 15 THEN br END AS br FROM pool)
              WHERE vr IS NOT NULL OR br IS NOT NULL)) WHERE rank <= 5""",
    "hybrid_rrf_acl": f"{HITS} SELECT query_id, rank, chunk_id, round(rrf_score, 6) AS rrf_score, round(vector_score, 6) AS vector_score, refetched FROM hits",
    "acl_visible_chunks": f"""{BASE},
      rights AS (SELECT DISTINCT workspace_id, accessible_task_ids, can_view_restricted FROM requests)
      SELECT r.workspace_id, array_to_string(r.accessible_task_ids, ',') AS tasks, r.can_view_restricted,
             count(*) FILTER ((r.accessible_task_ids IS NULL OR c.task_id IS NULL OR list_contains(r.accessible_task_ids, c.task_id))
                              AND (r.can_view_restricted OR c.sensitivity_level <> 'restricted')) AS visible,
             count(*) AS total
      FROM rights r JOIN chunks c USING (workspace_id) GROUP BY 1, 2, 3""",
}

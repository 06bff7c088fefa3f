"""What follows retrieval: titles, contexts, reranking, grounding, cache, request records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.functions import text as t
from groundwell.functions import vector as V
from groundwell.operators import access, cache, grounding, hydrate, rerank
from groundwell.plans import metrics
from groundwell.plans import requests as plans
from groundwell.session import fits_broadcast, materialize
from workload import bindings as b
from workload.retrieval import HITS, hybrid_hits

HITS10 = HITS.replace("WHERE rank <= 5)", "WHERE rank <= 10)").replace("< 30)", "< 60)").replace(
    "bm25_rank < 30", "bm25_rank < 60").replace("vector_rank < 30", "vector_rank < 60").replace(
    "< 15", "< 30").replace(">= 15", ">= 30").replace("THEN 30 ELSE 15", "THEN 60 ELSE 30").replace("< 5\n", "< 10\n")


def dimension(spark: SparkSession, sf: str) -> DataFrame:
    """Pages, orders and parts as the parents of chunks."""
    docs = b.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("title"))
    commits = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderpriority"), F.lit("\nbody")).alias("commit_message"),
        F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("u"), F.col("o_custkey"))).alias("author_id"),
    )
    schemas = b.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("schema_name"), F.col("p_name").alias("table_name")
    )
    return hydrate.parents(docs, commits, schemas)


PARENTS = """parents AS (
  SELECT 'document' AS source_type, page_id AS source_id, url AS title, NULL AS author_id FROM pages
  UNION ALL SELECT 'git_commit', o_orderkey, ('Order ' || o_orderpriority)[:72], CASE WHEN o_orderkey % 5 <> 0 THEN 'u' || o_custkey END FROM orders
  UNION ALL SELECT 'db_schema', p_partkey, p_brand || '.' || p_name, NULL FROM part)"""
TITLED = f"""{PARENTS},
titled AS (SELECT h.*, c.source_type, c.source_id, c.content, p.author_id,
  CASE c.source_type WHEN 'owner_answer' THEN '담당자 답변: ' || coalesce(c.owner_name, '담당자')
    WHEN 'document' THEN coalesce(p.title, 'Document #' || c.source_id) WHEN 'git_commit' THEN coalesce(p.title, 'Commit #' || c.source_id)
    ELSE coalesce(p.title, 'Schema #' || c.source_id) END AS title
  FROM hits h JOIN chunks c USING (chunk_id) LEFT JOIN parents p ON p.source_type = c.source_type AND p.source_id = c.source_id)"""


def titled_hits(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    hits = materialize(hybrid_hits(spark, sf, k))
    return hydrate.hydrate(hits, b.chunks(spark, sf), dimension(spark, sf), fits_broadcast(hits))


def hydrate_titles(spark: SparkSession, sf: str) -> DataFrame:
    return titled_hits(spark, sf).select(
        "query_id", "rank", "chunk_id", "source_type", "source_id", "title", "author_id", F.md5("content").alias("content_md5")
    )


def citations(spark: SparkSession, sf: str) -> DataFrame:
    return hydrate.citations(titled_hits(spark, sf)).select(
        "query_id",
        F.size("citations").alias("n"),
        F.array_join(F.transform("citations", lambda c: F.concat_ws("|", c["source_type"], c["source_id"], c["chunk_id"], c["title"])), ";").alias("cited"),
    )


def context_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Judge prompts: the first three hits, each cut to 600 characters."""
    ctx = hydrate.contexts(titled_hits(spark, sf), 3, 600)
    asked = b.requests(spark, sf).select("query_id", "query")
    return asked.join(ctx, "query_id").select("query_id", F.md5(t.judge_prompt(F.col("query"), F.col("context"))).alias("prompt_md5"))


def rerank_prompts(spark: SparkSession, sf: str) -> DataFrame:
    shown = hydrate.rerank_prompts(b.requests(spark, sf), titled_hits(spark, sf))
    return shown.select("query_id", F.md5("prompt").alias("prompt_md5"))


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    ids = F.concat_ws(", ", i % 10 + 1, F.lit("99"), (i * 3) % 10 + 1, i % 10 + 1, F.lit("true"), F.lit('"4"'), F.lit("2.5"), (i * 7) % 10 + 1)
    reply = (
        F.when(i % 9 == 0, "no json")
        .when(i % 9 == 1, '{"ranking": "1, 2"}')
        .when(i % 9 == 2, '{"ranking": [99, 0, -1]}')
        .when(i % 2 == 0, F.concat(F.lit('{"ranking": ['), ids, F.lit("]}")))
        .otherwise(F.concat(F.lit("["), ids, F.lit("]")))
    )
    return b.table(spark, sf, "benchmark").select(i.alias("query_id"), reply.alias("reply"), F.when(i % 13 == 5, "timeout").alias("error"))


def rerank_apply(spark: SparkSession, sf: str) -> DataFrame:
    hits = titled_hits(spark, sf, 10)
    return rerank.apply_ranking(hits, _replies(spark, sf), 5).select("query_id", "chunk_id", F.col("rank").alias("old_rank"), "new_rank", "stage")


def _judgments(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    return b.table(spark, sf, "benchmark").where("item_id % 8 <> 7").select(
        i.alias("query_id"), F.when(i % 11 != 3, i % 3 != 0).alias("is_groundable"), F.when(i % 7 != 2, (i % 10) / 10).alias("confidence"),
        F.when(i % 10 == 9, "timeout").alias("error"),
    )


# Similarities of the test vectors are low, so the gate is set among them.
GATE = 0.25


def assessed(spark: SparkSession, sf: str, hits: DataFrame) -> DataFrame:
    return grounding.assess(b.requests(spark, sf), hits, _judgments(spark, sf), GATE)


def grounding_decision(spark: SparkSession, sf: str) -> DataFrame:
    out = assessed(spark, sf, titled_hits(spark, sf))
    return out.withColumn("confidence", F.round("confidence", 6))


ASSESSED = f"""j AS (SELECT item_id AS query_id, CASE WHEN item_id % 11 <> 3 THEN item_id % 3 <> 0 END AS g, CASE WHEN item_id % 7 <> 2 THEN (item_id % 10) / 10 END AS c,
    CASE WHEN item_id % 10 = 9 THEN 'timeout' END AS err, true AS called FROM benchmark WHERE item_id % 8 <> 7),
best AS (SELECT query_id, max(vector_score) AS best, max(chunk_id) AS x FROM titled GROUP BY 1),
own AS (SELECT query_id, author_id AS owner FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, rank) AS n FROM titled
        WHERE source_type = 'git_commit' AND author_id IS NOT NULL) WHERE n = 1),
s AS (SELECT r.query_id, best, owner, g, c, best IS NULL OR best < {GATE} AS below, called IS NULL OR err IS NOT NULL AS failed, g IS NULL OR c IS NULL AS unread
      FROM requests r LEFT JOIN best USING (query_id) LEFT JOIN own USING (query_id) LEFT JOIN j USING (query_id)),
assessed AS (SELECT query_id, best, CASE WHEN below THEN false WHEN failed OR unread THEN true ELSE g END AS is_groundable,
    CASE WHEN below THEN 0.0 WHEN failed OR unread THEN best ELSE c END AS confidence,
    CASE WHEN below THEN 'threshold' WHEN failed OR unread THEN 'llm_fallback' ELSE 'llm' END AS stage,
    CASE WHEN below THEN NULL WHEN failed THEN 'llm_error' WHEN unread THEN 'parse_error' END AS fallback_reason,
    CASE WHEN NOT CASE WHEN below THEN false WHEN failed OR unread THEN true ELSE g END THEN owner END AS suggested_owner_id FROM s)"""


# ---------------------------------------------------------------- cache
def _space(i):
    tasks = F.when(i % 3 == 1, F.lit(None).cast("array<string>")).when(i % 3 == 2, F.array().cast("array<string>")).otherwise(
        F.when(i % 2 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    )
    return cache.namespace(F.concat(F.lit("ws"), i % 2), F.lit("qa"), tasks, i % 3 == 0, F.lit("persona-v1"), F.lit("m0"))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("vec_id")
    return b.table(spark, sf, "embeddings").where("vec_id % 2 = 0").select(
        i.alias("entry_id"), F.concat(F.lit("ws"), i % 2).alias("workspace_id"), _space(F.floor(i / 2)).alias("namespace"),
        V.as_double(F.col("embedding")).alias("vector"), i.cast("double").alias("at"),
    )


def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as requests all over the time in which entries are stored; entries live for a fifth of that time."""
    i = F.col("vec_id")
    table = b.table(spark, sf, "embeddings")
    span = table.agg(F.max("vec_id")).first()[0] or 0
    asked = table.where("vec_id % 2 = 1").select(
        i.alias("query_id"), _space(F.floor(i / 2)).alias("namespace"), V.as_double(F.col("embedding")).alias("vector"),
        ((i * 7919) % (span + 1)).cast("double").alias("at"),
    )
    found = cache.lookup(asked, _entries(spark, sf), direct=0.45, floor=0.3, ttl=float((span + 1) // 5))
    return found.withColumn("similarity", F.round("similarity", 6))


def cache_lru(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that survive with room for 40 per workspace, and how many there were."""
    i = F.col("event_id")
    rows = b.table(spark, sf, "events").select(
        i.alias("entry_id"), F.concat(F.lit("ws"), F.col("user_id") % 4).alias("workspace_id"), ((i * 7919) % 100003).alias("last_used")
    )
    kept = cache.keep_recent(rows, 40)
    return kept.join(cache.sizes(rows), "workspace_id").select("workspace_id", "entry_id", "last_used", "stored")


def cached_answer_access(spark: SparkSession, sf: str) -> DataFrame:
    """Cached answers cite three chunks each; every request asks for two answers and one that does not exist."""
    i = F.col("doc_id")
    cited = b.table(spark, sf, "documents").select(
        F.floor(i / 8).cast("long").alias("entry_id"), F.when(i % 41 == 3, i + 100000).otherwise(i).alias("chunk_id")
    )
    asked = b.requests(spark, sf).select("query_id", "accessible_task_ids", "can_view_restricted")
    entries = asked.select("query_id", F.explode(F.array((F.col("query_id") % 20), F.col("query_id") + 1, F.lit(999999))).alias("entry_id"))
    return access.still_valid(entries, cited, asked, b.chunks(spark, sf))


def verify_band(spark: SparkSession, sf: str) -> DataFrame:
    """Settings of the cache: sizes and keys of parts as thresholds in quarters."""
    p = b.table(spark, sf, "part").select(
        "p_partkey", ((F.col("p_size") % 5) / 4.0).alias("direct"), ((F.col("p_partkey") % 5) / 4.0).alias("candidate")
    )
    return p.select("p_partkey", cache.band_warning(F.col("direct"), F.col("candidate")).alias("warning"))


# ---------------------------------------------------------------- request records
def _records(spark: SparkSession, sf: str) -> DataFrame:
    """One record per request, with cache hits and blocked requests among them."""
    hits = materialize(titled_hits(spark, sf))
    i = F.col("item_id")
    calls = b.table(spark, sf, "benchmark").select(
        i.alias("query_id"), F.concat(F.lit("session-"), i).alias("session_id"), F.lit("qa").alias("role"), (i % 5).alias("history_len"),
        (i % 6 == 0).alias("cache_hit"), (i % 2 == 0).alias("cache_enabled"), F.when(i % 6 == 0, 0.9).alias("cache_confidence"),
        F.when(i % 4 == 0, F.struct(F.lit("m1").alias("model"), i.alias("prompt_tokens"), F.lit(3).cast("long").alias("completion_tokens"))).alias("rewrite"),
        F.struct(F.lit("m2").alias("model"), (i + 1).alias("prompt_tokens"), F.lit(4).cast("long").alias("completion_tokens")).alias("grounding"),
        F.struct(F.lit("m0").alias("model"), (i * 10).alias("prompt_tokens"), F.lit(50).cast("long").alias("completion_tokens")).alias("main"),
        F.when(i % 7 != 0, F.concat(F.lit("answer "), i)).alias("answer"), F.lit(False).alias("context_truncated"),
        F.create_map(F.lit("retrieve_ms"), (i * 1.5), F.lit("total_ms"), (i * 20.0)).alias("stages"),
        F.when(i % 3 == 0, i % 2).alias("acl_refetch_count"), F.when(i % 2 == 0, (i % 10) / 10).alias("cache_similarity"),
        F.when(i % 2 == 0, i / 4).alias("cache_lookup_ms"), F.when(i % 4 == 0, i / 2).alias("cache_verify_ms"),
        F.when(i % 4 == 0, F.when(i % 8 == 0, "yes").otherwise("limit")).alias("cache_verify_result"),
        F.when(i % 5 != 0, "applied").alias("rerank_stage"), F.when(i % 5 != 0, i + 7).alias("rerank_prompt_tokens"),
        F.when(i % 5 != 0, F.lit(9)).alias("rerank_completion_tokens"), F.when(i % 5 != 0, F.lit(10)).alias("rerank_candidates"),
    )
    return plans.request_records(b.requests(spark, sf), calls, hits, assessed(spark, sf, hits))


def request_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).select(
        "query_id", "session_id_hash", "workspace_id", "turn", "retrieve_ms", "total_ms", "chunk_count", F.round("top_similarity", 6).alias("top_similarity"),
        "is_groundable", F.round("confidence", 6).alias("confidence"), "grounding_stage", "access_filtered", "main_prompt_tokens", "rewrite_prompt_tokens",
        "grounding_prompt_tokens", "cache_hit", "storable", *plans.OPTIONAL,
    )


def request_cache_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Request records as the input of the cache report."""
    return metrics.cache_summary(_records(spark, sf), ["workspace_id"]).select(
        "workspace_id", "enabled_count", "hit_count", F.round("hit_rate", 6).alias("hit_rate"), "verify_count", "verify_yes", "verify_no"
    )


QUERIES = {
    f.__name__: f
    for f in (hydrate_titles, citations, context_blocks, rerank_prompts, rerank_apply, grounding_decision, cache_lookup, cache_lru, cached_answer_access, verify_band, request_metrics, request_cache_summary)
}

SPACE = """'ws' || ({0} % 2) || '|' || CASE {0} % 3 WHEN 1 THEN 'any' WHEN 2 THEN 'none' ELSE 'a,b' END"""
ORACLE = {
    "hydrate_titles": f"{HITS},{TITLED} SELECT query_id, rank, chunk_id, source_type, source_id, title, author_id, md5(content) AS content_md5 FROM titled",
    "citations": f"""{HITS},{TITLED} SELECT query_id, count(*) AS n, string_agg(source_type || '|' || source_id || '|' || chunk_id || '|' || title, ';' ORDER BY rank) AS cited FROM titled GROUP BY 1""",
    "context_blocks": f"""{HITS},{TITLED}, c AS (SELECT query_id, string_agg('[' || rank || '] (' || source_type || ') ' || title || chr(10) || CASE WHEN length(content) > 600 THEN content[:600] || '…(생략)' ELSE content END,
      chr(10) || chr(10) ORDER BY rank) AS ctx FROM titled WHERE rank <= 3 GROUP BY 1)
      SELECT query_id, md5('질문: ' || query || chr(10) || chr(10) || '검색된 컨텍스트:' || chr(10) || ctx) AS prompt_md5 FROM requests JOIN c USING (query_id)""",
    "rerank_prompts": f"""{HITS},{TITLED}, c AS (SELECT query_id, string_agg('[' || rank || '] (' || title || ') ' || content[:600], chr(10) ORDER BY rank) AS lines FROM titled GROUP BY 1)
      SELECT query_id, md5('질문: ' || query || chr(10) || chr(10) || '후보:' || chr(10) || lines) AS prompt_md5 FROM requests JOIN c USING (query_id)""",
    "rerank_apply": f"""{HITS10},
      rep AS (SELECT item_id AS query_id, CASE WHEN item_id % 9 < 3 THEN []::BIGINT[] ELSE [item_id % 10 + 1, (item_id * 3) % 10 + 1, (item_id * 7) % 10 + 1] END AS ids, item_id % 13 = 5 AS failed FROM benchmark),
      x AS (SELECT h.query_id, h.chunk_id, h.rank, count(*) OVER (PARTITION BY h.query_id) AS n, list_position(ids, h.rank) AS pos, failed FROM hits h JOIN rep USING (query_id)),
      y AS (SELECT *, CASE WHEN n <= 5 THEN 'skipped_few' WHEN failed THEN 'fallback:timeout' WHEN coalesce(max(pos) OVER (PARTITION BY query_id), 0) = 0 THEN 'fallback:parse' ELSE 'applied' END AS stage FROM x),
      z AS (SELECT query_id, chunk_id, rank AS old_rank, stage, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN stage = 'applied' AND pos > 0 THEN pos END ASC NULLS LAST, rank) AS new_rank FROM y)
      SELECT * FROM z WHERE new_rank <= 5""",
    "grounding_decision": f"{HITS},{TITLED},{ASSESSED} SELECT query_id, is_groundable, round(confidence, 6) AS confidence, stage, fallback_reason, suggested_owner_id FROM assessed",
    "cache_lookup": f"""WITH e AS (SELECT vec_id AS entry_id, {SPACE.format('(vec_id // 2)')} AS ns, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 0),
      span AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
      q AS (SELECT vec_id AS query_id, {SPACE.format('(vec_id // 2)')} AS ns, embedding::DOUBLE[] AS v, (vec_id * 7919) % n AS asked_at, n // 5 AS ttl FROM embeddings, span WHERE vec_id % 2 = 1),
      s AS (SELECT query_id, entry_id, round(list_cosine_similarity(q.v, e.v), 9) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q.v, e.v), 9) DESC, entry_id) AS n FROM q JOIN e ON q.ns = e.ns AND entry_id BETWEEN asked_at - ttl AND asked_at)
      SELECT q.query_id, CASE WHEN sim >= 0.3 THEN entry_id END AS entry_id, CASE WHEN sim >= 0.3 THEN round(sim, 6) END AS similarity,
        CASE WHEN sim >= 0.45 THEN 'direct' WHEN sim >= 0.3 THEN 'candidate' ELSE 'miss' END AS outcome FROM q LEFT JOIN s ON s.query_id = q.query_id AND n = 1""",
    "cache_lru": """SELECT workspace_id, entry_id, last_used, stored FROM (SELECT 'ws' || (user_id % 4) AS workspace_id, event_id AS entry_id, (event_id * 7919) % 100003 AS last_used,
        count(*) OVER (PARTITION BY user_id % 4) AS stored, row_number() OVER (PARTITION BY user_id % 4 ORDER BY (event_id * 7919) % 100003 DESC, event_id DESC) AS n FROM events) WHERE n <= 40""",
    "cached_answer_access": f"""WITH {b.CHUNKS}, {b.REQUESTS},
      cited AS (SELECT doc_id // 8 AS entry_id, CASE WHEN doc_id % 41 = 3 THEN doc_id + 100000 ELSE doc_id END AS chunk_id FROM documents),
      e AS (SELECT query_id, accessible_task_ids AS ts, can_view_restricted AS v, unnest([query_id % 20, query_id + 1, 999999]) AS entry_id FROM requests),
      bad AS (SELECT DISTINCT e.query_id, e.entry_id FROM e JOIN cited USING (entry_id) LEFT JOIN chunks c USING (chunk_id)
              WHERE NOT coalesce((ts IS NULL OR c.task_id IS NULL OR list_contains(ts, c.task_id)) AND (v OR c.sensitivity_level <> 'restricted'), false) OR c.chunk_id IS NULL)
      SELECT query_id, entry_id FROM e WHERE (query_id, entry_id) NOT IN (SELECT query_id, entry_id FROM bad)""",
    "verify_band": """WITH n AS (SELECT p_partkey, (p_size % 5) / 4.0::DOUBLE AS d, (p_partkey % 5) / 4.0::DOUBLE AS c FROM part)
      SELECT p_partkey, CASE WHEN c > d THEN 'semantic cache verify never runs: candidate_threshold(' || c::VARCHAR || ') > threshold(' || d::VARCHAR || '); no candidate band'
        WHEN c = d THEN 'semantic cache verify never runs: candidate_threshold(' || c::VARCHAR || ') == threshold(' || d::VARCHAR || '); candidate band is empty' END AS warning FROM n""",
    "request_cache_summary": f"""WITH {b.REQUESTS} SELECT workspace_id, count(*) AS enabled_count, count(*) FILTER (query_id % 6 = 0) AS hit_count,
        round(100.0 * count(*) FILTER (query_id % 6 = 0) / count(*), 6) AS hit_rate, count(*) FILTER (query_id % 8 = 0) AS verify_count,
        count(*) FILTER (query_id % 8 = 0) AS verify_yes, 0 AS verify_no FROM requests WHERE query_id % 2 = 0 GROUP BY 1""",
    "request_metrics": f"""{HITS},{TITLED},{ASSESSED},
      n AS (SELECT query_id, count(*) AS chunk_count, max(vector_score) AS top FROM titled GROUP BY 1)
      SELECT query_id, sha256('session-' || query_id)[:12] AS session_id_hash, workspace_id, query_id % 5 // 2 + 1 AS turn, query_id * 1.5::DOUBLE AS retrieve_ms, query_id * 20.0::DOUBLE AS total_ms,
        coalesce(chunk_count, 0) AS chunk_count, round(coalesce(top, 0), 6) AS top_similarity, query_id % 6 = 0 OR is_groundable AS is_groundable,
        round(CASE WHEN query_id % 6 = 0 THEN 0.9 ELSE confidence END, 6) AS confidence, CASE WHEN query_id % 6 = 0 THEN 'cache' ELSE stage END AS grounding_stage,
        NOT (accessible_task_ids IS NULL AND can_view_restricted) AS access_filtered,
        CASE WHEN query_id % 6 = 0 OR NOT is_groundable THEN 0 ELSE query_id * 10 END AS main_prompt_tokens, CASE WHEN query_id % 4 = 0 THEN query_id END AS rewrite_prompt_tokens,
        CASE WHEN query_id % 6 <> 0 AND stage <> 'threshold' AND coalesce(fallback_reason, '') <> 'llm_error' THEN query_id + 1 END AS grounding_prompt_tokens, query_id % 6 = 0 AS cache_hit,
        query_id % 2 = 0 AND query_id % 6 <> 0 AND query_id % 5 = 0 AND is_groundable AND fallback_reason IS NULL AND query_id % 7 <> 0 AS storable,
        CASE WHEN query_id % 3 = 0 THEN query_id % 2 END AS acl_refetch_count, CASE WHEN query_id % 2 = 0 THEN (query_id % 10) / 10 END AS cache_similarity,
        CASE WHEN query_id % 2 = 0 THEN query_id / 4 END AS cache_lookup_ms, CASE WHEN query_id % 4 = 0 THEN query_id / 2 END AS cache_verify_ms,
        CASE WHEN query_id % 8 = 0 THEN 'yes' WHEN query_id % 4 = 0 THEN 'limit' END AS cache_verify_result, CASE WHEN query_id % 5 <> 0 THEN 'applied' END AS rerank_stage,
        CASE WHEN query_id % 5 <> 0 THEN query_id + 7 END AS rerank_prompt_tokens, CASE WHEN query_id % 5 <> 0 THEN 9 END AS rerank_completion_tokens,
        CASE WHEN query_id % 5 <> 0 THEN 10 END AS rerank_candidates
      FROM requests JOIN assessed USING (query_id) LEFT JOIN n USING (query_id)""",
}

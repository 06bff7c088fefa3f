"""Evaluation queries: cache sweeps, grounding, retrieval and rewrite quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.functions import replies
from groundwell.functions import vector as V
from groundwell.operators.access import allowed
from groundwell.plans import cache_eval, grounding_eval, retrieval_eval, rewrite_eval
from groundwell.session import materialize
from workload import bindings as b
from workload.retrieval import HITS, hybrid_hits

DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *(F.round(f.name, DIGITS).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in df.schema.fields)
    )


# ---------------------------------------------------------------- question pairs
def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring vectors as question pairs, similarities spread over the swept range."""
    e = b.table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 2).cast("long").alias("id"),
        (F.col("vec_id") % 2).alias("side"),
        V.as_double(F.col("embedding")).alias("v"),
        "label",
    )
    left = e.where("side = 0").select("id", F.col("v").alias("a"), F.col("label").alias("la"))
    right = e.where("side = 1").select("id", F.col("v").alias("b"), F.col("label").alias("lb"))
    i = F.col("id")
    return left.join(right, "id").select(
        "id",
        F.when(F.col("la") == F.col("lb"), cache_eval.SAME).otherwise(cache_eval.DIFFERENT).alias("kind"),
        F.round(0.8 + 0.2 * F.abs(V.cosine(F.col("a"), F.col("b"))), 9).alias("similarity"),
        F.when(i % 13 != 0, (i * 7) % 3 == 0).alias("verify_same"),
        F.when(i % 13 != 0, F.when((i * 7) % 3 == 0, "yes").when(i % 5 == 0, "invalid").otherwise("no")).alias("verify_outcome"),
        F.concat(F.lit("v"), i % 2 + 1).alias("verify_prompt_version"),
        F.lit("m0").alias("verify_model"),
        ((i * 37) % 997).cast("double").alias("verify_latency_ms"),
        (i % 300 + 50).alias("verify_prompt_tokens"),
        F.when(i % 4 != 0, i % 7).alias("verify_completion_tokens"),
    )


PAIRS = """pairs AS (
  SELECT a.vec_id // 2 AS id,
         CASE WHEN a.label = c.label THEN 'same_intent' ELSE 'different_intent' END AS kind,
         round(0.8 + 0.2 * abs(list_cosine_similarity(a.embedding::DOUBLE[], c.embedding::DOUBLE[])), 9) AS similarity,
         CASE WHEN (a.vec_id // 2) % 13 <> 0 THEN ((a.vec_id // 2) * 7) % 3 = 0 END AS verify_same,
         CASE WHEN (a.vec_id // 2) % 13 = 0 THEN NULL WHEN ((a.vec_id // 2) * 7) % 3 = 0 THEN 'yes'
              WHEN (a.vec_id // 2) % 5 = 0 THEN 'invalid' ELSE 'no' END AS verify_outcome,
         'v' || ((a.vec_id // 2) % 2 + 1) AS verify_prompt_version,
         'm0' AS verify_model, (((a.vec_id // 2) * 37) % 997)::DOUBLE AS verify_latency_ms,
         (a.vec_id // 2) % 300 + 50 AS verify_prompt_tokens,
         CASE WHEN (a.vec_id // 2) % 4 <> 0 THEN (a.vec_id // 2) % 7 END AS verify_completion_tokens
  FROM embeddings a JOIN embeddings c ON c.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"""

SWEEP = f"""WITH {PAIRS},
t AS (SELECT unnest([{', '.join(map(str, cache_eval.THRESHOLDS))}])::DOUBLE AS threshold),
c AS (SELECT threshold, count(*) FILTER (kind = 'same_intent' AND similarity >= threshold) AS same_hits,
             count(*) FILTER (kind = 'same_intent') AS same_total,
             count(*) FILTER (kind = 'different_intent' AND similarity >= threshold) AS diff_hits,
             count(*) FILTER (kind = 'different_intent') AS diff_total FROM pairs, t GROUP BY 1),
r AS (SELECT *, same_hits / nullif(same_total, 0) AS hit_rate, diff_hits / nullif(diff_total, 0) AS false_hit_rate,
             same_hits / nullif(same_hits + diff_hits, 0) AS precision FROM c),
swept AS (SELECT threshold, same_hits, same_total, diff_hits, diff_total, round(hit_rate, 6) AS hit_rate,
       round(false_hit_rate, 6) AS false_hit_rate, round(precision, 6) AS precision, round(hit_rate, 6) AS recall,
       round(CASE WHEN precision + hit_rate > 0 THEN 2 * precision * hit_rate / (precision + hit_rate) END, 6) AS f1 FROM r)"""


def _verify_sql(params: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""t(direct, candidate) AS (VALUES {params}),
h AS (SELECT p.*, t.*, direct IS NOT NULL AND similarity >= direct AS at_once,
             NOT (direct IS NOT NULL AND similarity >= direct) AND similarity >= candidate AS asked FROM pairs p, t),
c AS (SELECT {k}direct, candidate,
        count(*) FILTER (kind = 'same_intent') AS same_total, count(*) FILTER (kind = 'different_intent') AS diff_total,
        count(*) FILTER (kind = 'same_intent' AND (at_once OR (asked AND coalesce(verify_same, false)))) AS same_hits,
        count(*) FILTER (kind = 'different_intent' AND (at_once OR (asked AND coalesce(verify_same, false)))) AS diff_hits,
        count(*) FILTER (kind = 'same_intent' AND asked) AS verify_calls_same,
        count(*) FILTER (kind = 'different_intent' AND asked) AS verify_calls_diff,
        count(*) FILTER (kind = 'different_intent' AND at_once) AS direct_hits_diff
      FROM h GROUP BY ALL),
r AS (SELECT *, same_hits / nullif(same_total, 0) AS hr, diff_hits / nullif(diff_total, 0) AS fr FROM c),
vs AS (SELECT {k}CASE WHEN direct IS NULL THEN 'always_verify' ELSE 'direct' END AS mode, direct::DOUBLE AS direct_threshold,
         candidate::DOUBLE AS candidate_threshold, same_total, diff_total, same_hits, diff_hits, verify_calls_same,
         verify_calls_diff, direct_hits_diff, round(hr, 6) AS hit_rate, round(fr, 6) AS false_hit_rate,
         verify_calls_same + verify_calls_diff AS verify_calls,
         coalesce(fr <= 0.02 AND hr >= 0.5, false) AS adopt, coalesce(fr <= 0.02 AND hr >= 0.4, false) AS meets_l2 FROM r)"""


VERIFY_PARAMS = ", ".join(f"(0.95, {c})" for c in cache_eval.CANDIDATES)
DIRECT_PARAMS = ", ".join(
    f"({'NULL' if d is None else d}, {c})" for d in (*cache_eval.DIRECTS, None) for c in cache_eval.DIRECT_CANDIDATES
)
STATS = """count(*) AS total, count(*) FILTER (kind = 'different_intent' AND verify_same) AS false_yes,
  count(*) FILTER (kind = 'same_intent' AND NOT verify_same) AS false_no"""


# ---------------------------------------------------------------- grounding records
def grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as judged questions, for two variants with three repeats each."""
    i = F.col("doc_id")
    base = b.table(spark, sf, "labels").join(b.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    runs = F.explode(
        F.array(
            *(
                F.struct(F.lit(v).alias("variant"), F.lit(r).alias("repeat"), F.lit(s).alias("shift"))
                for v, s in (("base", 0), ("strict", 1))
                for r in range(3)
            )
        )
    )
    flip = (i + F.col("run.repeat") * (F.col("run.shift") + 2)) % 17 == 0
    toxic_free = F.col("toxic") == 0
    return base.withColumn("run", runs).select(
        "run.variant",
        "run.repeat",
        i.alias("id"),
        F.col("lang").alias("category"),
        (F.col("quality") == 1).alias("expected_groundable"),
        (((i * 37) % 100) / 100).alias("top_similarity"),
        F.when(i % 19 != 0, F.when(flip, ~toxic_free).otherwise(toxic_free)).alias("llm_is_groundable"),
        F.when(i % 19 != 0, ((i * 53) % 101) / 100).alias("llm_confidence"),
        (i % 19 != 0).alias("parse_ok"),
        F.when(i % 19 == 0, "parse_error").alias("fallback_reason"),
        ((i * 31 + F.col("run.repeat") * 7) % 1500).cast("double").alias("latency_ms"),
        F.when(i % 5 != 0, i % 2000).alias("prompt_tokens"),
        (i % 40).alias("completion_tokens"),
    )


GROUNDING = """runs(variant, shift, rep) AS (VALUES ('base', 0, 0), ('base', 0, 1), ('base', 0, 2),
                                                   ('strict', 1, 0), ('strict', 1, 1), ('strict', 1, 2)),
g AS (
  SELECT variant, rep AS "repeat", l.doc_id AS id, d.lang AS category, l.quality = 1 AS expected,
         ((l.doc_id * 37) % 100) / 100 AS sim,
         l.doc_id % 19 = 0 OR CASE WHEN (l.doc_id + rep * (shift + 2)) % 17 = 0 THEN l.toxic <> 0 ELSE l.toxic = 0 END AS eff,
         CASE WHEN l.doc_id % 19 <> 0 THEN ((l.doc_id * 53) % 101) / 100 END AS conf,
         l.doc_id % 19 <> 0 AS parse_ok,
         ((l.doc_id * 31 + rep * 7) % 1500)::DOUBLE AS latency_ms,
         CASE WHEN l.doc_id % 5 <> 0 THEN l.doc_id % 2000 END AS prompt_tokens, l.doc_id % 40 AS completion_tokens
  FROM labels l JOIN documents d USING (doc_id), runs)"""


def _grounding_sql(thresholds, keys: str = "", where: str = "true") -> str:
    k = f"{keys}, " if keys else ""
    return f"""WITH {GROUNDING},
t AS (SELECT unnest([{', '.join(map(str, thresholds))}])::DOUBLE AS threshold),
f AS (SELECT g.*, threshold, sim >= threshold AND eff AS final FROM g, t WHERE {where}),
c AS (SELECT {k}threshold, count(*) AS total, count(*) FILTER (expected) AS groundable_total,
        avg((eff = expected)::INT) AS llm_only_agreement, avg((NOT parse_ok)::INT) AS parse_failure_rate,
        avg((eff = expected)::INT) FILTER (parse_ok AND conf >= 0 AND conf < 0.5) AS bucket_00_05,
        avg((eff = expected)::INT) FILTER (parse_ok AND conf >= 0.5 AND conf < 0.8) AS bucket_05_08,
        avg((eff = expected)::INT) FILTER (parse_ok AND conf >= 0.8 AND conf <= 1) AS bucket_08_10,
        avg(prompt_tokens) AS mean_prompt_tokens, avg(completion_tokens) AS mean_completion_tokens,
        avg(latency_ms) AS mean_latency_ms, avg((final = expected)::INT) AS accuracy,
        count(*) FILTER (NOT final AND NOT expected) AS tp, count(*) FILTER (NOT final AND expected) AS fp,
        count(*) FILTER (final AND NOT expected) AS fn, count(*) FILTER (expected AND sim < threshold) AS blocked,
        avg((sim < threshold)::INT) AS llm_call_saving_rate
      FROM f GROUP BY ALL),
r AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS rc FROM c),
m AS (SELECT {k}threshold, total, groundable_total, round(llm_only_agreement, 6) AS llm_only_agreement,
        round(parse_failure_rate, 6) AS parse_failure_rate, round(bucket_00_05, 6) AS bucket_00_05,
        round(bucket_05_08, 6) AS bucket_05_08, round(bucket_08_10, 6) AS bucket_08_10,
        round(mean_prompt_tokens, 6) AS mean_prompt_tokens, round(mean_completion_tokens, 6) AS mean_completion_tokens,
        round(mean_latency_ms, 6) AS mean_latency_ms, round(accuracy, 6) AS accuracy, round(p, 6) AS precision,
        round(rc, 6) AS recall, round(blocked / nullif(groundable_total, 0), 6) AS filter_false_block_rate,
        round(llm_call_saving_rate, 6) AS llm_call_saving_rate, fp AS groundable_false_block_count,
        round(fp / nullif(groundable_total, 0), 6) AS groundable_false_block_rate,
        round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) END, 6) AS f1 FROM r)"""


# ---------------------------------------------------------------- retrieval cases
def _cases(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    names = F.array(*map(F.lit, ("single_doc", "distractor", "acl_task", "acl_restricted", "out_of_corpus", "cross_doc")))
    return b.table(spark, sf, "benchmark").select(
        i.alias("query_id"), F.get(names, (i % 6).cast("int")).alias("category"), (i % 4 != 0).alias("has_substrings")
    )


def _truth(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Relevant: documents of the workspace that hold the item's text and may be seen, none out of
    corpus. Forbidden: those that hold it and may not be seen."""
    requests = b.requests(spark, sf)
    held = retrieval_eval.containing(b.chunks(spark, sf), requests.select("query_id", F.col("query").alias("passage")))
    marks = b.chunks(spark, sf).select("chunk_id", "workspace_id", "task_id", "sensitivity_level")
    rule = allowed(F.col("accessible_task_ids"), F.col("can_view_restricted"), F.col("task_id"), F.col("sensitivity_level"))
    judged = materialize(
        held.join(marks, "chunk_id")
        .join(requests.drop("query", "vector"), ["query_id", "workspace_id"])
        .select("query_id", F.concat(F.lit("doc-"), F.col("chunk_id")).alias("doc_key"), F.coalesce(rule, F.lit(False)).alias("visible"))
    )
    expected = judged.where("visible AND query_id % 6 <> 4").drop("visible")
    return expected, judged.where("NOT visible").drop("visible")


def _items(spark: SparkSession, sf: str, hits: DataFrame) -> DataFrame:
    docs = b.table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.when(F.col("doc_id") % 50 != 7, F.concat(F.lit("doc-"), F.col("doc_id"))).alias("doc_key"),
    )
    # The first words of the passage, as a person would quote it.
    phrases = b.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.array(F.substring_index("text", " ", 3)).alias("phrases")
    )
    items = retrieval_eval.mark_substrings(retrieval_eval.to_items(hits, docs), b.chunks(spark, sf), phrases)
    return items.select("query_id", "rank", "doc_key", F.round("vector_score", 9).alias("similarity"), "substring_hit")


def _measured(spark: SparkSession, sf: str, hits: DataFrame, truth: tuple[DataFrame, DataFrame]) -> DataFrame:
    expected, forbidden = truth
    return retrieval_eval.roll_up(
        retrieval_eval.per_request(_cases(spark, sf), expected, forbidden, _items(spark, sf, hits))
    )


def retrieval_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_measured(spark, sf, materialize(hybrid_hits(spark, sf)), _truth(spark, sf)))


def retrieval_eval_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Reversed result lists stand in for reranked ones; every third request has none."""
    hits = materialize(hybrid_hits(spark, sf))
    sizes = hits.groupBy("query_id").agg(F.max("rank").alias("n"))
    turned = (
        hits.where(F.col("query_id") % 3 != 0)
        .join(sizes, "query_id")
        .withColumn("rank", F.col("n") + 1 - F.col("rank"))
        .drop("n")
    )
    other, truth = retrieval_eval.with_source(hits, turned), _truth(spark, sf)
    return rounded(retrieval_eval.difference(_measured(spark, sf, hits, truth), _measured(spark, sf, other, truth)))


CASES = f"""
cases AS (SELECT item_id AS query_id, ['single_doc', 'distractor', 'acl_task', 'acl_restricted', 'out_of_corpus', 'cross_doc'][item_id % 6 + 1] AS category,
                 item_id % 4 <> 0 AS has_substrings FROM benchmark),
held AS (SELECT r.query_id, c.chunk_id AS doc, coalesce((accessible_task_ids IS NULL OR c.task_id IS NULL OR list_contains(accessible_task_ids, c.task_id))
    AND (can_view_restricted OR c.sensitivity_level <> 'restricted'), false) AS visible
  FROM requests r JOIN chunks c ON c.workspace_id = r.workspace_id AND contains(c.content, r.query)),
expected AS (SELECT query_id, 'doc-' || doc AS doc_key FROM held WHERE query_id % 6 <> 4 AND visible),
forbidden AS (SELECT query_id, 'doc-' || doc AS doc_key FROM held WHERE NOT visible)"""


def _report_sql(src: str, name: str) -> str:
    """Measures and roll-up over a table of hits; CTE names end in `name`."""
    return f"""
items{name} AS (SELECT query_id, rank, CASE WHEN chunk_id % 50 <> 7 THEN 'doc-' || chunk_id ELSE 'unknown:' || chunk_id END AS doc_key,
                 round(vector_score, 9) AS similarity, contains(content, array_to_string(string_split(query, ' ')[1:3], ' ')) AS substring_hit
           FROM {src} JOIN (SELECT chunk_id, content FROM chunks) USING (chunk_id) JOIN (SELECT query_id, query FROM requests) USING (query_id)),
docs{name} AS (SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS doc_rank FROM items{name} GROUP BY 1, 2),
found{name} AS (SELECT d.query_id, count(*) FILTER (doc_rank <= 5) AS n_found, min(doc_rank) AS best
           FROM docs{name} d JOIN expected e ON d.query_id = e.query_id AND d.doc_key = e.doc_key GROUP BY 1),
want{name} AS (SELECT query_id, count(*) AS n_expected FROM expected GROUP BY 1),
lists{name} AS (SELECT i.query_id, max(similarity) FILTER (rank = 1) - max(similarity) FILTER (rank = 2) AS margin, max(similarity) AS top_similarity,
             bool_or(substring_hit AND rank <= 5) AS chunk_found,
             bool_or(f.doc_key IS NOT NULL) AS exposed,
             bool_or(rank = 1 AND e.doc_key IS NOT NULL) AND bool_or(rank = 2 AND f.doc_key IS NOT NULL) AS second_bad
           FROM items{name} i LEFT JOIN expected e ON e.query_id = i.query_id AND e.doc_key = i.doc_key
                LEFT JOIN forbidden f ON f.query_id = i.query_id AND f.doc_key = i.doc_key GROUP BY 1),
per{name} AS (SELECT c.query_id, category, coalesce(n_found, 0) / n_expected AS recall,
          CASE WHEN n_expected IS NOT NULL THEN coalesce(1.0::DOUBLE / best, 0) END AS mrr,
          CASE WHEN n_expected IS NOT NULL THEN (coalesce(best, 0) = 1)::INT END AS hit1,
          CASE WHEN has_substrings THEN coalesce(chunk_found, false)::INT END AS chunk_hit, margin,
          coalesce(top_similarity, 0) AS top_similarity, coalesce(exposed, false) AS exposed,
          coalesce(exposed, false) AND category IN ('acl_task', 'acl_restricted') AS leak, coalesce(second_bad, false) AS second_bad
        FROM cases c LEFT JOIN want{name} USING (query_id) LEFT JOIN found{name} USING (query_id) LEFT JOIN lists{name} USING (query_id)),
rolled{name} AS (SELECT CASE WHEN grouping(category) = 1 THEN 'overall' ELSE category END AS category, count(*) AS n, count(recall) AS n_scored,
   avg(recall) AS recall_at_k, avg(mrr) AS mrr, avg(hit1) AS hit_at_1,
   count(chunk_hit) AS n_chunk_scored, avg(chunk_hit) AS chunk_hit_at_k, avg(margin) AS margin_mean,
   min(margin) AS margin_min, count(*) FILTER (leak) AS leak_count, count(*) FILTER (exposed) AS forbidden_exposed_count,
   CASE WHEN grouping(category) = 0 AND category = 'out_of_corpus' THEN avg(top_similarity) END AS top_similarity_mean,
   CASE WHEN grouping(category) = 0 AND category = 'out_of_corpus' THEN max(top_similarity) END AS top_similarity_max,
   CASE WHEN grouping(category) = 0 AND category = 'distractor' THEN avg(margin) FILTER (hit1 = 1) END AS distractor_margin_mean,
   CASE WHEN grouping(category) = 0 AND category = 'distractor' THEN min(margin) FILTER (hit1 = 1) END AS distractor_margin_min,
   CASE WHEN grouping(category) = 0 AND category = 'distractor' THEN count(margin) FILTER (second_bad) END AS forbidden_second_count,
   CASE WHEN grouping(category) = 0 AND category = 'distractor' THEN avg(margin) FILTER (second_bad) END AS forbidden_second_margin_mean
  FROM per{name} GROUP BY ROLLUP (category))"""


ROUNDED_REPORT = """SELECT category, n, n_scored, round(recall_at_k, 6) AS recall_at_k, round(mrr, 6) AS mrr, round(hit_at_1, 6) AS hit_at_1,
  n_chunk_scored, round(chunk_hit_at_k, 6) AS chunk_hit_at_k, round(margin_mean, 6) AS margin_mean, round(margin_min, 6) AS margin_min,
  leak_count, forbidden_exposed_count, round(top_similarity_mean, 6) AS top_similarity_mean, round(top_similarity_max, 6) AS top_similarity_max,
  round(distractor_margin_mean, 6) AS distractor_margin_mean, round(distractor_margin_min, 6) AS distractor_margin_min,
  forbidden_second_count, round(forbidden_second_margin_mean, 6) AS forbidden_second_margin_mean FROM rolled1"""


# ---------------------------------------------------------------- rewrites
def _rewrites(spark: SparkSession, sf: str) -> DataFrame:
    """Messages as questions; the same text, changed or marked, stands in for the rewrite."""
    text, i = F.col("text"), F.col("conv_id") * 100 + F.col("turn")
    rewritten = (
        F.when(i % 7 == 0, None)
        .when(i % 5 == 0, F.concat(F.lit(" "), text, F.lit(" ")))
        .when(i % 5 == 1, F.concat(F.lit('"'), text, F.lit('"')))
        .when(i % 5 == 2, F.concat(F.lit("출력: "), text))
        .when(i % 5 == 3, F.concat(text, F.lit(" 합니다.")))
        .otherwise(F.replace(text, F.lit("e"), F.lit("a")))
    )
    return b.table(spark, sf, "conversations").select(
        i.alias("id"),
        F.concat(F.lit("m"), i % 3).alias("model"),
        text.alias("question"),
        rewritten.alias("rewritten"),
        F.when(i % 11 == 0, "timeout").alias("error"),
        F.when(i % 4 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.left(text, F.lit(4)), F.lit("the"), F.lit("ZZZ")))
        .alias("expected_keywords"),
        (i % 5 == 0).alias("expect_passthrough"),
        F.when(i % 2 == 0, F.concat(F.lit("doc-"), i)).alias("expected_doc"),
        F.when(i % 6 != 0, i % 4 == 0).alias("doc_hit"),
        F.when(i % 9 != 0, (i * 13) % 3001).cast("double").alias("latency_ms"),
        F.when(i % 8 != 0, i % 500).alias("prompt_tokens"),
        (i % 60).alias("completion_tokens"),
    )


def rewrite_guard(spark: SparkSession, sf: str) -> DataFrame:
    r = _rewrites(spark, sf)
    return r.select(
        "id",
        F.coalesce(replies.answer_like(F.col("question"), F.col("rewritten")), F.lit(False)).alias("answer_like"),
        replies.accepted_rewrite(F.col("question"), F.col("rewritten")).alias("query"),
        F.round(replies.keyword_hit_rate(F.col("rewritten"), F.col("expected_keywords")), 6).alias("keyword_hit_rate"),
        replies.passthrough(F.col("question"), F.col("rewritten")).alias("passthrough"),
    )


STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
# The guard sees the reply as it came in evaluations, and trimmed on the way to retrieval.
ANSWER_LIKE = """coalesce(t <> '' AND t <> q AND (length(t) > greatest(length(question) * 4, 40) OR length(t) > 80
    OR contains({0}, chr(10)) OR regexp_matches(t, '니다\\.?$')
    OR (contains('"\'\'“”‘’「」', t[1]) AND contains('"\'\'“”‘’「」', t[-1])) OR regexp_matches(t, '^(출력|재작성):')), false)"""
REWRITES = f"""
r0 AS (SELECT conv_id * 100 + turn AS id, text AS question FROM conversations),
rw AS (SELECT id, 'm' || (id % 3) AS model, question,
  CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN ' ' || question || ' ' WHEN id % 5 = 1 THEN '"' || question || '"'
       WHEN id % 5 = 2 THEN '출력: ' || question WHEN id % 5 = 3 THEN question || ' 합니다.'
       ELSE replace(question, 'e', 'a') END AS rewritten,
  CASE WHEN id % 11 = 0 THEN 'timeout' END AS error,
  CASE WHEN id % 4 = 0 THEN []::VARCHAR[] ELSE [question[:4], 'the', 'ZZZ'] END AS kw,
  id % 5 = 0 AS expect_passthrough, CASE WHEN id % 2 = 0 THEN 'doc-' || id END AS expected_doc,
  CASE WHEN id % 6 <> 0 THEN id % 4 = 0 END AS doc_hit,
  CASE WHEN id % 9 <> 0 THEN ((id * 13) % 3001)::DOUBLE END AS latency_ms,
  CASE WHEN id % 8 <> 0 THEN id % 500 END AS prompt_tokens, id % 60 AS completion_tokens FROM r0),
rs AS (SELECT *, {STRIP.format('rewritten')} AS t, {STRIP.format('question')} AS q FROM rw),
judged AS (SELECT *, {ANSWER_LIKE.format('rewritten')} AS answer_like, {ANSWER_LIKE.format('t')} AS answer_like_t,
    CASE WHEN len(kw) = 0 THEN 1.0 ELSE len(list_filter(kw, lambda k: contains(lower(coalesce(rewritten, '')), lower(k)))) / len(kw) END AS khr,
    coalesce(t, '') = q AS pass FROM rs)"""

QUERIES = {
    "cache_sweep": lambda s, sf: rounded(cache_eval.sweep(pairs(s, sf))),
    "cache_recommend": lambda s, sf: rounded(cache_eval.recommend(cache_eval.sweep(pairs(s, sf)), 0.05)),
    "similarity_distribution": lambda s, sf: rounded(cache_eval.distribution(pairs(s, sf))),
    "cache_boundary_cases": lambda s, sf: rounded(
        cache_eval.boundary_cases(pairs(s, sf)).select("kind", "id", "similarity", "place")
    ),
    "verify_sweep": lambda s, sf: rounded(cache_eval.verify_sweep(pairs(s, sf))),
    "direct_sweep": lambda s, sf: rounded(cache_eval.direct_sweep(pairs(s, sf))),
    "verify_stats": lambda s, sf: rounded(cache_eval.verify_stats(pairs(s, sf))),
    "verify_misjudged": lambda s, sf: cache_eval.misjudged(pairs(s, sf)),
    "verify_outcomes": lambda s, sf: cache_eval.verify_outcomes(pairs(s, sf)),
    "verify_version_comparison": lambda s, sf: rounded(cache_eval.version_comparison(pairs(s, sf))),
    "grounding_metrics": lambda s, sf: rounded(grounding_eval.metrics(grounding(s, sf), (0.35,))),
    "grounding_sweep": lambda s, sf: rounded(grounding_eval.metrics(grounding(s, sf), grounding_eval.THRESHOLDS)),
    "grounding_false_blocks": lambda s, sf: rounded(grounding_eval.false_block_by_category(grounding(s, sf))),
    "grounding_variants": lambda s, sf: rounded(grounding_eval.variants(grounding(s, sf))),
    "grounding_disagreements": lambda s, sf: grounding_eval.disagreements(grounding(s, sf), ["base", "strict"]),
    "grounding_repeats": lambda s, sf: rounded(grounding_eval.repeat_stats(grounding(s, sf))),
    "grounding_flip_rate": lambda s, sf: rounded(grounding_eval.flip_rates(grounding(s, sf))),
    "grounding_unstable_cases": lambda s, sf: grounding_eval.unstable_cases(grounding(s, sf)),
    "retrieval_eval": retrieval_report,
    "retrieval_eval_diff": retrieval_eval_diff,
    "rewrite_guard": rewrite_guard,
    "rewrite_eval": lambda s, sf: rounded(rewrite_eval.model_metrics(_rewrites(s, sf))),
}

REPEATS = ", ".join(f"('{m}', {m}::DOUBLE)" for m in grounding_eval.REPEAT_METRICS)

ORACLE = {
    "cache_sweep": f"{SWEEP} SELECT * FROM swept",
    "cache_recommend": f"{SWEEP} SELECT * FROM swept WHERE false_hit_rate <= 0.05 AND hit_rate IS NOT NULL ORDER BY hit_rate DESC, threshold LIMIT 1",
    "similarity_distribution": f"""WITH {PAIRS} SELECT kind, round(min(similarity), 6) AS min, round(max(similarity), 6) AS max, round(avg(similarity), 6) AS mean,
      round(quantile_cont(similarity, 0.25), 6) AS p25, round(quantile_cont(similarity, 0.5), 6) AS median, round(quantile_cont(similarity, 0.75), 6) AS p75 FROM pairs GROUP BY 1""",
    "cache_boundary_cases": f"""WITH {PAIRS} SELECT kind, id, round(similarity, 6) AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY kind
      ORDER BY CASE WHEN kind = 'same_intent' THEN similarity ELSE -similarity END, id) AS place FROM pairs) WHERE place <= 5""",
    "verify_sweep": f"WITH {PAIRS}, {_verify_sql(VERIFY_PARAMS)} SELECT * FROM vs",
    "direct_sweep": f"WITH {PAIRS}, {_verify_sql(DIRECT_PARAMS)} SELECT * FROM vs",
    "verify_stats": f"""WITH {PAIRS} SELECT {STATS}, round(avg(verify_prompt_tokens), 6) AS avg_prompt_tokens, round(avg(verify_completion_tokens), 6) AS avg_completion_tokens,
      count(DISTINCT verify_model) AS models, count(DISTINCT verify_prompt_version) AS prompt_versions,
      round((total - false_yes - false_no) / total, 6) AS accuracy, round(quantile_cont(verify_latency_ms, 0.5), 6) AS latency_p50_ms,
      round(quantile_cont(verify_latency_ms, 0.95), 6) AS latency_p95_ms FROM pairs WHERE verify_same IS NOT NULL""",
    "verify_misjudged": f"""WITH {PAIRS} SELECT id, CASE WHEN kind = 'different_intent' THEN 'false_yes' ELSE 'false_no' END AS error FROM pairs
      WHERE (kind = 'different_intent' AND verify_same) OR (kind = 'same_intent' AND NOT verify_same)""",
    "verify_outcomes": f"WITH {PAIRS} SELECT coalesce(verify_outcome, '-') AS outcome, count(*) AS n FROM pairs WHERE verify_same IS NOT NULL GROUP BY 1",
    "verify_version_comparison": f"""WITH {PAIRS}, {_verify_sql('(0.95, 0.80), (0.95, 0.85)', 'verify_prompt_version')},
      st AS (SELECT verify_prompt_version, {STATS} FROM pairs WHERE verify_same IS NOT NULL GROUP BY 1)
      SELECT verify_prompt_version, any_value(total) AS total, any_value(round((total - false_yes - false_no) / total, 6)) AS accuracy, any_value(false_yes) AS false_yes,
        any_value(false_no) AS false_no, max(hit_rate) FILTER (candidate_threshold = 0.80) AS hit_rate_80, max(hit_rate) FILTER (candidate_threshold = 0.85) AS hit_rate_85,
        max(false_hit_rate) FILTER (candidate_threshold = 0.80) AS false_hit_rate FROM vs JOIN st USING (verify_prompt_version) GROUP BY 1""",
    "grounding_metrics": f"{_grounding_sql((0.35,))} SELECT * FROM m",
    "grounding_sweep": f"{_grounding_sql(grounding_eval.THRESHOLDS)} SELECT * FROM m",
    "grounding_false_blocks": f"{_grounding_sql(grounding_eval.THRESHOLDS, 'category', 'expected')} SELECT category, threshold, filter_false_block_rate AS rate FROM m",
    "grounding_variants": f"{_grounding_sql((0.35,), 'variant')} SELECT * FROM m",
    "grounding_disagreements": f"""WITH {GROUNDING}, d AS (SELECT id, category, expected, arg_max(sim >= 0.35 AND eff, "repeat") FILTER (variant = 'base') AS b,
      arg_max(sim >= 0.35 AND eff, "repeat") FILTER (variant = 'strict') AS s FROM g GROUP BY ALL)
      SELECT id, category, expected, b = expected AS base, s = expected AS strict FROM d WHERE b <> s""",
    "grounding_repeats": f"""{_grounding_sql((0.35,), 'variant, "repeat"').replace('round(', 'coalesce(').replace(', 6)', ', NULL)')}
      SELECT variant, metric, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stdev, round(min(v), 6) AS min, round(max(v), 6) AS max
      FROM (SELECT variant, u.metric, u.v FROM m, LATERAL (VALUES {REPEATS}) u(metric, v)) GROUP BY 1, 2""",
    "grounding_flip_rate": f"""WITH {GROUNDING}, d AS (SELECT variant, id, count(DISTINCT sim >= 0.35 AND eff) > 1 AS unstable FROM g GROUP BY 1, 2)
      SELECT variant, count(*) AS n, count(*) FILTER (unstable) AS unstable, round(avg(unstable::INT), 6) AS flip_rate FROM d GROUP BY 1""",
    "grounding_unstable_cases": f"WITH {GROUNDING} SELECT variant, id FROM g GROUP BY 1, 2 HAVING count(DISTINCT sim >= 0.35 AND eff) > 1",
    "retrieval_eval": f"{HITS},{CASES},{_report_sql('hits', '1')} {ROUNDED_REPORT}",
    "retrieval_eval_diff": f"""{HITS},{CASES},
      sizes AS (SELECT query_id, max(rank) AS n FROM hits GROUP BY 1),
      other AS (SELECT h.query_id, CASE WHEN h.query_id % 3 <> 0 THEN n + 1 - rank ELSE rank END AS rank, chunk_id, vector_score FROM hits h JOIN sizes USING (query_id)),
      {_report_sql('hits', '1')},{_report_sql('other', '2')}
      SELECT b.category, round(a.recall_at_k - b.recall_at_k, 6) AS recall_at_k_delta, round(a.mrr - b.mrr, 6) AS mrr_delta,
             round(a.hit_at_1 - b.hit_at_1, 6) AS hit_at_1_delta FROM rolled1 b JOIN rolled2 a USING (category)""",
    "rewrite_guard": f"""WITH {REWRITES} SELECT id, answer_like, CASE WHEN coalesce(t, '') = '' OR answer_like_t THEN question ELSE t END AS query,
      round(khr, 6) AS keyword_hit_rate, pass AS passthrough FROM judged""",
    "rewrite_eval": f"""WITH {REWRITES}, ok AS (SELECT *, error IS NULL AS ok, error IS NULL AND rewritten IS NOT NULL AS scored FROM judged)
      SELECT model, count(*) AS total_cases, count(*) FILTER (NOT ok) AS error_count, round(avg(answer_like::INT) FILTER (scored), 6) AS answer_like_rate,
        round(avg(khr) FILTER (scored), 6) AS keyword_hit_rate, round(avg(pass::INT) FILTER (scored AND expect_passthrough), 6) AS passthrough_accuracy,
        round(avg(doc_hit::INT) FILTER (scored AND expected_doc IS NOT NULL AND doc_hit IS NOT NULL), 6) AS doc_hit_rate,
        round(avg(prompt_tokens) FILTER (ok), 6) AS mean_prompt_tokens, round(avg(completion_tokens) FILTER (ok), 6) AS mean_completion_tokens,
        round(quantile_cont(latency_ms, 0.5) FILTER (ok), 6) AS latency_p50_ms, round(quantile_cont(latency_ms, 0.95) FILTER (ok), 6) AS latency_p95_ms
      FROM ok GROUP BY 1""",
}

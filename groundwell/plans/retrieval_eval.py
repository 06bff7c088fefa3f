"""Retrieval quality per request and rolled up per category. Relevant and forbidden
documents are rows, so their number per request has no bound."""

from __future__ import annotations

from itertools import batched

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from groundwell.session import fits_broadcast, materialize

# Categories with special treatment.
ANCHOR = 5  # words by which passages are looked up at most
FEW = 10_000  # anchors that are looked up while the text is read
TOGETHER = 200  # phrases without an inner word that one pass looks for
ACL_CATEGORIES, OUT_OF_CORPUS, DISTRACTOR = ("acl_task", "acl_restricted"), "out_of_corpus", "distractor"


def to_items(hits: DataFrame, chunk_docs: DataFrame) -> DataFrame:
    """Retrieved chunks with the key of their document; unknown ids are marked as such."""
    return hits.join(chunk_docs, "chunk_id", "left").withColumn(
        "doc_key", F.coalesce("doc_key", F.concat(F.lit("unknown:"), F.col("chunk_id").cast("string")))
    )


def mark_substrings(items: DataFrame, chunks: DataFrame, phrases: DataFrame) -> DataFrame:
    """Adds `substring_hit`: whether the chunk holds one of the request's phrases. Requests without
    phrases hit nothing. chunks: chunk_id, content; phrases: query_id, phrases (array)."""
    found = items.select("chunk_id").distinct()
    texts = chunks.select("chunk_id", "content").join(found, "chunk_id", "left_semi")
    hit = F.exists("phrases", lambda p: F.contains(F.col("content"), p))
    return (
        items.join(texts, "chunk_id", "left")
        .join(phrases.select("query_id", "phrases"), "query_id", "left")
        .withColumn("substring_hit", F.coalesce(hit, F.lit(False)))
        .drop("content", "phrases")
    )


def containing(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of the chunks that hold a passage as it is, of any length. chunks: chunk_id,
    content; passages: query_id, passage. An empty or null passage is found nowhere.

    The inner words of a passage, those between its first and its last space, stand in the chunk as
    they are. A passage is looked up by the hash of its first inner words, ANCHOR of them or as many
    as it has, and only candidates are compared. What has no inner word is looked for directly.
    """
    asked = passages.where("passage <> ''").select("query_id", "passage", F.split("passage", " ").alias("words"))
    inner = F.least(F.size("words") - 2, F.lit(ANCHOR))
    of = lambda start, n: F.xxhash64(F.lit(n), *(F.get("words", start + k) for k in range(n)))
    own = F.lit(None).cast("long")
    for n in range(1, ANCHOR + 1):
        own = F.when(inner == n, of(F.lit(1), n)).otherwise(own)
    anchors = asked.where(inner > 0).select("query_id", inner.alias("n"), own.alias("h"))
    lengths = sorted(r["n"] for r in anchors.select("n").distinct().collect())
    found = [_without_inner_words(chunks, asked.where(inner <= 0).select("query_id", "passage"))]
    if lengths:
        few = fits_broadcast(anchors, FEW)
        wanted = sorted({r["h"] for r in anchors.select("h").collect()}) if few else []
        # Words are a column of their own: inside the expression they would be split for every run.
        words = chunks.select("chunk_id", F.split("content", " ").alias("words"))
        runs = [_runs(of, n) for n in lengths]
        if few:
            runs = [F.filter(r, lambda h: h.isin(wanted)) for r in runs]
        seen = words.select("chunk_id", F.explode(F.array_distinct(F.concat(*runs))).alias("h"))
        pairs = materialize(seen.join(anchors.select("query_id", "h"), "h").select("query_id", "chunk_id").distinct(), "candidates")
        # As many as the chunks that hold an anchor: where they are few, the texts stay where they are.
        pairs = F.broadcast(pairs) if fits_broadcast(pairs) else pairs
        texts = pairs.join(chunks.select("chunk_id", "content"), "chunk_id").join(passages.select("query_id", "passage"), "query_id")
        found.append(texts.where(F.contains("content", F.col("passage"))).select("query_id", "chunk_id"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _runs(of, n: int) -> Column:
    """The hashes of all runs of `n` words."""
    some = lambda i: of(i, n)
    return F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(0), F.size("words") - n), some)).otherwise(F.array().cast("array<long>"))


def _without_inner_words(chunks: DataFrame, phrases: DataFrame) -> DataFrame:
    """Phrases of one or two words, some at a time: each pass keeps of every chunk the phrases it holds."""
    out = chunks.sparkSession.createDataFrame([], StructType([phrases.schema["query_id"], chunks.schema["chunk_id"]]))
    for some in batched((r["passage"] for r in phrases.select("passage").distinct().toLocalIterator()), TOGETHER):
        held = F.filter(F.array(*map(F.lit, some)), lambda p: F.contains(F.col("content"), p))
        holds = chunks.select("chunk_id", F.explode(held).alias("passage"))
        out = out.unionByName(holds.join(phrases, "passage").select("query_id", "chunk_id"))
    return out


def with_source(retrieved: DataFrame, other: DataFrame) -> DataFrame:
    """The other result list where a request has one, else the retrieved list."""
    have = other.select("query_id").distinct()
    return retrieved.join(have, "query_id", "left_anti").unionByName(other)


def ranked_documents(retrieved: DataFrame) -> DataFrame:
    """(query_id, doc_key, doc_rank): documents in the order of their first chunk."""
    first = retrieved.groupBy("query_id", "doc_key").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id").orderBy("rank")
    return first.select("query_id", "doc_key", F.row_number().over(w).alias("doc_rank"))


def per_request(cases: DataFrame, expected: DataFrame, forbidden: DataFrame, retrieved: DataFrame, k: int = 5) -> DataFrame:
    """Measures of each request; NULL where there is nothing to measure.

    cases: query_id, category, has_substrings; expected, forbidden: query_id, doc_key;
    retrieved: query_id, rank (1, 2, ...), doc_key, similarity, substring_hit.
    """
    want = expected.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"))
    found = (
        ranked_documents(retrieved)
        .join(expected, ["query_id", "doc_key"])
        .groupBy("query_id")
        .agg(F.count_if(F.col("doc_rank") <= k).alias("n_found"), F.min("doc_rank").alias("best"))
    )
    marked = (
        retrieved.join(expected.withColumn("good", F.lit(True)), ["query_id", "doc_key"], "left")
        .join(forbidden.withColumn("bad", F.lit(True)), ["query_id", "doc_key"], "left")
    )
    at = lambda r, c: F.max(F.when(F.col("rank") == r, c))
    lists = marked.groupBy("query_id").agg(
        at(1, F.col("similarity")).alias("sim1"),
        at(2, F.col("similarity")).alias("sim2"),
        F.max("similarity").alias("top_similarity"),
        F.coalesce(F.max(F.col("substring_hit") & (F.col("rank") <= k)), F.lit(False)).alias("chunk_found"),
        F.coalesce(F.max("bad"), F.lit(False)).alias("forbidden_exposed"),
        (at(1, F.col("good")) & at(2, F.col("bad"))).alias("second_bad"),
    )
    n = F.col("n_expected")
    scored = n.isNotNull()
    return (
        cases.join(want, "query_id", "left")
        .join(found, "query_id", "left")
        .join(lists, "query_id", "left")
        .select(
            "query_id",
            "category",
            (F.coalesce("n_found", F.lit(0)) / n).alias("recall_at_k"),
            F.when(scored, F.coalesce(1.0 / F.col("best"), F.lit(0.0))).alias("mrr"),
            F.when(scored, F.when(F.col("best") == 1, 1.0).otherwise(0.0)).alias("hit_at_1"),
            F.when(
                F.col("has_substrings"), F.when(F.coalesce("chunk_found", F.lit(False)), 1.0).otherwise(0.0)
            ).alias("chunk_hit_at_k"),
            (F.col("sim1") - F.col("sim2")).alias("margin"),
            F.coalesce("top_similarity", F.lit(0.0)).alias("top_similarity"),
            F.coalesce("forbidden_exposed", F.lit(False)).alias("forbidden_exposed"),
            (F.coalesce("forbidden_exposed", F.lit(False)) & F.col("category").isin(*ACL_CATEGORIES)).alias("acl_leak"),
            F.coalesce("second_bad", F.lit(False)).alias("forbidden_second"),
        )
    )


def roll_up(measures: DataFrame) -> DataFrame:
    """One row per category and one named `overall`."""
    only = lambda name, c: F.when(F.col("category") == name, c)
    top1 = F.when(F.col("hit_at_1") == 1.0, F.col("margin"))
    second = F.when(F.col("forbidden_second"), F.col("margin"))
    distractor: dict[str, Column] = {
        "distractor_margin_mean": F.avg(only(DISTRACTOR, top1)),
        "distractor_margin_min": F.min(only(DISTRACTOR, top1)),
        "forbidden_second_count": F.count(only(DISTRACTOR, second)),
        "forbidden_second_margin_mean": F.avg(only(DISTRACTOR, second)),
    }
    corpus = {
        "top_similarity_mean": F.avg(only(OUT_OF_CORPUS, F.col("top_similarity"))),
        "top_similarity_max": F.max(only(OUT_OF_CORPUS, F.col("top_similarity"))),
    }
    rolled = measures.rollup("category").agg(
        F.grouping("category").alias("all"),
        F.count(F.lit(1)).alias("n"),
        F.count("recall_at_k").alias("n_scored"),
        *(F.avg(c).alias(c) for c in ("recall_at_k", "mrr", "hit_at_1")),
        F.count("chunk_hit_at_k").alias("n_chunk_scored"),
        F.avg("chunk_hit_at_k").alias("chunk_hit_at_k"),
        F.avg("margin").alias("margin_mean"),
        F.min("margin").alias("margin_min"),
        F.count_if("acl_leak").alias("leak_count"),
        F.count_if("forbidden_exposed").alias("forbidden_exposed_count"),
        *(v.alias(k) for k, v in {**corpus, **distractor}.items()),
    )
    shown = {**dict.fromkeys(corpus, OUT_OF_CORPUS), **dict.fromkeys(distractor, DISTRACTOR)}
    return rolled.select(
        F.when(F.col("all") == 1, "overall").otherwise(F.col("category")).alias("category"),
        *(c for c in rolled.columns if c not in ("all", "category") and c not in shown),
        *(F.when((F.col("all") == 0) & (F.col("category") == cat), F.col(c)).alias(c) for c, cat in shown.items()),
    )


def difference(baseline: DataFrame, other: DataFrame) -> DataFrame:
    """Other minus baseline per category both have."""
    names = ("recall_at_k", "mrr", "hit_at_1")
    left = baseline.select("category", *(F.col(n).alias(f"b_{n}") for n in names))
    return other.join(left, "category").select("category", *((F.col(n) - F.col(f"b_{n}")).alias(f"{n}_delta") for n in names))

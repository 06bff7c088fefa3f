"""Hits to chunks with titles, citations and context blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.functions.text import cut
from groundwell.session import narrow


def parents(documents: DataFrame, commits: DataFrame, schemas: DataFrame) -> DataFrame:
    """One dimension (source_type, source_id, title, author_id) over the three parent tables."""
    no_author = F.lit(None).cast("string").alias("author_id")
    first_line = F.left(F.substring_index("commit_message", "\n", 1), F.lit(72))
    name = F.concat(
        F.coalesce("schema_name", F.lit("None")), F.lit("."), F.coalesce("table_name", F.lit("None"))
    )
    return (
        documents.select(F.lit("document").alias("source_type"), F.col("id").alias("source_id"), "title", no_author)
        .unionByName(
            commits.select(
                F.lit("git_commit").alias("source_type"), F.col("id").alias("source_id"),
                first_line.alias("title"), "author_id",
            )
        )
        .unionByName(
            schemas.select(
                F.lit("db_schema").alias("source_type"), F.col("id").alias("source_id"), name.alias("title"), no_author
            )
        )
    )


def hydrate(hits: DataFrame, chunks: DataFrame, dimension: DataFrame, bounded: bool = False) -> DataFrame:
    """Hits joined to their chunks and titles. Hits without a chunk are dropped, and the others
    are numbered anew; a chunk without a parent gets a name made of its type and source id.

    With `bounded`, a promise that the hits fit a broadcast, chunks and parents are only
    scanned.
    """
    kind, sid = F.col("source_type"), F.col("source_id")
    title = (
        F.when(kind == "owner_answer", F.concat(F.lit("담당자 답변: "), F.coalesce("owner_name", F.lit("담당자"))))
        .when(kind == "document", F.coalesce("title", F.concat(F.lit("Document #"), sid)))
        .when(kind == "git_commit", F.coalesce("title", F.concat(F.lit("Commit #"), sid)))
        .when(kind == "db_schema", F.coalesce("title", F.concat(F.lit("Schema #"), sid)))
        .otherwise(F.concat(F.lit("Chunk #"), sid))
    )
    body = chunks.select("chunk_id", "source_type", "source_id", "content", "owner_name")
    keys = ["source_type", "source_id"]
    # A chunk is read once however many requests it was found for.
    found = narrow(body, hits, ["chunk_id"], bounded)
    titled = found.join(narrow(dimension, found, keys, bounded), keys, "left").withColumn("title", title)
    left = hits.join(titled.drop("owner_name"), "chunk_id")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def rerank_prompts(requests: DataFrame, hits: DataFrame, max_chars: int = 600) -> DataFrame:
    """The numbered candidate list a ranking model is shown, one text per request."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "title", "content")))
    lines = F.transform(
        listed,
        lambda c, i: F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] ("), c["title"], F.lit(") "), F.left(c["content"], F.lit(max_chars))
        ),
    )
    blocks = hits.groupBy("query_id").agg(F.array_join(lines, "\n").alias("lines"))
    return requests.join(blocks, "query_id").select(
        "query_id", F.concat(F.lit("질문: "), F.col("query"), F.lit("\n\n후보:\n"), F.col("lines")).alias("prompt")
    )


def citations(hits: DataFrame) -> DataFrame:
    """One row per request with its citations in rank order; at most k per request."""
    item = F.struct("rank", "source_type", "source_id", "chunk_id", "title", "vector_score")
    cited = F.transform(
        F.array_sort(F.collect_list(item)),
        lambda c: F.struct(
            c["source_type"].alias("source_type"),
            c["source_id"].alias("source_id"),
            c["chunk_id"].alias("chunk_id"),
            c["title"].alias("title"),
            c["vector_score"].alias("similarity_score"),
        ),
    )
    return hits.groupBy("query_id").agg(cited.alias("citations"))


def context_block(rows: Column, max_chars: int = 0) -> Column:
    """Numbered context text from array<struct<rank, source_type, title, content>>."""
    ordered = F.array_sort(rows)
    return F.array_join(
        F.transform(
            ordered,
            lambda c, i: F.concat(
                F.lit("["), (i + 1).cast("string"), F.lit("] ("), c["source_type"], F.lit(") "),
                c["title"], F.lit("\n"), cut(c["content"], max_chars),
            ),
        ),
        "\n\n",
    )


def contexts(hits: DataFrame, top: int, max_chars: int = 0) -> DataFrame:
    """One context text per request over its first `top` hits."""
    item = F.struct("rank", "source_type", "title", "content")
    return hits.where(F.col("rank") <= top).groupBy("query_id").agg(
        context_block(F.collect_list(item), max_chars).alias("context")
    )

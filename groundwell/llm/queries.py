"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm.alignment import link_scores
from groundwell.llm.decontaminate import contaminated
from groundwell.llm.fill_in_middle import fill_in_middle, restored
from groundwell.llm.license_scan import license_scan
from groundwell.llm.line_dedup import drop_boilerplate
from groundwell.llm.main_text import extract
from groundwell.llm.mixing import mix_sources
from groundwell.llm.quality_rules import quality_rules
from groundwell.llm.simhash import near_duplicates
from groundwell.llm.substring_dedup import drop_repeats
from groundwell.llm.token_counts import section_tokens, with_fields
from groundwell.llm.token_store import token_digests
from groundwell.llm.url_filter import url_verdicts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drop_boilerplate(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drop_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_verdicts(pages, documents(spark, sf_dir)).select("page_id", "host", "path", "rule", "verdict")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the source, the language, the first line and the rest of every document."""
    first = F.substring_index("text", "\n", 1)
    rest = F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)")
    split = documents(spark, sf_dir).select("doc_id", "source", "lang", first.alias("title"), rest.alias("body"))
    return section_tokens(with_fields(split, ["source", "lang", "title", "body"]))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item it contains."""
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = near_duplicates(documents(spark, sf_dir))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.select("doc_id", digits.alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_scores(documents(spark, sf_dir)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(documents(spark, sf_dir))
    back = restored(made["output"], made["form"])
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_substring_dedup, op3_source_mixing, op4_url_filter, op5_token_counts,
        op6_license_scan, op7_token_store, op8_decontamination, op9_simhash, op10_quality_rules,
        op11_tokenizer_alignment, op12_main_text, op13_fill_in_middle,
    )
}

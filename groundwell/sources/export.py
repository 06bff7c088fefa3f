"""Scrubbed training records, one folder per workspace and dataset version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from groundwell.functions.replies import ROLES
from groundwell.functions.text import safe_name, scrub
from groundwell.sources.jsonl import strict

# Where a record may come from.
ORIGINS = ("chat", "owner_answer", "faq")
FIELDS = (
    "original_question", "target_role", "final_answer", "source", "prompt_version", "is_faq", "owner_verified",
)


def scrub_records(records: DataFrame) -> DataFrame:
    """Records with personal data replaced and the number of replacements in `hits`.
    Fails on names that are no safe path component, unknown roles and origins."""
    rules = {
        "unsafe workspace_id": safe_name(F.col("workspace_id")),
        "unsafe dataset_version": safe_name(F.col("dataset_version")),
        "unknown target_role": F.col("target_role").isin(*ROLES),
        "unknown source": F.col("source").isin(*ORIGINS),
    }
    return scrub(strict(records, rules), ["original_question", "final_answer"], "hits")


def export(records: DataFrame, path: str) -> dict[str, int]:
    """Write JSONL under workspace_id=/dataset_version=; a repeated run replaces only the
    versions it contains. Returns record_count and scrubbed_field_count."""
    seen = Observation("export")
    ready = scrub_records(records).observe(
        seen,
        F.count(F.lit(1)).alias("record_count"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("scrubbed_field_count"),
    )
    (
        ready.select(*FIELDS, "workspace_id", "dataset_version")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("ignoreNullFields", "false")
        .partitionBy("workspace_id", "dataset_version")
        .json(path)
    )
    return dict(seen.get)

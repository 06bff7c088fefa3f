"""JSONL sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Allowed sensitivity levels, case categories, pair kinds.
SENSITIVITY = ("normal", "restricted")
CASE_CATEGORIES = ("single_doc", "cross_doc", "distractor", "acl_task", "acl_restricted", "out_of_corpus")
PAIR_KINDS = ("same_intent", "different_intent")
# Characters of a broken line that an error shows.
ROW_SHOWN = 200


def scan_events(spark: SparkSession, path: str) -> DataFrame:
    """(event, record VARIANT) of every readable line under `path`.

    The event is the name of the file without `.jsonl`, or of the `event=` folder for
    files Spark wrote. Blank and broken lines are skipped: a writer may be at work.
    """
    where = F.col("_metadata.file_path")
    event = F.coalesce(
        F.nullif(F.regexp_extract(where, r"/event=([^/]+)/", 1), F.lit("")),
        F.regexp_extract(where, r"([^/]+)\.jsonl$", 1),
    )
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.select(event.alias("event"), F.try_parse_json("value").alias("record")).where(
        F.col("record").isNotNull()
    )


def scan_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Eval records with a given schema; broken lines are skipped, missing keys are NULL.

    Every field is read on its own, so a value of the wrong type loses that field only.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    record = F.try_parse_json("value")
    return (
        spark.read.text(path)
        .select(record.alias("r"))
        .where(F.col("r").isNotNull())
        .select(
            *(F.try_variant_get("r", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema.fields)
        )
    )


def _broken(rules: dict[str, Column]) -> Column:
    """The first rule that a row breaks."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()))


def strict(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Fails with the name of the rule and the row on the first row that breaks one."""
    problem = _broken(rules)
    row = F.to_json(F.struct("*"))
    checked = F.when(problem.isNotNull(), F.raise_error(F.concat(problem, F.lit(": "), row)))
    # The check rides on every row as a filter that passes.
    return df.where(checked.cast("string").isNull())


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, broken rows with the first broken rule as `problem`)."""
    marked = df.withColumn("problem", _broken(rules))
    return marked.where("problem IS NULL").drop("problem"), marked.where("problem IS NOT NULL")


def broken_lines(spark: SparkSession, path: str, schema: str, rules: dict[str, Column]) -> DataFrame:
    """(file, line, problem, row) of the first broken line of every split of the files under `path`.

    Lines count from 1 and through blank ones, which are never broken. A task knows the place of a line in
    its split only, so each split hands on how many lines it has, and a line's number is its place plus the
    lines of the file's earlier splits. One pass; what is shuffled is one row a split.
    """
    at = F.col("_metadata")
    lines = spark.read.text(path).select(
        F.col("value").alias("_row"), at["file_path"].alias("_file"), at["file_block_start"].alias("_split"),
        F.monotonically_increasing_id().alias("_pos"),
    )
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.withColumn("_r", F.from_json("_row", f"{schema}, _bad string", options)).select("_row", "_file", "_split", "_pos", "_r.*")
    problem = F.when(F.col("_row").rlike(r"^\s*$"), None).when(F.col("_bad").isNotNull(), "not a JSON record").otherwise(_broken(rules))
    where = F.when(F.col("_problem").isNotNull(), F.col("_pos"))
    splits = parsed.withColumn("_problem", problem).groupBy("_file", "_split").agg(
        F.count(F.lit(1)).alias("lines"), F.min("_pos").alias("first"), F.min(where).alias("at"),
        F.min_by(F.struct("_problem", "_row"), where).alias("found"),
    )
    earlier = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    numbered = splits.withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))
    return numbered.where("at IS NOT NULL").select(
        F.col("_file").alias("file"), (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"),
        F.col("found._problem").alias("problem"), F.col("found._row").alias("row"),
    )


def _checked(spark: SparkSession, path: str, schema: str, rules: dict[str, Column]) -> DataFrame:
    """The records under `path`, or a ValueError that names file, line and rule of the first broken line.

    The files are read once for the check, when this is called. The rules ride on the rows that are
    returned too, so a file that changes in between cannot bring broken rows.
    """
    first = broken_lines(spark, path, schema, rules).orderBy("file", "line").first()
    if first is not None:
        raise ValueError(f"{first['file']}:{first['line']}: {first['problem']}: {first['row'][:ROW_SHOWN]}")
    return strict(spark.read.schema(schema).option("mode", "FAILFAST").json(path), rules)


def _given(*names: str) -> dict[str, Column]:
    return {f"{n} is missing or empty": F.coalesce(F.col(n), F.lit("")) != "" for n in names}


PAIR_SCHEMA = "id string, kind string, q1 string, q2 string, note string"


def scan_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Question pairs; fails on a missing field, an unknown kind or a broken line, whose file and number the error names."""
    rules = {**_given("id", "kind", "q1", "q2"), "unknown kind": F.col("kind").isin(*PAIR_KINDS)}
    return _checked(spark, path, PAIR_SCHEMA, rules)


CASE_SCHEMA = (
    "id string, category string, question string, expected_doc_keys array<string>, forbidden_doc_keys array<string>, "
    "access struct<accessible_task_ids: array<string>, can_view_restricted: boolean>, note string, "
    "expected_substrings array<string>"
)


def scan_cases(spark: SparkSession, path: str) -> DataFrame:
    """Retrieval cases; fails on missing fields, an unknown category or an empty question, by file and line."""
    rules = {
        **_given("id", "question"),
        "unknown category": F.col("category").isin(*CASE_CATEGORIES),
        "expected_doc_keys is missing": F.col("expected_doc_keys").isNotNull(),
        "forbidden_doc_keys is missing": F.col("forbidden_doc_keys").isNotNull(),
        "access is missing": F.col("access").isNotNull(),
    }
    return _checked(spark, path, CASE_SCHEMA, rules).withColumns(
        {
            "expected_substrings": F.coalesce("expected_substrings", F.array().cast("array<string>")),
            "note": F.coalesce("note", F.lit("")),
        }
    )


MANIFEST_SCHEMA = (
    "doc_key string, file string, title string, document_type string, task_id string, sensitivity_level string, "
    "topic string, note string"
)


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Document manifest: one JSON array per file."""
    df = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    rules = {
        **_given("doc_key", "file", "title", "document_type", "topic"),
        "unknown sensitivity_level": F.col("sensitivity_level").isin(*SENSITIVITY),
    }
    return strict(df, rules).withColumn("note", F.coalesce("note", F.lit("")))


def append_events(df: DataFrame, path: str) -> None:
    """Append event rows as JSON lines, one folder per event."""
    df.write.mode("append").partitionBy("event").option("ignoreNullFields", "false").json(path)


def save_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)

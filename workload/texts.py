"""Text queries: chunking, context, personal data, rules, history, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.functions import commits, replies, rules, text as t
from groundwell.operators import analysis, chunking, history
from groundwell.operators.ingest import INGEST_STAGES, document_records, embed, embedding_usage, ingest_result, with_metadata
from groundwell.session import spread
from workload import bindings as b


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(b.table(spark, sf, "documents"), "doc_id")


def _digest(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(
        *keys, "chunk_index", "char_start", "char_end", F.md5("content").alias("content_md5")
    )


def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(chunking.chunk_rows(_docs(spark, sf), ["doc_id"], 1500, 200), "doc_id")


def answer_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Answers cut into 40-character pieces, as a cached answer is replayed."""
    rows = b.table(spark, sf, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", F.posexplode_outer(t.pieces(F.col("text"), 40)).alias("pos", "piece")).where(
        "piece IS NOT NULL"
    )


def chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).withColumn("doc_type", F.lit("text"))
    return _digest(chunking.chunk(docs, ["doc_id"]), "doc_id")


def chunk_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Every line that ends a sentence is followed by a header."""
    body = F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.replace("text", F.lit(".\n"), F.lit(".\n\n## ")))
    docs = _docs(spark, sf).select("doc_id", body.alias("text"), F.lit("md").alias("doc_type"))
    return _digest(chunking.chunk(docs, ["doc_id"]), "doc_id")


def chunk_code(spark: SparkSession, sf: str) -> DataFrame:
    """Documents laid out as functions, Python and brace style by turns."""
    python = F.col("doc_id") % 2 == 0
    head = F.when(python, ".\ndef part(x):\n    ").otherwise(".\n\npublic void part() {\n    ")
    docs = _docs(spark, sf).select(
        "doc_id",
        F.replace("text", F.lit(".\n"), head).alias("text"),
        F.when(python, "python").otherwise("java").alias("doc_type"),
    )
    return _digest(chunking.chunk(docs, ["doc_id"]), "doc_id")


def chunk_sql(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select(
        "doc_id", F.replace("text", F.lit(".\n"), F.lit(";\n")).alias("text"), F.lit("sql").alias("doc_type")
    )
    return _digest(chunking.chunk(docs, ["doc_id"]), "doc_id")


def chunk_diff(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select(
        "doc_id",
        F.concat(F.lit("diff --git a b\n"), F.replace("text", F.lit(".\n"), F.lit(".\ndiff --git a b\n"))).alias("text"),
        F.lit("git_diff").alias("doc_type"),
    )
    return _digest(chunking.chunk(docs, ["doc_id"]), "doc_id")


# The fold over segments runs for all documents in lockstep, one segment per step.
# All white space in the test texts is ASCII, so \s of both engines agrees.
FOLD = """
lens AS (SELECT doc_id, size, pos, seg, length(seg) AS n FROM segs),
fold(doc_id, size, pos, grp, width) AS (
  SELECT doc_id, size, 1, 1, n FROM lens WHERE pos = 1
  UNION ALL
  SELECT f.doc_id, f.size, l.pos,
         CASE WHEN least(l.n, f.width) < f.size * 0.2 AND f.width + l.n + 1 <= f.size THEN f.grp ELSE f.grp + 1 END,
         CASE WHEN least(l.n, f.width) < f.size * 0.2 AND f.width + l.n + 1 <= f.size THEN f.width + l.n + 1 ELSE l.n END
  FROM fold f JOIN lens l ON l.doc_id = f.doc_id AND l.pos = f.pos + 1),
pieces AS (SELECT f.doc_id, any_value(f.size) AS size, grp, string_agg(seg, chr(10) ORDER BY f.pos) AS body
           FROM fold f JOIN lens l ON l.doc_id = f.doc_id AND l.pos = f.pos GROUP BY f.doc_id, grp),
found(doc_id, grp, start, upto) AS (
  SELECT p.doc_id, 1, greatest(position(body IN doc) - 1, 0), greatest(position(body IN doc) - 1, 0) + length(body)
  FROM pieces p JOIN texts x USING (doc_id) WHERE grp = 1
  UNION ALL
  SELECT p.doc_id, p.grp,
         CASE WHEN position(p.body IN substring(doc, f.upto + 1)) > 0 THEN f.upto + position(p.body IN substring(doc, f.upto + 1)) - 1 ELSE f.upto END,
         CASE WHEN position(p.body IN substring(doc, f.upto + 1)) > 0 THEN f.upto + position(p.body IN substring(doc, f.upto + 1)) - 1 ELSE f.upto END + length(p.body)
  FROM found f JOIN pieces p ON p.doc_id = f.doc_id AND p.grp = f.grp + 1 JOIN texts x ON x.doc_id = f.doc_id),
cuts AS (SELECT doc_id, grp, start, body, size, CASE WHEN size = 800 THEN 700 ELSE 1300 END AS stride,
                unnest(range(0, CASE WHEN length(body) <= size THEN 1
                     ELSE 1 + ceil((length(body) - size) / (CASE WHEN size = 800 THEN 700 ELSE 1300 END))::BIGINT END)) AS w
         FROM pieces JOIN found USING (doc_id, grp)),
rows AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp, w) - 1 AS chunk_index, start + w * stride AS char_start,
                substring(body, w * stride + 1, size) AS content FROM cuts)
SELECT doc_id, chunk_index, char_start, char_start + length(content) AS char_end, md5(content) AS content_md5 FROM rows"""

TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
PARAS = r"list_filter(list_transform(regexp_split_to_array({0}, '\n\s*\n'), lambda p: " + TRIM.format("p") + "), lambda p: p <> '')"


def _chunk_sql(source: str, size: int, segments: str) -> str:
    return f"""WITH RECURSIVE
texts AS (SELECT doc_id, {TRIM.format(source)} AS doc FROM documents),
arrays AS (SELECT doc_id, {segments} AS parts FROM texts WHERE doc <> ''),
segs AS (SELECT doc_id, {size} AS size, unnest(parts) AS seg, generate_subscripts(parts, 1) AS pos FROM arrays),{FOLD}"""


SENTENCES = (
    r"list_filter(string_split(regexp_replace({0}, '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '\S'))"
)
TEXT_SEGMENTS = f"flatten(list_transform({PARAS.format('doc')}, lambda p: CASE WHEN length(p) <= 1500 THEN [p] ELSE {SENTENCES.format('p')} END))"
MD_SEGMENTS = (
    r"flatten(list_transform(list_filter(list_transform(string_split(regexp_replace(doc, '(?m)^(#{1,4})\s+', chr(1) || '\1' || chr(1), 'g'), chr(1)), "
    "lambda s: " + TRIM.format("s") + "), lambda s: s <> ''), "
    f"lambda s: CASE WHEN length(s) <= 1500 THEN [s] ELSE {PARAS.format('s')} END))"
)


def _several(parts: str, other: str) -> str:
    return f"CASE WHEN len({parts}) > 1 THEN {parts} ELSE {other} END"


FULL = r"list_filter({0}, lambda s: regexp_matches(s, '\S'))"
SQL_PARTS = (
    r"list_transform(list_filter(list_transform(regexp_split_to_array(doc, ';\s*\n'), lambda s: "
    + TRIM.format("s")
    + "), lambda s: s <> ''), lambda s: CASE WHEN s[-1] = ';' THEN s ELSE s || ';' END)"
)
DIFF_PARTS = FULL.format("string_split(regexp_replace(doc, '(?m)^diff --git ', chr(1) || 'diff --git ', 'g'), chr(1))")
BLANK = FULL.format(r"regexp_split_to_array(doc, '\n{2,}')")
PY_PARTS = FULL.format("string_split(regexp_replace(doc, '(?m)^(def |class |async def )', chr(1) || '\\1', 'g'), chr(1))")
# RE2 has no look-ahead: the definition is matched and put back. Split points in the blank
# lines before it only cut off blank pieces, so those lines go.
_W = r"[\p{L}\p{N}_]"
_START = (
    r"(?m)^(\s*(?:(?:public|private|protected|static|async|export|function|const|let|var)\s+)*"
    rf"(?:(?:fun|func|fn|def|class|interface|enum|struct|impl)\s|{_W}+\s+{_W}+\s*\())"
)
C_PARTS = (
    "list_transform("
    + FULL.format(f"string_split(regexp_replace(doc, '{_START}', chr(1) || '\\1', 'g'), chr(1))")
    + r", lambda s: regexp_replace(s, '^\s*\n', ''))"
)


# ---------------------------------------------------------------- ingest texts
def embedding_input_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of all documents with a context on every other one; every seventh document
    has a call without a reported count."""
    rows = chunking.chunk_rows(_docs(spark, sf), ["doc_id"], 1500, 200)
    context = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("ctx "), F.col("doc_id")))
    texts = rows.withColumn("input", t.embedding_input(context, F.col("content")))
    reported = F.when(F.max(F.col("doc_id")) % 7 != 0, F.sum(F.ceil(F.length("input") / 4.0)).cast("long"))
    usage = embedding_usage(texts, reported)
    ratio = t.replacement_ratio(F.col("text"))
    return (
        _docs(spark, sf)
        .select("doc_id", F.length("text").alias("char_count"), ratio.alias("replacement_ratio"))
        .join(usage, "doc_id", "left")
        .withColumn(
            "result",
            ingest_result(
                F.col("chunk_count"), F.col("replacement_ratio"), F.when(F.col("doc_id") % 97 == 5, F.lit("embed"))
            ),
        )
    )


def document_ingest_records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as ingest runs that fail at any stage, with contexts made for even ones; the record
    of each run."""
    i = F.col("doc_id")
    stage = F.get(F.array(*map(F.lit, INGEST_STAGES)), (i % 29).cast("int"))
    runs = b.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("ws"), i % 4).alias("workspace_id"), F.col("lang").alias("doc_type"), F.octet_length("text").cast("long").alias("file_bytes"),
        "text", stage.alias("failure_stage"), F.when(stage.isNotNull(), F.concat(F.lit("E"), i % 3)).alias("error_type"),
    )
    k = i + F.col("chunk_index")
    rows = chunking.chunk_rows(_docs(spark, sf), ["doc_id"], 1500, 200).withColumns({
        "context": F.when((i % 2 == 0) & (k % 3 != 0), F.concat(F.lit("ctx "), i)),
        "context_calls": F.when((i % 2 == 0) & (k % 5 != 0), k % 4 + 1).otherwise(0), "context_reused": (i % 2 == 0) & (k % 5 == 0),
    })
    texts = rows.withColumn("input", t.embedding_input(F.col("context"), F.col("content")))
    entered = F.transform(
        F.array(*map(F.lit, INGEST_STAGES)),
        lambda s, n: F.when((n <= F.coalesce(F.array_position(F.array(*map(F.lit, INGEST_STAGES)), stage), F.lit(9)) - 1) & ((s != "context") | (i % 2 == 0)),
                            F.struct(s.alias("stage"), ((i + 1) * (n + 1) % 50).cast("double").alias("ms"))),
    )
    timings = runs.select("doc_id", F.inline(F.array_compact(entered)))
    reported = F.when(F.max(i) % 7 != 0, F.sum(F.ceil(F.length("input") / 4.0)).cast("long"))
    return document_records(runs, texts, timings, reported)


def chunk_metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.chunk_rows(_docs(spark, sf), ["doc_id", "source", "lang"], 1500, 200)
    extra = {"commit_hash": F.col("source"), "branch_name": F.when(F.col("doc_id") % 2 == 0, F.col("lang")), "char_end": F.lit(-1)}
    made = with_metadata(rows, extra)
    return made.select(
        "doc_id", "chunk_index", *(F.col("metadata")[k].alias(f"m_{k}") for k in ("char_start", "char_end", "content_sha1", "commit_hash", "branch_name"))
    )


def embed_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A user function in place of a model: length and first character of each text."""
    rows = b.table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("input"))
    made = embed(rows, lambda texts: [[float(len(s)), float(ord(s[0])) if s else 0.0] for s in texts])
    return made.select("conv_id", "turn", F.get("vector", F.lit(0)).alias("x0"), F.get("vector", F.lit(1)).alias("x1"))


def risk_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Free risk labels of models, with the rules for documents and for commits."""
    i = F.col("conv_id") * 100 + F.col("turn")
    words = ("high", " HIGH risk", "매우 높음", "low", "낮음", "보통", "중간", "medium-low", "?", None)
    label = F.get(F.array(*map(F.lit, words)), (i % len(words)).cast("int"))
    rows = b.table(spark, sf, "conversations").select(i.alias("id"), label.alias("label"))
    return rows.select(
        "id", rules.normal_risk(F.col("label"), True).alias("document_risk"), rules.normal_risk(F.col("label"), False).alias("commit_risk")
    )


def pii_scrub(spark: SparkSession, sf: str) -> DataFrame:
    texts = _docs(spark, sf).select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text").unionAll(
        b.table(spark, sf, "conversations").select(
            F.lit("conv"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text"
        )
    )
    return t.scrub(texts, ["text"], "hits").select("kind", "id", F.md5("text").alias("text_md5"), "hits")


_PHONE = r"(\+82[-.\s]?(0?1[016789]|0?2|0?[3-6]\d|0?70)[-.\s]?\d{3,4}[-.\s]?\d{4}|01[016789][-.\s]?\d{3,4}[-.\s]?\d{4}|0(2|[3-6]\d|70)[-.\s]?\d{3,4}[-.\s]?\d{4})"
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# RE2 has no look-around: the neighbours are matched and put back, twice, as two matches
# may share one. A dot after an address counts only if a digit follows.
SCRUB_STEPS = [
    (r"(?i)https?://[^\s<>\"''\)\]]+", "[URL]", 1),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", 1),
    (r"(^|\D)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])-?[1-4]\d{6}($|\D)", r"\1[RRN]\4", 2),
    (rf"(^|[^\d-]){_PHONE}($|[^\d-])", r"\1[PHONE]\5", 2),
    (rf"(^|[^\d.])({_OCTET}\.){{3}}{_OCTET}($|[^\d.]|\.$|\.\D)", r"\1[IP]\5", 2),
]


def _scrub_sql(col: str) -> str:
    for pattern, repl, times in SCRUB_STEPS:
        for _ in range(times):
            col = f"regexp_replace({col}, '{pattern}', '{repl}', 'g')"
    return col


TOKEN_COUNT = r"len(regexp_extract_all({0}, '\[(URL|EMAIL|RRN|PHONE|IP)\]'))"


# ---------------------------------------------------------------- rules
def commit_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as commits: the first line is the message, the text the patch."""
    i = F.col("doc_id")
    files = F.when(
        i % 3 != 0,
        F.array(
            F.struct(
                F.concat(F.lit("src/"), F.col("source"), F.lit(".txt")).alias("file_path"),
                F.when(i % 2 == 0, "MODIFIED").alias("change_type"),
                F.when(i % 5 != 0, (i % 90).cast("int")).alias("additions"),
                F.lit(None).cast("int").alias("deletions"),
                F.col("text").alias("patch"),
                F.when(i % 4 == 0, F.lit("summary")).alias("diff_summary"),
            )
        ),
    )
    rows = _docs(spark, sf).select(
        i.alias("id"),
        F.sha1(i.cast("string")).alias("commit_hash"),
        F.when(i % 2 == 0, F.left(F.sha1(i.cast("string")), F.lit(7))).alias("short_hash"),
        F.substring_index("text", "\n", 1).alias("message"),
        commits.diff_text(files, F.when(i % 6 == 0, F.col("text"))).alias("diff"),
        F.when(i % 2 == 0, F.lit("a@b.c")).alias("email"),
    )
    body = commits.commit_text(
        {
            "commit_hash": F.col("commit_hash"), "short_hash": F.col("short_hash"), "branch_name": F.lit("main"),
            "author_name": F.lit(None).cast("string"), "author_email": F.col("email"),
            "committed_at": F.lit("2024-01-01 10:00:00").cast("timestamp"), "message": F.col("message"),
        },
        F.col("diff"),
    )
    seen = commits.rule_text(F.col("message"), F.col("diff"))
    staged = rows.withColumns({"seen": seen, "body": body}).withColumn("rule_risk", rules.commit_risk(F.col("seen")))
    # Every fifth row has a model analysis, some of it blank; rules fill in.
    llm = F.col("id") % 5 == 0
    area = F.when(llm & (F.col("id") % 2 == 0), "  backend  code ")
    risk = F.when(llm, F.when(F.col("id") % 3 == 0, " high! ").when(F.col("id") % 3 == 1, "low").otherwise("?"))
    return staged.select(
        "id",
        F.coalesce(F.nullif(t.squeeze(area), F.lit("")), rules.impact_area(F.col("seen"))).alias("impact_area"),
        F.when(llm, rules.normal_risk(risk, korean=False)).otherwise(F.col("rule_risk")).alias("risk_level"),
        F.when(llm, rules.COMMIT_DEFAULT_ACTION).otherwise(rules.commit_action(F.col("rule_risk"))).alias("next_action"),
        F.md5(rules.commit_summary(F.col("short_hash"), F.col("commit_hash"), F.col("message"))).alias("summary_md5"),
        F.md5(commits.preview(F.col("body"))).alias("preview_md5"),
        F.when(llm, "llm").otherwise("rule").alias("mode"),
    )


def document_rules(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    ext = F.get(F.array(*map(F.lit, (".md", ".pdf", ".txt", ".java"))), (i % 4).cast("int"))
    path = F.when(i % 23 != 0, F.concat(F.lit("/data/doc-"), i, ext))
    body = F.when(i % 11 != 0, F.col("text"))
    rows = _docs(spark, sf).select(
        i.alias("id"),
        F.concat(F.lit("Doc "), F.col("source")).alias("title"),
        F.when(i % 3 != 0, F.col("lang")).alias("doc_type"),
        F.when(i % 2 == 0, F.lit("task-1")).alias("task_id"),
        rules.file_preview(path, body).alias("preview"),
        rules.file_status(path, body).alias("file_status"),
    )
    src = rows.withColumn("src", rules.document_source(F.col("title"), F.col("doc_type"), F.col("preview"))).withColumn(
        "risk_level", rules.document_risk(F.col("src"))
    )
    return src.select(
        "id",
        "file_status",
        "risk_level",
        rules.document_keywords(F.col("src"), F.col("doc_type")).alias("keywords"),
        F.md5(rules.document_summary(F.col("title"), F.col("doc_type"), F.col("preview"))).alias("summary_md5"),
        rules.document_action(F.col("preview"), F.col("task_id"), F.col("risk_level")).alias("next_action"),
    )


def workspace_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as tasks by workspace, with recent commits and documents from other tables."""
    o = b.table(spark, sf, "orders").select(
        F.concat(F.lit("ws"), F.col("o_custkey") % 13).alias("workspace_id"), "o_orderstatus", "o_orderpriority", "o_custkey"
    )
    done, late = F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT"
    tasks = o.groupBy("workspace_id").agg(
        F.count(F.lit(1)).alias("total_task_count"),
        F.count_if(done & ((F.col("o_custkey") % 26 < 13) | late)).alias("done_task_count"),
        F.count_if(F.col("o_orderstatus") == "O").alias("in_progress_task_count"),
        F.count_if(late & (F.col("o_custkey") % 13 > 4)).alias("delayed_task_count"),
    )
    seen = (
        b.table(spark, sf, "events")
        .groupBy(F.concat(F.lit("ws"), F.col("user_id") % 13).alias("workspace_id"))
        .agg(
            F.count_if(F.col("event_type") == "click").alias("recent_git_commit_count"),
            F.count_if((F.col("event_type") == "view") & (F.col("user_id") % 13 > 6)).alias("recent_document_count"),
        )
    )
    counts = tasks.join(seen, "workspace_id").withColumn(
        "progress_rate", F.floor(F.col("done_task_count") * 100 / F.col("total_task_count")).cast("int")
    )
    names = [c for c in counts.columns if c != "workspace_id"]
    cols = {**{c: F.col(c) for c in names}, "workspace_name": F.upper("workspace_id")}
    return counts.select("workspace_id", *names, rules.workspace_summary(cols).alias("summary"))


# ---------------------------------------------------------------- conversations
def history_truncation(spark: SparkSession, sf: str) -> DataFrame:
    kept = history.truncate(b.table(spark, sf, "conversations"), budget=400)
    return kept.select("conv_id", "turn", "tokens", "truncated")


def turn_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    return history.turns(rows).select("conv_id", "turn", "turn_no", "is_first_turn")


def history_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The last user message of a conversation as the request, in front of it the messages
    before that fit the token budget, which bounds what is gathered."""
    c = b.table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(
        F.min_by(F.struct("role", "text"), "text").alias("m")
    ).select("conv_id", "turn", "m.role", "m.text")
    user = F.when(F.col("role") == "user", F.col("turn"))
    asked = c.groupBy("conv_id").agg(F.max(user).alias("asked_at"), F.max_by("text", user).alias("question")).where(
        "asked_at IS NOT NULL"
    )
    earlier = c.join(asked.select("conv_id", "asked_at"), "conv_id").where(F.col("turn") < F.col("asked_at"))
    kept = history.truncate(earlier, budget=400).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("msgs")
    )
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    block = t.label_lines(F.coalesce("msgs", none))
    return asked.join(kept, "conv_id", "left").select(
        "conv_id", "asked_at", F.md5(block).alias("history_md5"),
        F.md5(t.judge_prompt(F.col("question"), block)).alias("judge_md5"),
        F.md5(t.pair_prompt(F.col("question"), block)).alias("pair_md5"),
        F.md5(t.question_answer(F.col("question"), block)).alias("qa_md5"),
    )


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 10 != 0, F.concat(F.lit("\t "), F.col("text"), F.lit(" \n")))
    return _docs(spark, sf).select("doc_id", F.md5(t.squeeze(text)).alias("clean_md5"), F.length(t.squeeze(text)).alias("n"))


def role_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Message roles mapped to request roles, each with its template; unknown roles stand apart."""
    names = F.array(*map(F.lit, (*replies.ROLES, "visitor")))
    role = F.get(names, (F.col("conv_id") % 7).cast("int"))
    templates = (
        b.table(spark, sf, "nation")
        .where(F.col("n_nationkey") < len(replies.ROLES))
        .select(
            F.get(names, F.col("n_nationkey")).alias("role"),
            F.concat(F.lit("You are "), F.col("n_name"), F.lit(". {history}\n{context}")).alias("template"),
        )
    )
    # The history of a message is the one that came before it.
    before = Window.partitionBy("conv_id").orderBy("turn")
    last = F.lag(F.struct("role", "text")).over(before)
    said = b.table(spark, sf, "conversations").withColumn("history", t.label_lines(F.array_compact(F.array(last))))
    rows = said.where("role = 'user'").select("conv_id", "turn", role.alias("role"), "text", "history")
    known = rows.where(F.col("role").isin(*replies.ROLES))
    return known.join(F.broadcast(templates), "role").select(
        "conv_id", "turn", "role",
        F.md5(
            replies.render_template(
                F.col("template"), {"history": F.col("history"), "context": F.col("text")}
            )
        ).alias("prompt_md5"),
    )


def analysis_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents analysed by rules and by replies: some fail, some are missing or empty, some were
    not sent; the same documents once more with the model off."""
    i = F.col("doc_id")
    rows = b.table(spark, sf, "documents").select(
        i.alias("id"), F.when(F.contains("text", F.lit("the")), "HIGH").otherwise("LOW").alias("risk"),
        F.concat(F.lit("rules "), F.col("source")).alias("summary"), F.concat(F.lit("look at "), F.col("lang")).alias("action"),
        (i % 5 != 0).alias("sent"),
    )
    replies = b.table(spark, sf, "documents").where("doc_id % 4 <> 1").select(
        i.alias("id"), F.lit("MEDIUM").alias("risk"), F.when(i % 3 != 0, F.concat(F.lit("reply "), F.col("n_chars"))).alias("summary"),
        F.when(i % 6 == 0, "  ").otherwise("do").alias("action"), F.when(i % 7 == 2, "timeout").alias("error"),
    )
    columns = ["risk", "summary", "action"]
    defaults = {"summary": rules.EMPTY_SUMMARY, "action": rules.REVIEW_AGAIN}
    told = analysis.analyse(rows, replies, "id", columns, "LLM ", defaults=defaults, selected="sent")
    return told.unionByName(analysis.analyse(rows, replies, "id", columns, "rule_only")).drop("sent")


def normalize_model_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Messages wrapped as raw responses of three vendors, read back, with verdict and JSON."""
    i = F.col("conv_id") * 100 + F.col("turn")
    text = F.when(i % 4 == 0, " 'Yes.' ").when(i % 4 == 1, "NO!").when(
        i % 4 == 2, F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("text").alias("is_groundable"))), F.lit("\n```"))
    ).otherwise(F.col("text"))
    model = F.get(F.array(*map(F.lit, ("claude-x", "gpt-x", "gemini-x"))), (i % 3).cast("int"))
    n = F.length("text")
    bodies = [
        F.to_json(F.struct(
            F.array(F.struct(F.col("t").alias("text"))).alias("content"),
            F.struct(F.col("n").alias("input_tokens"), F.lit(7).alias("output_tokens"), F.lit(3).alias("cache_read_input_tokens")).alias("usage"),
            F.lit("end_turn").alias("stop_reason"),
        )),
        F.to_json(F.struct(
            F.array(F.struct(F.struct(F.col("t").alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices"),
            F.struct(F.col("n").alias("prompt_tokens"), F.lit(5).alias("completion_tokens")).alias("usage"),
        )),
        F.to_json(F.struct(
            F.array(F.struct(F.struct(F.array(F.struct(F.col("t").alias("text"))).alias("parts")).alias("content"), F.lit("STOP").alias("finishReason"))).alias("candidates"),
            F.struct(F.col("n").alias("promptTokenCount"), F.lit(4).alias("candidatesTokenCount"), F.lit(2).alias("thoughtsTokenCount")).alias("usageMetadata"),
        )),
    ]
    raw = b.table(spark, sf, "conversations").select(i.alias("id"), model.alias("model"), text.alias("t"), n.alias("n"))
    vendor = replies.provider(F.col("model"))
    body = F.when(vendor == "anthropic", bodies[0]).when(vendor == "openai", bodies[1]).otherwise(bodies[2])
    logged = raw.select("id", vendor.alias("vendor"), body.alias("body"))
    out = logged.select("id", "vendor", replies.normalized(F.col("vendor"), F.col("body")).alias("r"))
    return out.select(
        "id", "vendor", F.md5("r.text").alias("text_md5"), "r.input_tokens", "r.output_tokens", "r.thoughts_tokens",
        "r.finish_reason", "r.cache_read_tokens", replies.verdict(F.col("r.text")).alias("verdict"),
        replies.parse_json(F.col("r.text")).isNotNull().alias("parse_ok"),
    )


QUERIES = {
    "chunk_windows": chunk_windows,
    "answer_pieces": answer_pieces,
    "chunk_text": chunk_text,
    "chunk_markdown": chunk_markdown,
    "chunk_code": chunk_code,
    "chunk_sql": chunk_sql,
    "chunk_diff": chunk_diff,
    "embedding_input_usage": embedding_input_usage,
    "document_ingest_records": document_ingest_records,
    "chunk_metadata": chunk_metadata,
    "embed_batches": embed_batches,
    "risk_labels": risk_labels,
    "pii_scrub": pii_scrub,
    "commit_rules": commit_rules,
    "document_rules": document_rules,
    "workspace_summary": workspace_summary,
    "history_truncation": history_truncation,
    "turn_numbers": turn_numbers,
    "history_prompts": history_prompts,
    "clean_text": clean_text,
    "analysis_modes": analysis_modes,
    "role_templates": role_templates,
    "normalize_model_responses": normalize_model_responses,
}


def _case(pairs, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"


def _terms(col: str, terms) -> str:
    return f"regexp_matches({col}, '{'|'.join(terms)}')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


AREA = _case([(_terms("lower(seen)", ts), _q(a)) for a, ts in rules.IMPACT_AREAS], "'general'")
CRISK = _case(
    [(_terms("lower(seen)", rules.COMMIT_HIGH), "'HIGH'"), (_terms("lower(seen)", rules.COMMIT_MEDIUM), "'MEDIUM'")], "'LOW'"
)
KEYWORD_LIST = ", ".join(f"CASE WHEN contains(src, '{k}') THEN '{v}' END" for k, v in rules.KEYWORDS)
CACT = {k: _q(v) for k, v in rules.COMMIT_ACTIONS.items()}
DACT = {k: _q(v) for k, v in rules.DOCUMENT_ACTIONS.items()}
SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
EXTENSIONS = ", ".join(map(_q, rules.TEXT_EXTENSIONS))

ORACLE = {
    "chunk_windows": """SELECT doc_id, w AS chunk_index, w * 1300 AS char_start, least(w * 1300 + 1500, n) AS char_end,
        md5(substring(text, w * 1300 + 1, 1500)) AS content_md5
      FROM (SELECT doc_id, text, length(text) AS n, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1500 THEN 1
              ELSE 1 + ceil((length(text) - 1500) / 1300)::BIGINT END)) AS w FROM documents)""",
    "answer_pieces": """SELECT conv_id, turn, pos, substring(text, pos * 40 + 1, 40) AS piece
      FROM (SELECT *, unnest(range(0, ceil(length(text) / 40)::BIGINT)) AS pos FROM conversations WHERE role = 'assistant')""",
    "chunk_text": _chunk_sql("text", 1500, TEXT_SEGMENTS),
    "chunk_markdown": _chunk_sql("'# ' || source || chr(10) || replace(text, '.' || chr(10), '.' || chr(10) || chr(10) || '## ')", 1500, MD_SEGMENTS),
    "chunk_sql": _chunk_sql("replace(text, '.' || chr(10), ';' || chr(10))", 800, _several(SQL_PARTS, "[doc]")),
    "chunk_diff": _chunk_sql("'diff --git a b' || chr(10) || replace(text, '.' || chr(10), '.' || chr(10) || 'diff --git a b' || chr(10))", 800, _several(DIFF_PARTS, "[doc]")),
    "chunk_code": _chunk_sql(
        "replace(text, '.' || chr(10), CASE WHEN doc_id % 2 = 0 THEN '.' || chr(10) || 'def part(x):' || chr(10) || '    ' "
        "ELSE '.' || chr(10) || chr(10) || 'public void part() {' || chr(10) || '    ' END)",
        800,
        f"CASE WHEN doc_id % 2 = 0 THEN {_several(PY_PARTS, BLANK)} ELSE {_several(C_PARTS, BLANK)} END",
    ),
    "embedding_input_usage": """WITH w AS (
        SELECT doc_id, w, length(substring(text, w * 1300 + 1, 1500)) + CASE WHEN doc_id % 2 = 0 THEN length('ctx ' || doc_id) + 2 ELSE 0 END AS n
        FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1500 THEN 1
              ELSE 1 + ceil((length(text) - 1500) / 1300)::BIGINT END)) AS w FROM documents)),
      u AS (SELECT doc_id, count(*) AS chunk_count, count(DISTINCT w // 100) AS calls, sum(n)::BIGINT AS embedding_input_chars,
              round(count(*) * 0.2, 1)::DOUBLE AS estimated_tokens, CASE WHEN doc_id % 7 <> 0 THEN sum(ceil(n / 4.0))::BIGINT END AS provider_tokens FROM w GROUP BY 1)
      SELECT d.doc_id, length(text) AS char_count, 0.0::DOUBLE AS replacement_ratio, chunk_count, calls, embedding_input_chars, estimated_tokens, provider_tokens,
             CASE WHEN d.doc_id % 97 = 5 THEN 'FAILED' WHEN coalesce(chunk_count, 0) = 0 THEN 'EMPTY' ELSE 'COMPLETED' END AS result
      FROM documents d LEFT JOIN u USING (doc_id)""",
    "document_ingest_records": """WITH w AS (
        SELECT doc_id, w, doc_id + w AS k, doc_id % 2 = 0 AS made, length(substring(text, w * 1300 + 1, 1500)) + CASE WHEN doc_id % 2 = 0 AND (doc_id + w) % 3 <> 0 THEN length('ctx ' || doc_id) + 2 ELSE 0 END AS n
        FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1500 THEN 1
              ELSE 1 + ceil((length(text) - 1500) / 1300)::BIGINT END)) AS w FROM documents)),
      u AS (SELECT doc_id, count(*) AS c, sum(n)::BIGINT AS n, CASE WHEN doc_id % 7 <> 0 THEN sum(ceil(n / 4.0))::BIGINT END AS pt,
              coalesce(sum(k % 4 + 1) FILTER (made AND k % 5 <> 0), 0)::BIGINT AS calls, count(*) FILTER (made AND k % 5 = 0) AS reused,
              count(*) FILTER (made AND k % 5 <> 0 AND k % 3 = 0) AS failed, coalesce(sum(k % 4) FILTER (made AND k % 5 <> 0), 0)::BIGINT AS retried FROM w GROUP BY 1),
      d AS (SELECT *, least(doc_id % 29, 5) AS p, doc_id % 2 = 0 AS made FROM documents LEFT JOIN u USING (doc_id)),
      m AS (SELECT *, ((doc_id + 1) % 50)::DOUBLE AS t0, CASE WHEN p >= 1 THEN ((doc_id + 1) * 2 % 50)::DOUBLE END AS t1, CASE WHEN p >= 2 AND made THEN ((doc_id + 1) * 3 % 50)::DOUBLE END AS t2,
              CASE WHEN p >= 3 THEN ((doc_id + 1) * 4 % 50)::DOUBLE END AS t3, CASE WHEN p >= 4 THEN ((doc_id + 1) * 5 % 50)::DOUBLE END AS t4 FROM d)
      SELECT doc_id, 'ws' || (doc_id % 4) AS workspace_id, lang AS doc_type, strlen(text) AS file_bytes, CASE WHEN p >= 1 THEN length(text) ELSE 0 END AS char_count,
        CASE WHEN p >= 2 THEN coalesce(c, 0) ELSE 0 END AS chunk_count, CASE WHEN p >= 1 THEN 0.0::DOUBLE END AS replacement_ratio, CASE WHEN p >= 3 THEN n END AS embedding_input_chars,
        CASE WHEN p >= 4 THEN pt END AS embedding_provider_tokens, CASE WHEN p >= 3 THEN coalesce(calls, 0) ELSE 0 END AS context_llm_calls, CASE WHEN p >= 3 THEN coalesce(failed, 0) ELSE 0 END AS context_failed,
        CASE WHEN p >= 3 THEN coalesce(reused, 0) ELSE 0 END AS context_reused, CASE WHEN p >= 3 THEN coalesce(retried, 0) ELSE 0 END AS context_retried,
        t0 AS read_ms, t1 AS chunk_ms, t2 AS context_ms, t3 AS embed_ms, t4 AS store_ms, t0 + coalesce(t1, 0) + coalesce(t2, 0) + coalesce(t3, 0) + coalesce(t4, 0) AS total_ms,
        CASE WHEN p < 5 THEN 'FAILED' WHEN coalesce(c, 0) = 0 THEN 'EMPTY' ELSE 'COMPLETED' END AS result,
        CASE WHEN p < 5 THEN ['read', 'chunk', 'context', 'embed', 'store'][p + 1] END AS failure_stage, CASE WHEN p < 5 THEN 'E' || (doc_id % 3) END AS error_type FROM m""",
    "chunk_metadata": """SELECT doc_id, w AS chunk_index, (w * 1300)::VARCHAR AS m_char_start, '-1' AS m_char_end, sha1(substring(text, w * 1300 + 1, 1500)) AS m_content_sha1,
        source AS m_commit_hash, CASE WHEN doc_id % 2 = 0 THEN lang END AS m_branch_name
      FROM (SELECT *, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1500 THEN 1 ELSE 1 + ceil((length(text) - 1500) / 1300)::BIGINT END)) AS w FROM documents)""",
    "embed_batches": "SELECT conv_id, turn, length(text)::DOUBLE AS x0, CASE WHEN text = '' THEN 0 ELSE unicode(text) END::DOUBLE AS x1 FROM conversations",
    "risk_labels": """SELECT id, ['HIGH', 'HIGH', 'HIGH', 'LOW', 'LOW', 'MEDIUM', 'MEDIUM', 'MEDIUM', 'MEDIUM', 'MEDIUM'][id % 10 + 1] AS document_risk,
      ['HIGH', 'HIGH', 'MEDIUM', 'LOW', 'MEDIUM', 'MEDIUM', 'MEDIUM', 'LOW', 'MEDIUM', 'MEDIUM'][id % 10 + 1] AS commit_risk FROM (SELECT conv_id * 100 + turn AS id FROM conversations)""",
    "pii_scrub": f"""SELECT kind, id, md5(s) AS text_md5, {TOKEN_COUNT.format('s')} - {TOKEN_COUNT.format('text')} AS hits
      FROM (SELECT kind, id, text, {_scrub_sql('text')} AS s FROM (SELECT 'doc' AS kind, doc_id AS id, text FROM documents
            UNION ALL SELECT 'conv', conv_id * 100 + turn, text FROM conversations))""",
    "commit_rules": f"""WITH a AS (SELECT doc_id AS id, sha1(doc_id::VARCHAR) AS h, CASE WHEN doc_id % 2 = 0 THEN sha1(doc_id::VARCHAR)[:7] END AS sh,
          string_split(text, chr(10))[1] AS message,
          CASE WHEN doc_id % 3 <> 0 THEN {TRIM.format("'File: src/' || source || '.txt' || chr(10) || 'Change Type: ' || CASE WHEN doc_id % 2 = 0 THEN 'MODIFIED' ELSE 'UNKNOWN' END || chr(10) || 'Additions: ' || CASE WHEN doc_id % 5 <> 0 THEN doc_id % 90 ELSE 0 END || chr(10) || 'Deletions: 0' || CASE WHEN doc_id % 4 = 0 THEN chr(10) || 'Diff Summary:' || chr(10) || 'summary' ELSE '' END || CASE WHEN text <> '' THEN chr(10) || 'Patch:' || chr(10) || text ELSE '' END")}
               ELSE {TRIM.format("CASE WHEN doc_id % 6 = 0 THEN text ELSE '' END")} END AS diff FROM documents),
        c AS (SELECT *, message || chr(10) || diff AS seen,
          {TRIM.format("'Git Commit' || chr(10) || 'commit_hash: ' || h || chr(10) || 'short_hash: ' || coalesce(sh, '') || chr(10) || 'branch_name: main' || chr(10) || 'author_name: ' || chr(10) || 'committed_at: 2024-01-01T10:00:00+00:00' || chr(10) || chr(10) || 'Commit Message:' || chr(10) || message || CASE WHEN diff <> '' THEN chr(10) || chr(10) || 'Changed Files and Diff:' || chr(10) || diff ELSE '' END")} AS body FROM a),
        r AS (SELECT *, {CRISK} AS risk FROM c)
      SELECT id, CASE WHEN id % 10 = 0 THEN 'backend code' ELSE {AREA} END AS impact_area,
        CASE WHEN id % 5 = 0 THEN CASE id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'MEDIUM' END ELSE risk END AS risk_level,
        CASE WHEN id % 5 = 0 THEN {_q(rules.COMMIT_DEFAULT_ACTION)} WHEN risk = 'HIGH' THEN {CACT['HIGH']} WHEN risk = 'MEDIUM' THEN {CACT['MEDIUM']} ELSE {CACT['LOW']} END AS next_action,
        md5('Commit ' || coalesce(sh, h[:8]) || ' updates project code with message: ' || message) AS summary_md5,
        md5(body[:8000]) AS preview_md5, CASE WHEN id % 5 = 0 THEN 'llm' ELSE 'rule' END AS mode FROM r""",
    "document_rules": f"""WITH a AS (SELECT doc_id AS id, 'Doc ' || source AS title, CASE WHEN doc_id % 3 <> 0 THEN lang END AS doc_type,
          CASE WHEN doc_id % 2 = 0 THEN 'task-1' END AS task_id, ['.md', '.pdf', '.txt', '.java'][doc_id % 4 + 1] AS ext,
          CASE WHEN doc_id % 23 <> 0 THEN '/data/doc-' || doc_id || ['.md', '.pdf', '.txt', '.java'][doc_id % 4 + 1] END AS path,
          CASE WHEN doc_id % 11 <> 0 THEN text END AS body FROM documents),
        p AS (SELECT *, CASE WHEN path IS NULL THEN 'No file path was provided.' WHEN body IS NULL THEN 'File was not found at path: ' || path
          WHEN ext NOT IN ({EXTENSIONS}) THEN 'Text preview is not available for extension ''' || ext || '''. Only file metadata can be analyzed at this stage.'
          WHEN {TRIM.format('body')} = '' THEN 'The file is empty.' ELSE {TRIM.format('body')}[:2500] END AS preview,
          CASE WHEN path IS NULL THEN 'MISSING_FILE_PATH' WHEN body IS NULL THEN 'FILE_NOT_FOUND' WHEN ext NOT IN ({EXTENSIONS}) THEN 'NON_TEXT_FILE_METADATA_ONLY'
          ELSE 'TEXT_PREVIEW_AVAILABLE' END AS file_status FROM a),
        s AS (SELECT *, lower(title || ' ' || coalesce(doc_type, '') || ' ' || preview) AS src, {SQUEEZE.format('preview')} AS compact FROM p),
        r AS (SELECT *, CASE WHEN contains(src, 'file was not found') OR {_terms('src', rules.DOCUMENT_HIGH)} THEN 'HIGH'
          WHEN {_terms('src', rules.DOCUMENT_MEDIUM)} THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
          list_filter([{KEYWORD_LIST}, doc_type], lambda x: x IS NOT NULL) AS kw FROM s),
        d AS (SELECT *, list_filter(kw, lambda x, i: list_position(kw, x) = i) AS ukw FROM r)
      SELECT id, file_status, risk_level, CASE WHEN len(ukw) = 0 THEN 'document, task' ELSE array_to_string(ukw[:8], ', ') END AS keywords,
        md5(CASE WHEN contains(preview, 'File was not found') THEN '''' || title || ''' 문서는 ' || coalesce(doc_type, 'UNKNOWN') || ' 유형으로 등록되었지만, 저장된 파일 경로에서 원본 파일을 찾지 못했습니다.'
          WHEN contains(preview, 'Text preview is not available') THEN '''' || title || ''' 문서는 ' || coalesce(doc_type, 'UNKNOWN') || ' 유형으로 등록되었습니다. 현재 Day 2 분석기는 비텍스트 파일의 본문 추출을 수행하지 않으므로 파일 메타데이터 기준으로만 분석되었습니다.'
          ELSE '''' || title || ''' 문서는 ' || coalesce(doc_type, 'UNKNOWN') || ' 유형의 Task 관련 문서입니다. 텍스트 미리보기 기준 주요 내용은 다음과 같습니다: ' || CASE WHEN length(compact) > 420 THEN compact[:420] || '...' ELSE compact END END) AS summary_md5,
        CASE WHEN contains(preview, 'File was not found') THEN {DACT['missing']} WHEN task_id IS NULL THEN {DACT['no_task']} WHEN risk_level = 'HIGH' THEN {DACT['HIGH']}
          WHEN risk_level = 'MEDIUM' THEN {DACT['MEDIUM']} ELSE {DACT['LOW']} END AS next_action FROM d""",
    "workspace_summary": """WITH t AS (SELECT 'ws' || (o_custkey % 13) AS workspace_id, count(*) AS total_task_count,
          count(*) FILTER (o_orderstatus = 'F' AND (o_custkey % 26 < 13 OR o_orderpriority = '1-URGENT')) AS done_task_count,
          count(*) FILTER (o_orderstatus = 'O') AS in_progress_task_count,
          count(*) FILTER (o_orderpriority = '1-URGENT' AND o_custkey % 13 > 4) AS delayed_task_count FROM orders GROUP BY 1),
        e AS (SELECT 'ws' || (user_id % 13) AS workspace_id, count(*) FILTER (event_type = 'click') AS recent_git_commit_count,
          count(*) FILTER (event_type = 'view' AND user_id % 13 > 6) AS recent_document_count FROM events GROUP BY 1),
        c AS (SELECT t.*, recent_git_commit_count, recent_document_count, floor(done_task_count * 100 / total_task_count)::INT AS progress_rate FROM t JOIN e USING (workspace_id))
      SELECT *, '📊 ' || upper(workspace_id) || ' 워크스페이스에는 현재 총 ' || total_task_count || '개의 업무가 등록되어 있으며, 이 중 ' || done_task_count || '건이 완료(완료율 ' || progress_rate || '%), ' || in_progress_task_count || '건이 진행 중입니다.'
        || chr(10) || chr(10) || CASE WHEN delayed_task_count > 0 THEN '⚠️ 지연 업무가 ' || delayed_task_count || '건 있어 우선 확인이 필요합니다.' ELSE '✅ 현재 지연 업무가 없어 일정 리스크가 낮습니다.' END
        || CASE WHEN recent_git_commit_count > 0 THEN chr(10) || chr(10) || '🔄 최근 ' || recent_git_commit_count || '건의 Git Commit이 있어 활발한 개발이 진행 중입니다.' ELSE '' END
        || CASE WHEN recent_document_count > 0 THEN chr(10) || chr(10) || '📄 최근 ' || recent_document_count || '건의 문서가 업데이트되었습니다.' ELSE '' END
        || chr(10) || chr(10) || CASE WHEN progress_rate >= 70 THEN '💡 완료율이 높은 편이므로 마무리 작업과 산출물 검토에 집중하면 좋습니다.'
             WHEN progress_rate >= 40 THEN '💡 진행 중인 업무의 병목 여부를 확인하고 우선순위를 조정하는 것이 좋습니다.'
             ELSE '💡 초기 단계로 핵심 업무의 우선순위를 재정리하고 단기 목표를 설정하는 것이 좋습니다.' END AS summary FROM c""",
    "history_truncation": """WITH m AS (SELECT conv_id, turn, ceil(length(text) / 4.0)::BIGINT AS tokens FROM conversations),
      w AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS spent, count(*) OVER (PARTITION BY conv_id) AS n,
              row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM m),
      h AS (SELECT conv_id, sum(tokens) FILTER (pos <= 2) <= 120 AS keep_head FROM w GROUP BY 1),
      k AS (SELECT w.* FROM w JOIN h USING (conv_id) WHERE spent <= 400 OR (keep_head AND pos <= 2))
      SELECT conv_id, turn, tokens, count(*) OVER (PARTITION BY conv_id) < n AS truncated FROM k""",
    "turn_numbers": """SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 + 1 AS turn_no,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS is_first_turn FROM (SELECT DISTINCT conv_id, turn FROM conversations)""",
    "history_prompts": """WITH c AS (SELECT conv_id, turn, arg_min(role, text) AS role, min(text) AS text FROM conversations GROUP BY 1, 2),
      l AS (SELECT conv_id, max(turn) AS asked_at, arg_max(text, turn) AS question FROM c WHERE role = 'user' GROUP BY 1),
      m AS (SELECT c.*, ceil(length(text) / 4.0)::BIGINT AS tokens FROM c JOIN l USING (conv_id) WHERE turn < asked_at),
      w AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS spent, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM m),
      f AS (SELECT conv_id, sum(tokens) FILTER (pos <= 2) <= 120 AS keep_head FROM w GROUP BY 1),
      k AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '사용자' ELSE '어시스턴트' END || ': ' || text, chr(10) ORDER BY turn) AS block
            FROM w JOIN f USING (conv_id) WHERE spent <= 400 OR (keep_head AND pos <= 2) GROUP BY 1),
      h AS (SELECT conv_id, asked_at, question, coalesce(block, '') AS block FROM l LEFT JOIN k USING (conv_id))
      SELECT conv_id, asked_at, md5(block) AS history_md5, md5('질문: ' || question || chr(10) || chr(10) || '검색된 컨텍스트:' || chr(10) || block) AS judge_md5,
        md5('[질문 A]' || chr(10) || question || chr(10) || chr(10) || '[질문 B]' || chr(10) || block) AS pair_md5,
        md5('질문: ' || question || chr(10) || chr(10) || '답변: ' || block) AS qa_md5 FROM h""",
    "clean_text": f"SELECT doc_id, md5(s) AS clean_md5, length(s) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN {SQUEEZE.format('text')} ELSE '' END AS s FROM documents)",
    "analysis_modes": f"""WITH d AS (SELECT doc_id AS id, CASE WHEN contains(text, 'the') THEN 'HIGH' ELSE 'LOW' END AS risk, 'rules ' || source AS summary, 'look at ' || lang AS action, n_chars FROM documents),
      m AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'rule' WHEN id % 4 = 1 OR id % 7 = 2 THEN 'llm_fallback' ELSE 'llm' END AS mode FROM d)
      SELECT id, CASE mode WHEN 'llm' THEN 'MEDIUM' ELSE risk END AS risk, CASE mode WHEN 'llm' THEN CASE WHEN id % 3 <> 0 THEN 'reply ' || n_chars ELSE '{rules.EMPTY_SUMMARY}' END ELSE summary END AS summary,
        CASE mode WHEN 'llm' THEN CASE WHEN id % 6 = 0 THEN '{rules.REVIEW_AGAIN}' ELSE 'do' END ELSE action END AS action, mode AS analysis_mode FROM m
      UNION ALL SELECT id, risk, summary, action, 'rule_only' FROM d""",
    "role_templates": """WITH r AS (SELECT n_nationkey, ['planner', 'developer', 'qa', 'designer', 'operator', 'newcomer'][n_nationkey + 1] AS role, n_name FROM nation WHERE n_nationkey < 6)
      SELECT conv_id, turn, role, md5('You are ' || n_name || '. ' || coalesce(CASE before.role WHEN 'user' THEN '사용자' ELSE '어시스턴트' END || ': ' || before.text, '') || chr(10) || c.text) AS prompt_md5
      FROM (SELECT *, lag(struct_pack(role := role, text := text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) c JOIN r ON r.n_nationkey = conv_id % 7 WHERE c.role = 'user'""".replace("conv_id, turn, role, md5", "conv_id, turn, r.role AS role, md5"),
    "normalize_model_responses": """SELECT id, vendor, md5(t) AS text_md5, n AS input_tokens, CASE vendor WHEN 'anthropic' THEN 7 WHEN 'openai' THEN 5 ELSE 6 END AS output_tokens,
        CASE WHEN vendor = 'gemini' THEN 2 ELSE 0 END AS thoughts_tokens, CASE vendor WHEN 'anthropic' THEN 'end_turn' WHEN 'openai' THEN 'stop' ELSE 'STOP' END AS finish_reason,
        CASE WHEN vendor = 'anthropic' THEN 3 ELSE 0 END AS cache_read_tokens, CASE id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'invalid' END AS verdict,
        id % 4 = 2 AS parse_ok
      FROM (SELECT conv_id * 100 + turn AS id, length(text) AS n, ['anthropic', 'openai', 'gemini'][(conv_id * 100 + turn) % 3 + 1] AS vendor,
              CASE (conv_id * 100 + turn) % 4 WHEN 0 THEN ' ''Yes.'' ' WHEN 1 THEN 'NO!' WHEN 2 THEN '```json' || chr(10) || json_object('is_groundable', text)::VARCHAR || chr(10) || '```' ELSE text END AS t FROM conversations)""",
}

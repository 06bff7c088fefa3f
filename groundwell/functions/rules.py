"""Keyword rules for commits, documents and workspaces, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundwell.functions.text import squeeze, strip

# --- Fixed values: commit rules -----------------------------------------------------------
IMPACT_AREAS = (
    ("security", ("security", "auth", "jwt", "permission", "csrf")),
    ("database", ("migration", "schema", "repository", "entity", "sql", "table")),
    ("api", ("controller", "router", "endpoint", "request", "response", "api")),
    ("ai-engine", ("embedding", "vector", "chroma", "llm", "rag", "fastapi")),
    ("frontend", ("vue", "react", "tsx", "component", "ui", "page")),
    ("backend", ("spring", "service", "java", "gradle")),
    ("git", ("git", "commit", "diff")),
    ("infra", ("docker", "compose", "env", "config")),
)
COMMIT_HIGH = (
    "security", "password", "secret", "token", "delete", "drop table", "migration", "breaking",
    "critical", "vulnerability",
)
COMMIT_MEDIUM = (
    "todo", "fixme", "warning", "deprecated", "refactor", "schema", "permission", "auth", "exception",
)
COMMIT_ACTIONS = {
    "HIGH": "Review this commit carefully, verify migration/security impact, and run related regression checks.",
    "MEDIUM": "Review affected modules and confirm build/test results before release.",
    "LOW": "Confirm build status and include the commit in the normal review flow.",
}
COMMIT_DEFAULT_ACTION = "Review the commit and verify related tests or build checks."

# --- Fixed values: document rules ---------------------------------------------------------
TEXT_EXTENSIONS = (
    ".txt", ".md", ".csv", ".json", ".log", ".java", ".kt", ".py", ".js", ".ts", ".tsx", ".vue", ".html",
    ".css", ".scss", ".sql", ".yml", ".yaml", ".xml",
)
DOCUMENT_HIGH = (
    "error", "exception", "fail", "failed", "failure", "critical", "urgent", "security", "vulnerability",
    "breach", "password", "secret", "token", "api key", "apikey", "private key",
)
DOCUMENT_MEDIUM = (
    "todo", "fixme", "risk", "issue", "bug", "delay", "blocked", "migration", "deprecated", "warning", "conflict",
)
KEYWORDS = (
    ("api", "API"), ("task", "Task"), ("workspace", "Workspace"), ("document", "document"), ("error", "error"),
    ("risk", "risk"), ("database", "database"), ("db", "database"), ("upload", "upload"), ("analysis", "analysis"),
    ("git", "Git"), ("commit", "commit"), ("security", "security"), ("llm", "LLM"), ("rag", "RAG"),
    ("embedding", "embedding"), ("frontend", "frontend"), ("backend", "backend"), ("fastapi", "FastAPI"),
    ("spring", "Spring"),
)
DEFAULT_KEYWORDS = ("document", "task")
MAX_KEYWORDS, PREVIEW_CHARS, SUMMARY_CHARS = 8, 2500, 420
NOT_FOUND, NO_PREVIEW = "File was not found", "Text preview is not available"
DOCUMENT_ACTIONS = {
    "missing": "문서 저장 경로와 파일 업로드 상태를 먼저 확인한 뒤 AI 분석을 다시 실행하세요.",
    "no_task": "문서를 관련 Task에 연결한 뒤 업무 기준으로 다시 분석하세요.",
    "HIGH": "문서의 위험 요소를 담당자가 즉시 검토하고 Task 상태, 우선순위, 대응 일정을 갱신하세요.",
    "MEDIUM": "문서 내용을 검토하고 Task 진행 상태, 요구사항 반영 여부, 추가 산출물 필요 여부를 확인하세요.",
    "LOW": "문서 내용을 Task 맥락에 반영하고 필요한 경우 다음 작업 또는 검토자를 지정하세요.",
}
EMPTY_SUMMARY = "문서 분석 결과 요약이 비어 있습니다."
REVIEW_AGAIN = "문서 내용을 재검토하고 Task 진행 상태와 후속 조치를 갱신하세요."


def _any(text: Column, terms: tuple[str, ...]) -> Column:
    """Substring test for any of a few plain terms, as one regular expression."""
    return text.rlike("|".join(terms))


def impact_area(text: Column) -> Column:
    """First area one of whose terms occurs in the text."""
    low = F.lower(text)
    found = F.lit("general")
    for label, terms in reversed(IMPACT_AREAS):
        found = F.when(_any(low, terms), label).otherwise(found)
    return found


def commit_risk(text: Column) -> Column:
    low = F.lower(text)
    return F.when(_any(low, COMMIT_HIGH), "HIGH").when(_any(low, COMMIT_MEDIUM), "MEDIUM").otherwise("LOW")


def commit_action(risk: Column) -> Column:
    return (
        F.when(risk == "HIGH", COMMIT_ACTIONS["HIGH"])
        .when(risk == "MEDIUM", COMMIT_ACTIONS["MEDIUM"])
        .otherwise(COMMIT_ACTIONS["LOW"])
    )


def commit_summary(short_hash: Column, commit_hash: Column, message: Column) -> Column:
    name = F.coalesce(F.when(short_hash != "", short_hash), F.left(commit_hash, F.lit(8)))
    return F.concat(F.lit("Commit "), name, F.lit(" updates project code with message: "), message)


def file_preview(path: Column, text: Column, limit: int = PREVIEW_CHARS) -> Column:
    """Preview text of a file or the reason there is none; a NULL text is a missing file."""
    suffix = F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1)
    body = strip(text)
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "No file path was provided.")
        .when(text.isNull(), F.concat(F.lit("File was not found at path: "), path))
        .when(
            ~F.lower(suffix).isin(*TEXT_EXTENSIONS),
            F.concat(
                F.lit("Text preview is not available for extension '"), suffix,
                F.lit("'. Only file metadata can be analyzed at this stage."),
            ),
        )
        .when(body == "", "The file is empty.")
        .otherwise(F.left(body, F.lit(limit)))
    )


def file_status(path: Column, text: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "MISSING_FILE_PATH")
        .when(text.isNull(), "FILE_NOT_FOUND")
        .when(~suffix.isin(*TEXT_EXTENSIONS), "NON_TEXT_FILE_METADATA_ONLY")
        .otherwise("TEXT_PREVIEW_AVAILABLE")
    )


def document_source(title: Column, doc_type: Column, preview: Column) -> Column:
    """Lower-case text the document rules look at."""
    return F.lower(F.concat(title, F.lit(" "), F.coalesce(doc_type, F.lit("")), F.lit(" "), preview))


def document_risk(source: Column) -> Column:
    return (
        F.when(source.contains(NOT_FOUND.lower()) | _any(source, DOCUMENT_HIGH), "HIGH")
        .when(_any(source, DOCUMENT_MEDIUM), "MEDIUM")
        .otherwise("LOW")
    )


def document_keywords(source: Column, doc_type: Column) -> Column:
    """Labels of the terms found, then the document type, at most eight, comma separated."""
    labels = F.array(*(F.when(source.contains(term), label) for term, label in KEYWORDS))
    found = F.array_distinct(F.array_compact(F.array_append(labels, F.when(doc_type != "", doc_type))))
    some = F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, DEFAULT_KEYWORDS)))
    return F.array_join(F.slice(some, 1, MAX_KEYWORDS), ", ")


def document_summary(title: Column, doc_type: Column, preview: Column) -> Column:
    name = F.coalesce(F.when(title != "", title), F.lit("Untitled document"))
    kind = F.coalesce(F.when(doc_type != "", doc_type), F.lit("UNKNOWN"))
    compact = squeeze(preview)
    short = F.when(
        F.length(compact) > SUMMARY_CHARS, F.concat(F.left(compact, F.lit(SUMMARY_CHARS)), F.lit("..."))
    ).otherwise(compact)
    head = F.concat(F.lit("'"), name, F.lit("' 문서는 "), kind, F.lit(" 유형"))
    return (
        F.when(
            preview.contains(NOT_FOUND),
            F.concat(head, F.lit("으로 등록되었지만, 저장된 파일 경로에서 원본 파일을 찾지 못했습니다.")),
        )
        .when(
            preview.contains(NO_PREVIEW),
            F.concat(
                head,
                F.lit(
                    "으로 등록되었습니다. 현재 Day 2 분석기는 비텍스트 파일의 본문 추출을 수행하지 않으므로 "
                    "파일 메타데이터 기준으로만 분석되었습니다."
                ),
            ),
        )
        .otherwise(
            F.concat(head, F.lit("의 Task 관련 문서입니다. 텍스트 미리보기 기준 주요 내용은 다음과 같습니다: "), short)
        )
    )


def document_action(preview: Column, task_id: Column, risk: Column) -> Column:
    say = {k: F.lit(v) for k, v in DOCUMENT_ACTIONS.items()}
    return (
        F.when(preview.contains(NOT_FOUND), say["missing"])
        .when(F.coalesce(task_id, F.lit("")) == "", say["no_task"])
        .when(risk == "HIGH", say["HIGH"])
        .when(risk == "MEDIUM", say["MEDIUM"])
        .otherwise(say["LOW"])
    )


def normal_risk(label: Column, korean: bool) -> Column:
    """Model risk label to LOW, MEDIUM or HIGH. Document labels may be Korean and prefer
    MEDIUM to LOW where both occur; commit labels have neither rule."""
    t = F.upper(strip(F.coalesce(label, F.lit(""))))
    if korean:
        return (
            F.when(t.rlike("HIGH|높"), "HIGH")
            .when(t.rlike("MEDIUM|보통|중"), "MEDIUM")
            .when(t.rlike("LOW|낮"), "LOW")
            .otherwise("MEDIUM")
        )
    return F.when(t.contains("HIGH"), "HIGH").when(t.contains("LOW"), "LOW").otherwise("MEDIUM")


def workspace_summary(c: dict[str, Column]) -> Column:
    """Status text of a workspace from its counts."""
    s = {k: v.cast("string") for k, v in c.items()}
    head = F.concat(
        F.lit("📊 "), s["workspace_name"], F.lit(" 워크스페이스에는 현재 총 "), s["total_task_count"],
        F.lit("개의 업무가 등록되어 있으며, 이 중 "), s["done_task_count"], F.lit("건이 완료(완료율 "),
        s["progress_rate"], F.lit("%), "), s["in_progress_task_count"], F.lit("건이 진행 중입니다."),
    )
    late = F.when(
        c["delayed_task_count"] > 0,
        F.concat(F.lit("⚠️ 지연 업무가 "), s["delayed_task_count"], F.lit("건 있어 우선 확인이 필요합니다.")),
    ).otherwise("✅ 현재 지연 업무가 없어 일정 리스크가 낮습니다.")
    commits = F.when(
        c["recent_git_commit_count"] > 0,
        F.concat(F.lit("🔄 최근 "), s["recent_git_commit_count"], F.lit("건의 Git Commit이 있어 활발한 개발이 진행 중입니다.")),
    )
    docs = F.when(
        c["recent_document_count"] > 0,
        F.concat(F.lit("📄 최근 "), s["recent_document_count"], F.lit("건의 문서가 업데이트되었습니다.")),
    )
    advice = (
        F.when(c["progress_rate"] >= 70, "💡 완료율이 높은 편이므로 마무리 작업과 산출물 검토에 집중하면 좋습니다.")
        .when(c["progress_rate"] >= 40, "💡 진행 중인 업무의 병목 여부를 확인하고 우선순위를 조정하는 것이 좋습니다.")
        .otherwise("💡 초기 단계로 핵심 업무의 우선순위를 재정리하고 단기 목표를 설정하는 것이 좋습니다.")
    )
    return F.concat_ws("\n\n", head, late, commits, docs, advice)

"""Reading what models reply, and guarding rewritten queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundwell.functions.text import strip

# Rewrite guard limits, endings, prefixes and quotes.
MIN_LIMIT, MAX_LENGTH, GROWTH = 40, 80, 4
ANSWER_ENDING = r"니다\.?\z"
ANSWER_PREFIX = r"\A(?:출력|재작성):"
QUOTES = "\"'“”‘’「」"


def verdict(text: Column) -> Column:
    """`yes`, `no` or `invalid`: white space, quotes and closing punctuation do not count."""
    bare = F.regexp_replace(strip(text), r"\A[`'\"]+|[`'\"]+\z", "")
    token = F.upper(F.regexp_replace(bare, r"[.!。 ]+\z", ""))
    return F.when(token == "YES", "yes").when(token == "NO", "no").otherwise("invalid")


def without_fence(text: Column) -> Column:
    """Reply text without a surrounding code fence."""
    t = strip(text)
    lines = F.split(t, r"\r\n|\r|\n", -1)
    count = F.size(lines)
    closed = strip(F.element_at(lines, -1)) == "```"
    kept = F.slice(lines, 2, F.when(closed, F.greatest(count - 2, F.lit(0))).otherwise(count - 1))
    return F.when(t.startswith("```"), F.when(count > 1, F.array_join(kept, "\n")).otherwise("")).otherwise(t)


def parse_json(text: Column) -> Column:
    """Reply as VARIANT; NULL where it cannot be parsed."""
    return F.try_parse_json(without_fence(text))


def provider(model: Column) -> Column:
    """Vendor family by model prefix; NULL for an unknown one."""
    return (
        F.when(model.startswith("claude"), "anthropic")
        .when(model.startswith("gpt") | model.startswith("o"), "openai")
        .when(model.startswith("gemini"), "gemini")
    )


def normalized(vendor: Column, body: Column) -> Column:
    """struct<text, input_tokens, output_tokens, thoughts_tokens, finish_reason,
    cache_read_tokens, cache_creation_tokens> from a raw JSON response of any vendor."""
    v = F.try_parse_json(body)
    text = lambda path: F.try_variant_get(v, path, "string")
    num = lambda path: F.coalesce(F.try_variant_get(v, path, "long"), F.lit(0).cast("long"))
    raw = lambda path: F.try_variant_get(v, path, "long")

    def by(anthropic: Column, openai: Column, gemini: Column) -> Column:
        return F.when(vendor == "anthropic", anthropic).when(vendor == "openai", openai).otherwise(gemini)

    zero = F.lit(0).cast("long")
    thoughts = num("$.usageMetadata.thoughtsTokenCount")
    return F.struct(
        by(
            text("$.content[0].text"),
            text("$.choices[0].message.content"),
            F.coalesce(text("$.candidates[0].content.parts[0].text"), F.lit("")),
        ).alias("text"),
        by(raw("$.usage.input_tokens"), raw("$.usage.prompt_tokens"), num("$.usageMetadata.promptTokenCount")).alias("input_tokens"),
        by(
            raw("$.usage.output_tokens"), raw("$.usage.completion_tokens"),
            num("$.usageMetadata.candidatesTokenCount") + thoughts,
        ).alias("output_tokens"),
        by(zero, zero, thoughts).alias("thoughts_tokens"),
        by(text("$.stop_reason"), text("$.choices[0].finish_reason"), text("$.candidates[0].finishReason")).alias("finish_reason"),
        by(num("$.usage.cache_read_input_tokens"), zero, zero).alias("cache_read_tokens"),
        by(num("$.usage.cache_creation_input_tokens"), zero, zero).alias("cache_creation_tokens"),
    )


def answer_like(original: Column, rewritten: Column) -> Column:
    """Whether a rewritten query looks like an answer instead of a query."""
    t = strip(rewritten)
    limit = F.greatest(F.length(original) * GROWTH, F.lit(MIN_LIMIT))
    quoted = F.instr(F.lit(QUOTES), F.left(t, F.lit(1))) * F.instr(F.lit(QUOTES), F.right(t, F.lit(1))) > 0
    looks = (
        (F.length(t) > limit)
        | (F.length(t) > MAX_LENGTH)
        | rewritten.contains("\n")
        | t.rlike(ANSWER_ENDING)
        | quoted
        | t.rlike(ANSWER_PREFIX)
    )
    return (t != "") & (t != strip(original)) & looks


def accepted_rewrite(original: Column, rewritten: Column) -> Column:
    """The rewritten query, or the original where the rewrite is empty or answer-like."""
    t = strip(F.coalesce(rewritten, F.lit("")))
    return F.when((t == "") | answer_like(original, t), original).otherwise(t)


def keyword_hit_rate(rewritten: Column, keywords: Column) -> Column:
    """Share of keywords that occur, ignoring case; 1.0 without keywords."""
    low = F.lower(F.coalesce(rewritten, F.lit("")))
    hits = F.size(F.filter(keywords, lambda k: low.contains(F.lower(k))))
    return F.when(F.size(F.coalesce(keywords, F.array())) == 0, F.lit(1.0)).otherwise(hits / F.size(keywords))


def passthrough(original: Column, rewritten: Column) -> Column:
    return strip(F.coalesce(rewritten, F.lit(""))) == strip(F.coalesce(original, F.lit("")))


# Roles a request may have.
ROLES = ("planner", "developer", "qa", "designer", "operator", "newcomer")


def render_template(template: Column, values: dict[str, Column]) -> Column:
    """Replaces `{name}` placeholders of a template."""
    for name, value in values.items():
        template = F.replace(template, F.lit(f"{{{name}}}"), value)
    return template

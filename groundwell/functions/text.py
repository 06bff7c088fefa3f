"""Text column expressions. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: marker appended to cut text.
CUT_MARK = "…(생략)"
# Unicode white space, with the four separators that Java's class leaves out.
WS = r"[\s\x1C-\x1F]"
# The same characters one by one, for trimming.
SPACES = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

Tokenizer = Callable[[Column], Column]


def strip(col: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(col, F.lit(SPACES))


def is_blank(col: Column) -> Column:
    return strip(col) == ""


def squeeze(col: Column) -> Column:
    """NULL becomes '', runs of white space become one space, ends are trimmed."""
    return strip(F.regexp_replace(F.coalesce(col, F.lit("")), rf"(?U){WS}+", " "))


def cut(col: Column, limit: int, mark: str = CUT_MARK) -> Column:
    """First `limit` characters, with a mark when something was cut. limit <= 0 keeps all."""
    if limit <= 0:
        return col
    return F.when(F.length(col) > limit, F.concat(F.left(col, F.lit(limit)), F.lit(mark))).otherwise(col)


def tokenize(text: Column) -> Column:
    """Hangul runs and Latin/digit runs in lower case; Hangul runs of four or more
    characters are followed by all of their two-character windows."""
    runs = F.regexp_extract_all(text, F.lit("[가-힣]+|[a-zA-Z0-9_]+"), F.lit(0))

    def spread(run: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(1), F.length(run) - 1), lambda i: run.substr(i, F.lit(2))
        )
        return F.when(
            run.rlike("^[가-힣]{4,}$"), F.concat(F.array(run), pairs)
        ).otherwise(F.array(F.lower(run)))

    # Latin-only text takes the flat branch and never builds an array per token.
    return F.when(text.rlike("[가-힣]{4}"), F.flatten(F.transform(runs, spread))).otherwise(
        F.transform(runs, F.lower)
    )


def pieces(text: Column, size: int) -> Column:
    """Cut text into consecutive pieces of `size` characters (the last may be shorter)."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Overlapping windows as array<struct<at, body>>, `at` counted from 0.

    A window is one stride piece plus the head of the piece after it, so the text is
    read once whatever its length. Needs overlap <= size - overlap.
    """
    stride = size - overlap
    assert 0 <= overlap <= stride
    length = F.length(text)
    count = F.when(length <= size, 1).otherwise(
        1 + F.ceil((length - size) / F.lit(float(stride)))
    ).cast("int")
    cuts = pieces(text, stride)
    # Neighbours meet in zip_with: looking them up by index in a lambda would cut the
    # text again for every window.
    bodies = F.zip_with(
        cuts,
        F.slice(cuts, 2, F.greatest(F.size(cuts), F.lit(1))),
        lambda piece, after: F.concat(piece, F.left(F.coalesce(after, F.lit("")), F.lit(overlap))),
    )
    placed = F.transform(
        F.slice(bodies, 1, count),
        lambda body, i: F.struct((i * stride).alias("at"), body.alias("body")),
    )
    empty = F.array().cast("array<struct<at:int,body:string>>")
    return F.when(length > 0, placed).otherwise(empty)


def ceil_tokens(text: Column) -> Column:
    """Default token estimate: one token per four characters. Pass another estimator
    (a column function or a pandas_udf over a BPE vocabulary) where counts must be exact."""
    return F.ceil(F.length(text) / F.lit(4.0)).cast("long")


def replacement_ratio(text: Column) -> Column:
    """Share of U+FFFD characters; 0.0 for empty text."""
    bad = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return F.when(F.length(text) > 0, bad / F.length(text)).otherwise(F.lit(0.0))


def safe_name(col: Column) -> Column:
    """Whether a value may be used as a path component."""
    return col.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,63}\z")


def short_digest(col: Column) -> Column:
    """First 12 hex digits of SHA-256, used instead of session ids in reports."""
    return F.left(F.sha2(col, 256), F.lit(12))


# Personal-data patterns and their tokens, applied in this order.
PII_RULES: tuple[tuple[str, str], ...] = (
    ("URL", r"(?iU)https?://[^\s<>\"'\)\]]+"),
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("RRN", r"(?U)(?<!\d)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])-?[1-4]\d{6}(?!\d)"),
    (
        "PHONE",
        r"(?U)(?<![\d-])(?:"
        r"\+82[-.\s]?(?:0?1[016789]|0?2|0?[3-6]\d|0?70)[-.\s]?\d{3,4}[-.\s]?\d{4}"
        r"|01[016789][-.\s]?\d{3,4}[-.\s]?\d{4}"
        r"|0(?:2|[3-6]\d|70)[-.\s]?\d{3,4}[-.\s]?\d{4}"
        r")(?![\d-])",
    ),
    (
        "IP",
        r"(?U)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}"
        r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d)(?!\.\d)",
    ),
)
# What a text must contain for a rule to match at all, much cheaper to look for.
PII_NEEDS = {
    "URL": lambda c: c.contains("://"),
    "EMAIL": lambda c: c.contains("@"),
    "RRN": lambda c: c.rlike(r"\p{Nd}{6}"),
    "PHONE": lambda c: c.rlike(r"\p{Nd}{4}"),
    "IP": lambda c: c.rlike(r"\p{Nd}\."),
}


def scrub(df: DataFrame, columns: list[str], hits: str) -> DataFrame:
    """Replace personal data in `columns` by fixed tokens and count replacements in `hits`.

    One projection per rule: each pattern sees the text the rule before it left, and
    every intermediate text is computed once.
    """
    df = df.withColumn(hits, F.lit(0))
    for name, pattern in PII_RULES:
        may = {c: PII_NEEDS[name](F.col(c)) for c in columns}
        found = sum(
            (F.when(may[c], F.regexp_count(c, F.lit(pattern))).otherwise(0) for c in columns), F.lit(0)
        )
        clean = {
            c: F.when(may[c], F.regexp_replace(c, pattern, f"[{name}]")).otherwise(F.col(c)) for c in columns
        }
        df = df.withColumns({hits: F.col(hits) + found, **clean})
    return df


def label_lines(messages: Column) -> Column:
    """History block: one `label: text` line per message of array<struct<role, text>>."""
    return F.array_join(
        F.transform(
            messages,
            lambda m: F.concat(
                F.when(m["role"] == "user", "사용자").otherwise("어시스턴트"),
                F.lit(": "),
                F.coalesce(m["text"], F.lit("")),
            ),
        ),
        "\n",
    )


def question_answer(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("질문: "), question, F.lit("\n\n답변: "), answer)


def judge_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("질문: "), question, F.lit("\n\n검색된 컨텍스트:\n"), context)


def pair_prompt(cached: Column, new: Column) -> Column:
    return F.concat(F.lit("[질문 A]\n"), cached, F.lit("\n\n[질문 B]\n"), new)


def embedding_input(context: Column, content: Column) -> Column:
    """Generated context goes in front of the text that is embedded, when there is one."""
    return F.when(
        F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n\n"), content)
    ).otherwise(content)

"""Texts built from commit payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundwell.functions.text import strip

# Fixed value: characters of commit text shown to an analysis model.
PREVIEW_CHARS = 8000


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def _one_file(f: Column) -> Column:
    head = F.concat(
        F.lit("File: "), f["file_path"],
        F.lit("\nChange Type: "), F.coalesce(F.when(f["change_type"] != "", f["change_type"]), F.lit("UNKNOWN")),
        F.lit("\nAdditions: "), F.coalesce(f["additions"], F.lit(0)).cast("string"),
        F.lit("\nDeletions: "), F.coalesce(f["deletions"], F.lit(0)).cast("string"),
    )
    part = lambda name, title: F.when(
        _text(f[name]) != "", F.concat(F.lit(f"\n{title}:\n"), f[name])
    ).otherwise("")
    return F.concat(head, part("diff_summary", "Diff Summary"), part("patch", "Patch"))


def diff_text(files: Column, legacy: Column) -> Column:
    """Changed files as blocks, or the single diff older callers send."""
    return F.when(
        F.size(F.coalesce(files, F.array())) > 0, strip(F.array_join(F.transform(files, _one_file), "\n\n"))
    ).otherwise(strip(_text(legacy)))


def iso_time(ts: Column) -> Column:
    """ISO 8601 in UTC, with fractions only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


def commit_text(c: dict[str, Column], diff: Column) -> Column:
    """Text that is chunked and embedded for a commit; `c` maps payload fields to columns."""
    head = F.concat_ws(
        "\n",
        F.lit("Git Commit"),
        F.concat(F.lit("commit_hash: "), c["commit_hash"]),
        F.concat(F.lit("short_hash: "), _text(c["short_hash"])),
        F.concat(F.lit("branch_name: "), _text(c["branch_name"])),
        F.concat(F.lit("author_name: "), _text(c["author_name"])),
        F.concat(F.lit("author_email: "), _text(c["author_email"])),
        F.concat(F.lit("committed_at: "), iso_time(c["committed_at"])),
        F.lit(""),
        F.lit("Commit Message:"),
        _text(c["message"]),
    )
    tail = F.when(diff != "", F.concat(F.lit("\n\nChanged Files and Diff:\n"), diff)).otherwise("")
    return strip(F.concat(head, tail))


def preview(text: Column, limit: int = PREVIEW_CHARS) -> Column:
    """Commit text without its author_email line, cut to the model's limit."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]", -1), lambda s: ~s.startswith("author_email:"))
    return F.left(F.array_join(lines, "\n"), F.lit(limit))


def rule_text(message: Column, diff: Column) -> Column:
    """What the keyword rules see: message and diff, without the header."""
    return F.concat(_text(message), F.lit("\n"), diff)

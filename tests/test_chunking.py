import random

import pytest

from groundwell.operators.chunking import chunk


def run(spark, text, doc_type):
    df = spark.createDataFrame([(1, text, doc_type)], "id long, text string, doc_type string")
    rows = chunk(df, ["id"]).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert all(r["char_end"] - r["char_start"] == len(r["content"]) for r in rows)
    return [(r["char_start"], r["content"]) for r in rows]


def plain(text, segments, size, overlap):
    """The merge rule, the search for offsets and the windows, one step at a time."""
    merged = []
    for seg in segments:
        if merged and min(len(seg), len(merged[-1])) < size * 0.2 and len(merged[-1]) + len(seg) + 1 <= size:
            merged[-1] += "\n" + seg
        else:
            merged.append(seg)
    out, cursor = [], 0
    for body in merged:
        at = text.find(body, cursor)
        at = cursor if at < 0 else at
        start = 0
        while True:
            out.append((at + start, body[start : start + size]))
            if start + size >= len(body):
                break
            start += size - overlap
        cursor = at + len(body)
    return out


def test_blank_documents_give_no_rows(spark):
    for kind in ("text", "md", "python", "sql", "git_diff"):
        assert run(spark, " \n\t ", kind) == []


def test_short_text_is_one_chunk(spark):
    assert run(spark, "  hello world \n", "text") == [(0, "hello world")]


def test_paragraphs_merge_when_small(spark):
    paras = ["a" * 700, "b" * 100, "c" * 900, "d" * 20]
    text = "\n\n".join(paras)
    assert run(spark, text, "text") == plain(text, paras, 1500, 200)


def test_long_paragraph_splits_into_sentences_and_windows(spark):
    sentences = ["s" * 800 + ".", "t" * 4000 + "!", "short?"]
    text = " ".join(sentences)
    assert run(spark, text, "text") == plain(text, sentences, 1500, 200)


def test_random_texts(spark):
    rng = random.Random(7)
    for _ in range(5):
        paras = ["p" * rng.choice([1, 40, 250, 299, 300, 301, 1200, 1499, 1500]) for _ in range(30)]
        text = "\n\n".join(paras)
        assert run(spark, text, "general") == plain(text, paras, 1500, 200)


def test_markdown_marks_are_pieces_of_their_own(spark):
    text = "intro\n# One\nbody one\n## Two\n" + "x" * 400 + "\n\n" + "y" * 1300
    got = run(spark, text, "md")
    pieces = ["intro", "#", "One\nbody one", "##"]
    assert [c for _, c in got] == [c for _, c in plain(text, [*pieces, "Two\n" + "x" * 400, "y" * 1300], 1500, 200)]


def test_markdown_header_after_header_mark(spark):
    # The section "# deep" starts with a mark again and takes the mark that follows it.
    text = "a" * 400 + "\n# # deep\n## " + "b" * 400
    got = [c for _, c in run(spark, text, "md")]
    assert got == [c for _, c in plain(text, ["a" * 400, "#", "# deep\n##", "b" * 400], 1500, 200)]


def test_five_hashes_are_no_header(spark):
    assert run(spark, "x\n##### five", "md") == [(0, "x\n##### five")]


def test_python_splits_at_definitions(spark):
    parts = ["import os\n" + "i" * 300 + "\n", "def a():\n    " + "x" * 300 + "\n", "class B:\n    def inner(self): pass\n" + "    " + "y" * 300 + "\n", "async def c(): " + "z" * 300]
    assert [c for _, c in run(spark, "".join(parts), "python")] == parts


def test_brace_languages_split_at_declarations(spark):
    parts = ["package x;\n" + "p" * 200 + "\n", "public class A {\n" + "a" * 200 + "\n", "    private static int f(int x) {\n" + "b" * 200 + "\n", "function g() {\n" + "c" * 200]
    assert [c for _, c in run(spark, "".join(parts), "java")] == parts


def test_code_without_definitions_uses_blank_lines(spark):
    parts = ["x" * 500, "y" * 500]
    assert [c for _, c in run(spark, "\n\n\n".join(parts), "go")] == parts


def test_sql_statements_keep_their_semicolon(spark):
    parts = ["SELECT " + "a" * 200, "INSERT " + "b" * 200, "DELETE " + "c" * 200]
    assert [c for _, c in run(spark, ";\n".join(parts), "sql")] == [p + ";" for p in parts]
    assert [c for _, c in run(spark, "SELECT 1", "sql")] == ["SELECT 1"]


def test_diff_files(spark):
    parts = ["diff --git a/x b/x\n" + "+" * 300 + "\n", "diff --git a/y b/y\n" + "-" * 900]
    text = "".join(parts)
    assert run(spark, text, "git_diff") == plain(text, parts, 800, 100)


@pytest.mark.parametrize("kind, size, overlap", [("python", 800, 100), ("text", 1500, 200)])
def test_windows_of_one_long_piece(spark, kind, size, overlap):
    text = "".join(chr(97 + i % 26) for i in range(5000))
    assert run(spark, text, kind) == plain(text, [text], size, overlap)

import pytest
from pyspark.sql import functions as F

from groundwell.functions import replies, text as t


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("", []),
        ("Hello, World_2!", ["hello", "world_2"]),
        ("로그", ["로그"]),
        ("세글자", ["세글자"]),
        ("검색엔진 API", ["검색엔진", "검색", "색엔", "엔진", "api"]),
        ("mixed한글Text", ["mixed", "한글", "text"]),
        ("café", ["caf"]),
    ],
)
def test_tokens(one, text, tokens):
    assert one(t.tokenize(F.col("x")), x=text) == tokens


@pytest.mark.parametrize("length", [0, 1, 7, 10, 11, 17, 18, 19, 24, 25, 100])
@pytest.mark.parametrize("size, overlap", [(10, 3), (10, 0), (10, 5)])
def test_windows_equal_plain_slicing(one, length, size, overlap):
    text = "".join(chr(0x61 + i % 26) if i % 5 else "é😀"[i % 2] for i in range(length))
    want, start = [], 0
    while start < len(text):
        want.append((start, text[start : start + size]))
        if start + size >= len(text):
            break
        start += size - overlap
    got = one(t.windows(F.col("x"), size, overlap), x=text)
    assert [(w["at"], w["body"]) for w in got] == want


def test_strip_and_squeeze_know_unicode_space(one):
    text = "　 \x1c a b \t\n c \x85"
    assert one(t.strip(F.col("x")), x=text) == text.strip()
    assert one(t.squeeze(F.col("x")), x=text) == " ".join(text.split())
    assert one(t.squeeze(F.lit(None).cast("string"))) == ""
    assert one(t.is_blank(F.col("x")), x="  \n") is True


def test_cut(one):
    assert one(t.cut(F.col("x"), 3), x="abcd") == "abc" + t.CUT_MARK
    assert one(t.cut(F.col("x"), 3), x="abc") == "abc"
    assert one(t.cut(F.col("x"), 0), x="abcd") == "abcd"


@pytest.mark.parametrize(
    "text, clean, hits",
    [
        ("see http://a.b/c?d=1 now", "see [URL] now", 1),
        ("(HTTPS://x.y/z) and a.b@c.co.kr", "([URL]) and [EMAIL]", 2),
        ("http://10.0.0.1/x and 10.0.0.1", "[URL] and [IP]", 2),
        ("900101-1234567", "[RRN]", 1),
        ("9001011234567", "[RRN]", 1),
        ("901301-1234567", "901301-1234567", 0),
        ("call 010-1234-5678 or 02 123 4567", "call [PHONE] or [PHONE]", 2),
        ("+82-10-1234-5678", "[PHONE]", 1),
        ("1010-1234-5678", "1010-1234-5678", 0),
        ("1.2.3.4.5 and 256.1.1.1", "1.2.3.4.5 and 256.1.1.1", 0),
        ("host 192.168.0.255.", "host [IP].", 1),
        ("literal [EMAIL] stays", "literal [EMAIL] stays", 0),
        ("plain", "plain", 0),
    ],
)
def test_scrub(spark, text, clean, hits):
    df = spark.createDataFrame([(text, text)], "a string, b string")
    row = t.scrub(df, ["a", "b"], "n").first()
    assert (row["a"], row["b"], row["n"]) == (clean, clean, 2 * hits)


def test_scrub_counts_a_match_that_swallows_a_token(spark):
    row = t.scrub(spark.createDataFrame([("http://x[EMAIL",)], "a string"), ["a"], "n").first()
    assert (row["a"], row["n"]) == ("[URL]", 1)


def test_safe_names(one):
    for name, ok in [("a", True), ("..", False), (".a", False), ("a" * 64, True), ("a" * 65, False), ("a/b", False), ("a\n", False)]:
        assert one(t.safe_name(F.col("x")), x=name) is ok


def test_replacement_ratio(one):
    assert one(t.replacement_ratio(F.col("x")), x="ab��") == 0.5
    assert one(t.replacement_ratio(F.col("x")), x="") == 0.0


@pytest.mark.parametrize(
    "reply, want",
    [("YES", "yes"), (" 'yes.' ", "yes"), ("No!", "no"), ("NO 。", "no"), ("yes, it is", "invalid"), ("", "invalid"), ('"YES"', "yes")],
)
def test_verdict(one, reply, want):
    assert one(replies.verdict(F.col("x")), x=reply) == want


@pytest.mark.parametrize(
    "reply, ok",
    [('{"a": 1}', True), ('```json\n{"a": 1}\n```', True), ('```\n{"a": 1}', True), ("```", False), ("{a", False), ("not json", False)],
)
def test_json_reply(one, reply, ok):
    assert one(replies.parse_json(F.col("x")).isNotNull(), x=reply) is ok


@pytest.mark.parametrize(
    "question, rewritten, flag",
    [
        ("what is it", "what is it", False),
        ("what is it", " what is it ", False),
        ("x", "a" * 40, False),
        ("x", "a" * 41, True),
        ("q" * 30, "a" * 81, True),
        ("q", "two\nlines", True),
        ("q", "설명합니다.", True),
        ("q", "됩니다", True),
        ("q", '"quoted"', True),
        ("q", 'half "quoted"', False),
        ("q", "출력: 질문", True),
        ("q", "", False),
    ],
)
def test_answer_like(one, question, rewritten, flag):
    assert one(replies.answer_like(F.col("q"), F.col("r")), q=question, r=rewritten) is flag
    used = one(replies.accepted_rewrite(F.col("q"), F.col("r")), q=question, r=rewritten)
    assert used == (question if flag or not rewritten.strip() else rewritten.strip())


def test_keyword_hits(one):
    rate = replies.keyword_hit_rate(F.col("r"), F.col("k"))
    assert one(rate, r="Find the API docs", k=["api", "DOCS", "none"]) == pytest.approx(2 / 3)
    assert one(rate, r="x", k=[]) == 1.0


def test_responses_of_three_vendors(spark):
    rows = [
        ("claude-a", '{"content":[{"text":"hi"}],"usage":{"input_tokens":3,"output_tokens":4,"cache_read_input_tokens":2},"stop_reason":"end_turn"}'),
        ("gpt-a", '{"choices":[{"message":{"content":"yo"},"finish_reason":"stop"}],"usage":{"prompt_tokens":5,"completion_tokens":6}}'),
        ("o1", '{"choices":[{"message":{"content":"o"}}],"usage":{"prompt_tokens":1,"completion_tokens":1}}'),
        ("gemini-a", '{"candidates":[{"finishReason":"MAX"}],"usageMetadata":{"promptTokenCount":7,"candidatesTokenCount":1,"thoughtsTokenCount":9}}'),
        ("llama", "{}"),
    ]
    df = spark.createDataFrame(rows, "model string, body string").withColumn("v", replies.provider(F.col("model")))
    got = {r["model"]: (r["v"], tuple(r["n"])) for r in df.withColumn("n", replies.normalized(F.col("v"), F.col("body"))).collect()}
    assert got["claude-a"] == ("anthropic", ("hi", 3, 4, 0, "end_turn", 2, 0))
    assert got["gpt-a"] == ("openai", ("yo", 5, 6, 0, "stop", 0, 0))
    assert got["o1"][0] == "openai" and got["o1"][1][4] is None
    assert got["gemini-a"] == ("gemini", ("", 7, 10, 9, "MAX", 0, 0))
    assert got["llama"][0] is None

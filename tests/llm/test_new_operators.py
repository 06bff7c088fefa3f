"""Tokenizer alignment, main text and fill-in-middle against brute force, and over odd rows."""

import hashlib
import random
import re
from collections import Counter
from html import unescape

import brute
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from groundwell.llm import alignment as al
from groundwell.llm import fill_in_middle as fim
from groundwell.llm import main_text as mt
from groundwell.llm import pieces, queries


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 11


@pytest.fixture(scope="module")
def both():
    """The libraries' own whole encodings as [(id, bytes)]."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(pieces.default_path())
    one.encode_special_tokens = True
    two = SentencePieceProcessor(model_file=pieces.default_path("piece_bpe_32k.model"))
    char = al._byte_of_char()
    name = {i: bytes(char[c] for c in t) for t, i in one.get_vocab().items() if t != "<|endoftext|>"}

    def second(text):
        found = ((i, two.id_to_piece(i)) for i in two.encode(text))
        return [(i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()) for i, p in found]

    return lambda text: [(i, name[i]) for i in one.encode(" " + text, add_special_tokens=False).ids], second


def groups_of(r):
    a, b, out = r["a"], r["b"], []
    for n, m in zip(r["a_sizes"], r["b_sizes"], strict=True):
        out.append((a[:n], b[:m]))
        a, b = a[n:], b[m:]
    assert not a and not b
    return out


MARKS = [
    " ", "  ", "   ", "\n", " \n ", "\t", " ", "　", "'s", "don't", "é", "漢字", "12", "<|endoftext|>", "<s>", "<0x41>", "$%",
    "\x1c", "\x85", "🙂", "\r\n", "a", "B.", "\x00", ",", "wordless", "international", "ﬁ", "é́", "x_y", "`", "(", "ü",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    made = ["".join(rng.choices(MARKS, k=rng.randrange(1, 60))) for _ in range(300)]
    return ["", None, " ", "a", " a ", "▁", "has ▁ inside", "a▁b", "w" * 3000, *made, " ".join(rng.choices(made, k=40))]


@pytest.mark.parametrize("chunk", [1 << 20, 40, 7])
def test_alignment_of_odd_texts(spark, texts, both, chunk):
    """Whole, and cut into chunks that are composed level by level."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in al.align(df, chunk=chunk, fan=3).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        assert groups_of(got[k]) == brute.align(text, *both)[0], (k, text)
    assert not got[5]["a"] and not got[6]["a"] and got[8]["a"]


def test_fragments_compose_in_any_tree():
    rng = np.random.default_rng(3)
    key = lambda f: [f.known, *(getattr(f, x).tolist() for x in al._ARRAYS)]
    for _ in range(200):
        ends = [np.unique(np.append(rng.integers(1, 40, rng.integers(0, 25)), 40)) for _ in range(2)]
        ids = [rng.integers(0, 99, len(x)) for x in ends]
        whole = al.fragment(ids[0], ends[0], ids[1], ends[1])
        # A chunk's tokens of each kind begin at the first border behind a nominal place.
        nominal = np.sort(rng.integers(0, 41, 5))
        cuts = [[0, *np.searchsorted(np.concatenate([[0], x]), nominal), len(x)] for x in ends]
        parts = [
            al.fragment(ids[0][a:a_to], ends[0][a:a_to], ids[1][b:b_to], ends[1][b:b_to])
            for a, a_to, b, b_to in zip(cuts[0][:-1], cuts[0][1:], cuts[1][:-1], cuts[1][1:])
        ]
        one, two = parts[0], parts[-1]
        for p in parts[1:]:
            one = one + p
        for p in reversed(parts[:-1]):
            two = p + two
        mid = (parts[0] + parts[1]) + (((parts[2] + al.Fragment()) + parts[3]) + (parts[4] + parts[5]))
        assert key(one) == key(two) == key(mid) == key(whole) == key(al.Fragment() + whole)


def test_long_documents_in_chunks_are_the_same(spark, docs):
    whole = al.align(docs, chunk=1 << 30)
    cut = al.align(docs, chunk=1000, fan=4)
    assert whole.exceptAll(cut).count() == 0 and cut.exceptAll(whole).count() == 0


def want_scores(listed, both):
    found = [(i, *brute.align(t, *both)) for i, t in listed]
    count = Counter(x for _, _, links in found for x in links)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for i, groups, links in found:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        n_a, n_b = (sum(len(g[k]) for g in groups) for k in (0, 1))
        best = sum(count[x] == top[x[1]] for x in links)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((i, n_a, n_b, len(groups), len(links), best, sum(count[x] for x in links), digest))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("options", [{}, {"block_links": 50}, {"chunk": 30, "fan": 2}])
def test_link_scores(spark, texts, both, options):
    rng = random.Random(9)
    words = [" ".join(rng.choices(["the", "of", "internationally", "unthinkable", "é", "x1"], k=30)) for _ in range(50)]
    listed = [*enumerate([t and t[:200] for t in texts] + words), (None, "the end"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(listed, "doc_id long, text string")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in al.link_scores(df, **options).collect()), key=repr)
    assert got == want_scores(listed, both)


def test_alignment_query(spark, docs, both):
    short = [(i, t) for i, t in pairs(docs) if len(t or "") < 1500]
    got = queries.op11_tokenizer_alignment(spark, SF)
    assert tuple(got.columns) == COLUMNS
    found = {r["doc_id"]: r for r in got.collect()}
    assert len(found) == docs.count()
    for i, t in short:
        groups, links = brute.align(t, *both)
        assert (found[i]["n_groups"], found[i]["n_links"]) == (len(groups), len(links))
    # Every link is in the pair table once: the sum of all counts is the sum of their squares.
    assert all(r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] and 0 <= r["n_best"] <= r["n_links"] for r in found.values())


def test_alignment_query_scores(docs, both):
    few = docs.where(F.length("text") < 400)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in al.link_scores(few).collect()), key=repr)
    assert len(got) > 10 and got == want_scores(pairs(few), both)


def test_alignment_of_odd_rows(odd, nothing):
    got = al.link_scores(odd).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd.collect())
    none = [r for r in got if r["doc_id"] in (2, 3)]
    assert {tuple(r)[1:] for r in none} == {(0, 0, 0, 0, "", 0, 0)}
    assert len({tuple(r) for r in got if r["doc_id"] == 1}) == 1
    assert al.link_scores(nothing).collect() == []


# 12


def article(html):
    """The blocks of the test pages' articles, by their fixed layout."""
    inside = re.search(r"<article>(.*)</article>", html, re.S)[1]
    found = (" ".join(unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", inside))
    return "\n\n".join(x for x in found if x)


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.1")])
def test_main_text_of_all_pages(spark, sf):
    html = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op12_main_text(spark, sf).collect()
    assert len(got) == len(html)
    for r in got:
        assert r["text"] == article(html[r["page_id"]]["html"])
        assert (r["url"], r["n_chars"]) == (html[r["page_id"]]["url"], len(r["text"]))


@pytest.fixture(scope="module")
def model(spark):
    return mt.train(spark.read.parquet(f"{SF}/pages.parquet"))


PROSE = "The river rose for three days before anyone in the village noticed that the bridge had moved"
PAGES = {
    "plain article": (f"<html><body><article><h1>Title</h1><p>{PROSE}.</p><p>Short.</p></article></body></html>", ["Title", PROSE + ".", "Short."]),
    "entities": ("<article><p>a &amp; b &lt;c&gt; &#233; &#x20ac; &nbsp; caf&eacute; &copy &unknown; x</p></article>", ["a & b <c> é € café © &unknown; x"]),
    "white space": ("<main><p>  one\n two<br>three\t<b>bold</b>ly </p></main>", ["one two three boldly"]),
    "advert inside": (f"<article><p>{PROSE}.</p><div class='ad-banner'><p>Buy now! {PROSE}.</p></div><p>{PROSE} again.</p></article>", [PROSE + ".", PROSE + " again."]),
    "notices and forms": (
        f"<div class='cookie-notice'>We use cookies. {PROSE}.</div><main><p>{PROSE}.</p></main><form><label>Mail</label><input><button>Go</button></form>",
        [PROSE + "."],
    ),
    "comments": (
        f"<main><article><p>{PROSE}.</p></article><section id=comments><article class='comment'><p>{PROSE}, I think.</p></article></section></main>",
        [PROSE + "."],
    ),
    "sidebar": (f"<div class='has-sidebar'><main><p>{PROSE}.</p></main><aside><p>{PROSE} too.</p></aside></div>", [PROSE + "."]),
    "head of an article": (f"<header><p>Site</p></header><article><header><h1>Title of it all</h1></header><p>{PROSE}.</p></article>", ["Title of it all", PROSE + "."]),
    "scripts": (f"<article><script>var a = '</p><p>x';</script><p>{PROSE}.</p><style>p > b {{}}</style><noscript><p>Turn it on</p></noscript></article>", [PROSE + "."]),
    "comment of markup": (f"<article><!-- <p>old</p> --><p>{PROSE}.</p><!-- open <p>never</p>", [PROSE + "."]),
    "less than": ("<article><p>if a < b and b > c then 1 <2</p></article>", ["if a < b and b > c then 1 <2"]),
    "open quote": (f"<article><p title=\"never>{PROSE}.</p><p>{PROSE}, more.</p></article>", [PROSE + ".", PROSE + ", more."]),
    "unclosed": (f"<article><p>{PROSE}<p>{PROSE}.<ul><li>first thing<li>second thing</ul>", [PROSE, PROSE + ".", "first thing", "second thing"]),
    "hidden": (f"<article><p>{PROSE}.</p><p style='display: none'>{PROSE}!</p><div hidden>{PROSE}?</div></article>", [PROSE + "."]),
    "upper case": (f"<NAV><A HREF='/x'>Home</A></NAV><ARTICLE><P>{PROSE}.</P></ARTICLE>", [PROSE + "."]),
    "without elements that say so": (
        "<div><a href=/a>Home</a> <a href=/b>News</a></div><div>" + "".join(f"<p>{PROSE}, {k} times. {PROSE}. {PROSE}.</p>" for k in range(5)) + "</div>",
        [f"{PROSE}, {k} times. {PROSE}. {PROSE}." for k in range(5)],
    ),
    "empty": ("", []), "no tags": ("<", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text_of_made_pages(model, name):
    html, want = PAGES[name]
    got = mt.main_text(html, model)
    assert got == "\n\n".join(want) or (name == "no tags" and got in ("", "<"))


def test_minimum_cut():
    """Against all labellings."""
    rng = random.Random(8)
    cut_by_flow = 0
    for _ in range(400):
        n = rng.randrange(1, 10)
        cost = [rng.randrange(-9, 10) for _ in range(n)]
        edges = [(a, b, rng.randrange(1, 8)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        side = mt.minimum_cut(cost, edges)
        total = sum(c for c, x in zip(cost, side) if c > 0 and not x) - sum(c for c, x in zip(cost, side) if c < 0 and x)
        total += sum(c for a, b, c in edges if side[a] != side[b])
        assert total == brute.cheapest_labels(cost, edges)
        cut_by_flow += any(abs(c) <= sum(e for a, b, e in edges if k in (a, b)) for k, c in enumerate(cost))
    assert cut_by_flow > 200


def test_very_long_page(model):
    html = "<nav><a href=/>x</a></nav><article>" + f"<p>{PROSE}.</p><div class=ad>Buy</div>" * 20_000 + "<svg>" * 2000 + "<b title=\"" * 3000
    assert mt.main_text(html, model).count(PROSE) == 20_000


def test_main_text_of_odd_rows(spark):
    rows = [(None, None, None, "x"), (1, "u", "", "x"), (2, "u", PAGES["plain article"][0], "x"), (2, "u", PAGES["plain article"][0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["text"]) for r in mt.extract(df).collect()), key=repr)
    want = "\n\n".join(PAGES["plain article"][1])
    assert got == sorted([(None, ""), (1, ""), (2, want), (2, want)], key=repr)
    assert mt.extract(df.limit(0)).collect() == []


# 13


def middle(i, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, h = len(units), hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (i, n, "plain", None, None, text)
    if h4 % 100 < 80:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark, texts, docs, odd, nothing):
    rng = random.Random(2)
    marked = ["a <P> b", "<S>", "x<M", "<", "<P", *("".join(rng.choices(["<", "<P", "<S", "M>", " ", "a", "P>"], k=20)) for _ in range(60))]
    listed = [*enumerate([*texts, *marked]), (None, "no id at all"), (4, "again and again"), (4, "again and again")]
    made = spark.createDataFrame(listed, "doc_id long, text string")
    for df in (made, docs, odd):
        got = fim.fill_in_middle(df).withColumn("back", fim.restored(F.col("output"), F.col("form")))
        rows = sorted((tuple(r) for r in got.collect()), key=repr)
        assert rows == sorted(((*middle(i, t), t or "") for i, t in pairs(df)), key=repr)
        assert {r[2] for r in rows} == {"plain", "spm", "psm"} or df is odd
    assert fim.fill_in_middle(nothing).collect() == []


def test_markers_must_not_overlap(docs):
    for markers in (("<P>", "<P>", "<M>"), ("ab", "bc", "d"), ("", "a", "b"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, markers=markers)


def test_blocks_do_not_change_results(docs, monkeypatch):
    want = fim.fill_in_middle(docs).collect()
    one = fim.fill_in_middle(docs.repartition(5)).collect()
    assert sorted(map(tuple, want), key=repr) == sorted(map(tuple, one), key=repr)

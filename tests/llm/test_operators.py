"""The training-data operators against brute force, and over odd rows."""

import hashlib
import math
import random
import zlib
from types import SimpleNamespace

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from groundwell.llm import decontaminate as dc
from groundwell.llm import license_scan, line_dedup, mixing, near_copies, pieces, queries, quality_rules, simhash, substring_dedup
from groundwell.llm import token_counts, token_store, url_filter, words
from groundwell.llm.tables import stored


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def shared(value):
    """Stands in for a broadcast."""
    return SimpleNamespace(value=value)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# Shared parts


def test_words_of_blocks():
    texts = ["", "a", None, " two  words\n", "x\x0by\u00a0z", "tail "]
    data, at = words.buffers(pa.array(texts))
    starts, ends, first = words.bounds(data, at)
    raw = data.tobytes()
    found = [[raw[s:e].decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first[:-1], first[1:])]
    assert found == [brute.WORD.findall(t or "") for t in texts]
    assert len(set(words.hashes(data, starts, ends).tolist())) == len({w for f in found for w in f})


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    data, at = words.buffers(pa.array([" ".join(f"w{k % 11}" for k in range(500))]))
    starts, ends, _ = words.bounds(data, at)
    whole = words.hashes(data, starts, ends)
    monkeypatch.setattr(words, "BLOCK_BYTES", 64)
    assert (words.hashes(data, starts, ends) == whole).all()


# 1


def test_line_dedup(docs):
    found = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(docs, 3).collect()}
    spread = brute.spread([(r["text"], r["source"]) for r in docs.collect()])
    assert max(spread.values()) >= 3
    for r in docs.collect():
        lines = r["text"].split("\n")
        kept = [x for x in lines if spread[x.strip(" \t\r")] < 3]
        got = found[r["doc_id"]]
        assert (got["text"], got["n_lines"], got["n_removed"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))


def test_line_spread_beyond_exact_counts(spark):
    rows = [("common\nseldom" if k % 10 == 0 else "common", f"s{k}") for k in range(3000)]
    table = spark.createDataFrame(rows, "text string, site string")
    assert line_dedup.boilerplate(table, 1000).count() == 1
    assert line_dedup.boilerplate(table, 300).count() == 2
    assert line_dedup.boilerplate(table, 301).count() == 1


# 2


def check_substrings(df, window=20):
    got = rows(substring_dedup.drop_repeats(df, window), "doc_id", "n_words", "n_removed", "text")
    want = sorted(brute.substring_dedup(pairs(df), window), key=repr)
    assert got == want
    return want


def test_substring_dedup(docs):
    assert sum(r[2] for r in check_substrings(docs)) > 0


def test_substring_dedup_of_overlaps(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(4)}" for _ in range(400)]
    rows_ = [(k, " ".join(base[a : a + rng.randrange(5, 90)])) for k, a in enumerate(rng.randrange(330) for _ in range(80))]
    rows_ += [(200, "a " * 100), (201, "a " * 30), (202, "b c " * 40), (200, "a " * 100)]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    for window in (4, 10, 20):
        check_substrings(df, window)


# 3


def test_mixing(docs):
    got = rows(queries.mix_sources(docs), "doc_id", "size", "source_size", "target", "taken")
    hash_of = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
    listed = [(r["doc_id"], r["source"], len(brute.WORD.findall(r["text"]))) for r in docs.collect()]
    assert got == sorted(brute.mix(listed, hash_of), key=repr)


def test_mixing_refines_the_boundary(spark, monkeypatch):
    """With one bit a level, every source needs many nested histograms."""
    monkeypatch.setattr(mixing, "LEVEL_BITS", 4)
    table = spark.range(600).select(
        F.col("id").alias("doc_id"), F.expr("case when id % 3 = 0 then 'b' when id % 3 = 1 then 'a' end").alias("source"),
        F.expr("repeat('w ', cast(id % 7 as int))").alias("text"),
    )
    got = rows(mixing.mix_sources(table), "doc_id", "size", "source_size", "target", "taken")
    hash_of = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
    listed = [(k, [("b"), ("a"), None][k % 3], k % 7) for k in range(600)]
    assert got == sorted(brute.mix(listed, hash_of), key=repr)
    out = mixing.repeat_documents(table)
    assert out.columns == table.columns
    assert out.select(F.sum(mixing.count_words(F.col("text")))).first()[0] == sum(r[4] for r in got)


# 4


def test_segmentation_is_the_best_split():
    count = {"cheap": 40, "pills": 30, "the": 500, "he": 90, "cheapp": 1, "ills": 3, "rat": 7, "therat": 2}
    for run in ("cheappills", "therat", "xqzthe", "hehehe", "cheaptherapills"):
        assert tuple(url_filter.split_words(run, count, 673.0)) == brute.best_split(run, count, 673.0)[1]


def test_url_parts_and_rules(spark):
    cases = [
        ("https://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/"),
        ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/"),
        ("http://example.com", "example.com", "", None),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/"),
        ("x://h.net/es/a", "h.net", "/es/a", "net/es/"),
        ("x://h.net?u=/es/", "h.net", "", None),
        ("http://a.de/x://b.com/en/", "a.de", "/x://b.com/en/", None),
        ("example.com/en/", "", "", None),
        (None, "", "", None),
        ("", "", "", None),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "page_id long, url string")
    empty = spark.createDataFrame([], "text string")
    got = {r["page_id"]: r for r in url_filter.url_verdicts(df, empty).collect()}
    for k, (_, host, path, rule) in enumerate(cases):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        kinds = {text: kind for kind, text in url_filter.RULES}
        assert got[k]["verdict"] == kinds.get(rule, "allow")


def test_runs_of_any_length_are_split(spark):
    """Also beyond the 63 letters of a host label, as paths may be run together."""
    rng = random.Random(5)
    words_ = ["river", "garden", "news", "of", "the", "school", "an"]
    runs = ["".join(rng.choices(words_, k=n)) for n in (1, 3, 20, 60, 400)] + ["zqx", "x" * 200]
    corpus = spark.createDataFrame([(" ".join(words_) + " news news the",)] * 10, "text string")
    got = {r["run"]: r["words"] for r in url_filter.segment(spark.createDataFrame([(r,) for r in runs], "run string"), corpus, ()).collect()}
    count = {x: 10 * (1 + 2 * (x == "news") + (x == "the")) for x in words_}
    assert len(runs[4]) > 1500 and set(got) == set(runs)
    for r in runs:
        assert got[r] == url_filter.split_words(r, count, float(sum(count.values())))
    assert set(got[runs[4]]) <= set(words_)


def test_url_scores_by_hand(spark):
    """The log odds of a small training set, and a host of its words run together."""
    train = [("http://cheap-pills.org/a", 1), ("http://free-pills.org/a", 1), ("http://the-news.org/a", 0), ("http://news.org/b", 0)]
    labelled = spark.createDataFrame(train, "url string, unwanted int")
    asked = spark.createDataFrame([(1, "http://cheappills.org/"), (2, "http://thenews.org/")], "page_id long, url string")
    corpus = spark.createDataFrame([("cheap pills free the news the news",)], "text string")
    got = {r["page_id"]: r for r in url_filter.url_verdicts(asked, corpus, labelled=labelled).collect()}
    assert [got[k]["verdict"] for k in (1, 2)] == ["block", "allow"]
    bad, good, kinds = {"cheap": 1, "pills": 2, "free": 1, "org": 2, "a": 2}, {"the": 1, "news": 2, "org": 2, "a": 1, "b": 1}, 8
    odds = lambda w: math.log((bad.get(w, 0) + 1) / (8 + kinds)) - math.log((good.get(w, 0) + 1) / (7 + kinds))
    assert got[1]["score"] == pytest.approx(sum(map(odds, ("cheap", "pills", "org"))))


def test_url_held_out(spark):
    """Hosts made of words that unwanted and wanted hosts share with the training set."""
    rng = random.Random(3)
    kinds = {1: ["cheap", "pills", "bets", "win", "casino"], 0: ["news", "garden", "school", "book", "river"]}
    host = lambda k: "".join(rng.sample(kinds[k], 2)) + ".org"
    labelled = spark.createDataFrame([(f"http://{host(k % 2)}/x", k % 2) for k in range(60)], "url string, unwanted int")
    asked = spark.createDataFrame([(k, f"http://{host(k % 2)}/y") for k in range(200)], "page_id long, url string")
    corpus = spark.createDataFrame([(" ".join(kinds[0] + kinds[1]) * 1,)] * 20, "text string")
    got = url_filter.url_verdicts(asked, corpus, labelled=labelled).collect()
    assert sum((r["verdict"] == "block") == (r["page_id"] % 2 == 1) for r in got) >= 190


# 5 and 7


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pieces.default_path())
    t.encode_special_tokens = True
    return t


def test_pieces_make_the_same_ids(tokenizer, monkeypatch):
    rng = random.Random(1)
    marks = [" ", "  ", "\n", " \n ", "\t", "\u00a0", " \u00a0", "\u2003 ", "'s", "don't", "é", "漢字", "12", "<|endoftext|>", "$%", "\x1c", "\x85", "🙂", "\r\n", "a", "B.", "\x00", ",", "it's.", "x_y", "`", "é,", "(", "'"]
    texts = ["", " ", None] + ["".join(rng.choices(marks, k=rng.randrange(1, 40))) for _ in range(800)]
    for limit in (1_000_000, 50):
        monkeypatch.setattr(pieces, "CACHED", limit)
        encoder = pieces.Encoder(pieces.default_path())
        for k in range(0, len(texts), 100):
            some = texts[k : k + 100]
            ids, first = encoder.encode(*words.buffers(pa.array(some)))
            for text, a, b in zip(some, first[:-1], first[1:]):
                assert ids[a:b].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_added_tokens_as_in_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(pieces.default_path())
    rng = random.Random(6)
    marks = ["<|endoftext|>"] * 6 + [" ", "  ", "\n", "a", "page", " next", "'s", "é", "<|", "|>", "<|endoftext|", "endoftext|>", "<", "12", "\u00a0"]
    texts = ["end of page<|endoftext|>next page", "<|endof", "text|>", "", None, "a <|endoftext|>"]
    texts += ["".join(rng.choices(marks, k=rng.randrange(1, 30))) for _ in range(400)]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for limit in (1_000_000, 50):
        monkeypatch.setattr(pieces, "CACHED", limit)
        ids, first = pieces.Encoder(pieces.default_path(), added=True).encode(*words.buffers(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_store.token_digests(df).collect()}
    counted = token_counts.section_tokens(token_counts.with_fields(df, ["text"])).collect()
    for r in counted:
        assert r["n_tokens"] == len(plain.encode(f"{texts[r['doc_id']] or ''}\n", add_special_tokens=False).ids)
    for k, ids in enumerate(want):
        whole = np.array([*ids, 0], "<u4")
        assert (got[k]["n_tokens"], got[k]["ids_crc32"]) == (len(whole), zlib.crc32(whole.tobytes()))


def test_tokens_of_fields(docs, tokenizer):
    got = {}
    df = token_counts.with_fields(docs, ["source", "lang", "text"])
    for r in token_counts.section_tokens(df).collect():
        got.setdefault(r["doc_id"], {})[r["name"]] = r["n_tokens"]
    for r in docs.limit(60).collect():
        whole = f"{r['source']}\n{r['lang']}\n{r['text']}\n"
        ends = np.cumsum([len(r["source"]) + 1, len(r["lang"]) + 1, len(r["text"]) + 1])
        want = [0, 0, 0]
        for a, _ in tokenizer.encode(whole, add_special_tokens=False).offsets:
            want[int(np.searchsorted(ends, a, "right"))] += 1
        assert [got[r["doc_id"]].get(n, 0) for n in ("source", "lang", "text")] == want


def test_rules_for_crossing_tokens():
    begin, end = np.array([0, 2, 5, 9, 12]), np.array([2, 5, 9, 12, 14])
    low, high = np.array([0, 4, 10]), np.array([4, 8, 12])
    assert token_counts.allocate("first", begin, end, low, high)[0].tolist() == [0, 0, 1, -1, -1]
    assert token_counts.allocate("last", begin, end, low, high)[0].tolist() == [0, 1, -1, 2, -1]
    which, crossing = token_counts.allocate("most", begin, end, low, high)
    assert which.tolist() == [0, 0, 1, 2, -1]
    assert crossing.tolist()[:4] == [False, True, True, True]


def test_store_codes_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = token_store.pack(ranks)
        assert len(control) == -(-n // 4)
        assert token_store.unpack(control, data, n).tolist() == ranks.tolist()


def test_token_store(docs, tokenizer):
    got = sorted(tuple(r) for r in queries.token_digests(docs.repartition(7)).collect())
    start = 0
    for (doc_id, at, n, crc), r in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        assert (doc_id, at, n, crc) == (r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += n


# 6


def test_wrapped_notices_are_found(spark):
    """The usual heads of two licenses, wrapped as they are in source files, indented and not."""
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy\n"
        "of this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"
    )
    bsd = (
        "Copyright (c) 2020\n\nRedistribution and use in source and binary forms, with or without\n"
        "modification, are permitted provided that the following conditions\nare met:"
    )
    apart = "Permission is hereby granted, free of charge.\n\nTo any person obtaining a copy of this software"
    texts = {1: mit, 2: bsd, 3: mit.replace("\n", "\r\n   "), 4: apart}
    got = {r["doc_id"]: r["labels"] for r in license_scan.license_scan(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    assert got == {1: "mit", 2: "bsd", 3: "mit", 4: ""}


def test_license_matches_without_filters(docs, spark):
    scan = license_scan.Scan(templates=(("t", "one two three four five six"), ("u", "two three nine ten"), ("v", "seven")), threshold=0.6)
    rng = random.Random(4)
    listed = ["one", "two", "three", "four", "five", "six", "nine", "ten", "seven", "and", "Two", "x"]
    texts = [". ".join(" ".join(rng.choices(listed, k=rng.randrange(1, 9))) for _ in range(3)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in license_scan.license_scan(df, scan).collect()}
    for k, text in enumerate(texts):
        labels, best = set(), 0.0
        for block in text.lower().split(". "):
            for label, t in scan.templates:
                t, b = set(t.split()), set(block.split())
                if len(t & b) >= license_scan.needed(len(t), 0.6):
                    labels.add(label)
                    best = max(best, len(t & b) / len(t))
        assert got[k] == (",".join(sorted(labels)), round(best, 9))


def test_phrases_that_overlap_themselves(spark):
    scan = license_scan.Scan(phrases={"a a": "aa"})
    df = spark.createDataFrame([(1, "A a-a b"), (2, "İ a\ta")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.license_scan(df, scan).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["n_words"]) == (2, 0, 1, 4)
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["base_labels"]) == (1, 1, "aa")


# 8


def test_decontamination(docs, spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in dc.contaminated(docs, bench).collect()}
    texts = {r["doc_id"]: brute.item_words(r["text"]) for r in docs.collect()}
    want = {}
    for b in bench.collect():
        item = brute.item_words(b["text"])
        for i, text in texts.items():
            # No stretch can be near that shares too few words.
            if len(set(item) & set(text)) >= 0.5 * len(set(item)):
                cost = brute.stretch_distance(item, text)
                if cost <= dc.allowed(len(item), 0.2):
                    want[i, b["item_id"]] = cost
    assert want and got == want


def test_decontamination_recall_of_edited_passages():
    """Items with up to a fifth of their words changed, dropped or added, inside other words."""
    rng = random.Random(9)
    search, vocabulary = dc.Search(), [f"v{k}" for k in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(10, 70))] for _ in range(60)]
    hashed = lambda ws: dc.word_hashes(*words.buffers(pa.array([" ".join(ws)])))[0]
    groups = dc.groups_of([(k, hashed(x)) for k, x in enumerate(items)], search)
    run, found, asked = dc._matches(shared(dc._tables(groups)), search), 0, 0
    for number, item in enumerate(items):
        for _ in range(4):
            edited = list(item)
            for _ in range(rng.randrange(0, dc.allowed(len(item), search.edits) + 1)):
                at = rng.randrange(len(edited))
                edited[at : at + rng.choice((0, 1, 1))] = rng.choice(([], ["new"], ["other"]))
            text = " ".join(rng.choices(vocabulary, k=50) + edited + rng.choices(vocabulary, k=50))
            batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "text": pa.array([text])})
            hits = [r for out in run([batch]) for r in out.to_pylist()]
            best = brute.stretch_distance(item, brute.item_words(text))
            assert all(h["edits"] == best for h in hits if h["item_id"] == number)
            asked += 1
            found += any(h["item_id"] == number for h in hits)
    assert found >= 0.95 * asked


@pytest.mark.parametrize("size", [120, 250, 500, 1000])
@pytest.mark.parametrize("spread", [True, False])
def test_decontamination_recall_of_long_items(size, spread):
    """A full fifth of a long item's words changed, all over it or all in its first half."""
    rng = random.Random(size)
    search, vocabulary = dc.Search(), [f"v{k}" for k in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(size + k)] for k in range(10)]
    hashed = lambda ws: dc.word_hashes(*words.buffers(pa.array([" ".join(ws)])))[0]
    run, found = dc._matches(shared(dc._tables(dc.groups_of([(k, hashed(x)) for k, x in enumerate(items)], search))), search), 0
    for number, item in enumerate(items):
        edited = list(item)
        for at in sorted(rng.sample(range(size if spread else size // 2), dc.allowed(size, search.edits)), reverse=True):
            edited[at : at + rng.choice((0, 1, 1))] = rng.choice(([], ["new"], ["other"]))
        text = " ".join(rng.choices(vocabulary, k=50) + edited + rng.choices(vocabulary, k=50))
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "text": pa.array([text])})
        hits = {r["item_id"]: r["edits"] for out in run([batch]) for r in out.to_pylist()}
        assert number not in hits or hits[number] == brute.stretch_distance(item, brute.item_words(text))
        found += number in hits
    assert found >= 10


def test_best_stretch():
    rng = np.random.default_rng(8)
    for _ in range(300):
        item, text = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 15))
        cost, begin = dc.best_stretch(item, text)
        assert cost == brute.stretch_distance(item.tolist(), text.tolist())
        assert min(brute.stretch_distance(item.tolist(), text[begin:end].tolist()) for end in range(begin, len(text) + 1)) == cost


# 9


def test_simhash(docs):
    got = rows(simhash.near_duplicates(docs), "doc_id", "fp", "component_id")
    fps = sorted((i, brute.fingerprint(t)) for i, t in pairs(docs))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = [(i, signed(fp), c) for (i, fp), c in zip(fps, brute.components(fps), strict=True)]
    assert got == sorted(want, key=repr)
    assert len({r[2] for r in got}) < len(got)


@pytest.mark.parametrize("blocks,radius", [(1, 4), (2, 4), (4, 4), (5, 4), (6, 4), (7, 4), (3, 2)])
def test_trees_find_every_link(spark, blocks, radius, monkeypatch):
    rng = random.Random(blocks)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(250):
        fp = rng.choice(fps)
        for _ in range(rng.randrange(1, 6)):
            fp ^= 1 << rng.randrange(64)
        fps.append(fp)
    fps = sorted(set(fps))
    if blocks == 5:
        monkeypatch.setattr(simhash, "SHARD_ROWS", 4)  # shards dealt to cells
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 3)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.links(df, radius, blocks)
    found = {r["v"]: r["root"] for r in simhash.components(edges).collect()}
    got = [found.get(x, x) for x in signed]
    want = brute.components(list(enumerate(fps)), radius)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r["v"]: r["root"] for r in simhash.components(edges).collect()}
    assert len(got) == 303 and len({got[k] for k in range(301)}) == 1 and got[1000] == got[1001] != got[0]


# 10


def test_repeated_words(spark):
    rng = random.Random(2)
    texts = ["", "a b", "a a a", "a a a a", "x y z q x y z"] + [" ".join(rng.choices("abcdefgh", k=rng.randrange(80))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("w", quality_rules.words_of(F.col("text")))
    got = {r["id"]: r["n"] for r in quality_rules.repeated_words(df, "w", "n").collect()}
    for k, text in enumerate(texts):
        ws = text.split()
        seen = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        assert got[k] == len({i + j for i, g in enumerate(seen) if seen.count(g) > 1 for j in range(3)})


def test_distances(spark):
    df = spark.createDataFrame([([1, 0], [0, 5]), ([2, 2], [7, 7]), ([0, 0], [1, 1])], "a array<long>, b array<long>")
    got = [r[0] for r in df.select(quality_rules.distance(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == 0.0 and got[2] is None


def test_quality_keeps_prose_and_drops_junk(docs, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality_rules.quality_rules(docs).join(labels, "doc_id").where("not base_failed and n_words >= 100")
    good = judged.where("quality = 1")
    assert good.where("kept").count() == good.count()


# Odd rows, empty tables


OPERATORS = {
    "line_dedup": line_dedup.drop_boilerplate,
    "substring_dedup": substring_dedup.drop_repeats,
    "mixing": mixing.mix_sources,
    "fields": lambda d: token_counts.section_tokens(token_counts.with_fields(d, ["source", "text"])),
    "license": license_scan.license_scan,
    "store": token_store.token_digests,
    "simhash": simhash.near_duplicates,
    "quality": quality_rules.quality_rules,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    out = OPERATORS[name](odd).collect()
    times = 2 if name == "fields" else 1
    ids = sorted((str(r["doc_id"]) for r in out if not (name == "fields" and r["section"] is None)))
    assert ids == sorted(str(r["doc_id"]) for r in odd.collect() for _ in range(times))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(nothing, name):
    assert OPERATORS[name](nothing).collect() == []


def test_odd_rows_have_the_stated_results(odd):
    check_substrings(odd)
    same = rows(simhash.near_duplicates(odd), "doc_id", "fp", "component_id")
    zero = [r for r in same if r[1] == 0]
    assert {r[0] for r in zero} == {2, 3, 4, None} and {r[2] for r in zero} == {2}
    scanned = {r["doc_id"]: r for r in license_scan.license_scan(odd.where("doc_id is not null")).collect()}
    assert (scanned[7]["n_base"], scanned[7]["first_word"], scanned[7]["last_word"], scanned[7]["labels"]) == (3, 0, 6, "reserved")
    assert (scanned[2]["n_words"], scanned[2]["n_base"], scanned[2]["first_word"]) == (0, 0, None)
    judged = {r["doc_id"]: r for r in quality_rules.quality_rules(odd.where("doc_id is not null")).collect()}
    assert judged[2]["base_failed"] and judged[2]["n_words"] == 0 and judged[9]["n_dup_lines"] == 29
    mixed = mixing.mix_sources(odd).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in mixed)


def test_decontamination_of_odd_rows(odd, nothing, spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "All rights, reserved"), (4, "z5 z6 z7 z8 z9 z10")], "item_id long, text string")
    got = rows(dc.contaminated(odd, bench), "doc_id", "item_id", "first_word", "edits")
    assert got == [(7, 3, 0, 0), (8, 4, 5, 0)]
    assert dc.contaminated(nothing, bench).count() == 0
    assert dc.contaminated(odd, bench.limit(0)).count() == 0
    kept = dc.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2


def test_urls_of_odd_rows(spark, nothing, odd):
    pages = spark.createDataFrame([(1, None, "x"), (1, "http://a.com/", "x"), (None, "", "x")], "page_id long, url string, host string")
    assert url_filter.url_verdicts(pages, odd).count() == 3
    assert url_filter.url_verdicts(pages.limit(0), nothing).count() == 0


# The pipeline


def test_pipeline_stages(spark, docs, odd):
    for source in (docs, odd):
        before = source
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stored(stage(spark, before, SF), name.replace(" ", "-"))
            assert after.columns == source.columns, name
            assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
            before = after
        assert corpus_pipeline.STAGES[-1][1](spark, before, SF).count() == before.count()


def test_pipeline_decisions(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, SF)
    kept = {r["doc_id"] for r in quality_rules.quality_rules(docs).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept
    one = stages["near duplicates"](spark, docs, SF)
    assert sorted(r["doc_id"] for r in one.collect()) == kept_of(pairs(docs))


def test_rules_of_a_table_with_other_ids(docs):
    """The id column may have any name, also beside a column of the usual one."""
    keyed = docs.withColumnRenamed("doc_id", "key").withColumn("doc_id", F.lit("x"))
    columns = ("n_words", "kept")
    want = rows(quality_rules.quality_rules(docs), "doc_id", *columns)
    assert rows(quality_rules.quality_rules(keyed, doc_id="key"), "doc_id", *columns) == want


def test_items_in_several_blocks(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = rows(dc.contaminated(docs, bench), "doc_id", "item_id")
    monkeypatch.setattr(dc, "WORDS_AT_ONCE", 300)
    assert rows(dc.contaminated(docs, bench), "doc_id", "item_id") == want


def test_empty_texts_are_not_repeated_more_often(spark):
    """At the cap: no document comes more often than twice."""
    listed = [(k, "" if k % 2 else "some words", "small") for k in range(40)] + [(100 + k, "word " * 200, "large") for k in range(40)]
    mixed = mixing.repeat_documents(spark.createDataFrame(listed, "doc_id long, text string, source string"))
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def shingle_set(text):
    ws = brute.WORD.findall((text or "").lower())
    return {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()


def kept_of(listed):
    """Ids that stay by comparing every text with all that stay, in the order of the texts' hashes."""
    least = {}
    for i, t in listed:
        least[t or ""] = min(least.get(t or "", i), i)
    sets, kept = {t: shingle_set(t) for t in least}, []
    for t in sorted(least, key=lambda t: hashlib.md5(t.encode()).digest()):
        if all(jaccard(sets[t], sets[other]) < 0.8 for other in kept):
            kept.append(t)
    return sorted(least[t] for t in kept)


def test_near_copies_of_a_fifth(spark):
    """Copies with a few words changed go, whatever their fingerprints; others and less similar ones stay."""
    rng = random.Random(11)
    listed = []
    for k in range(60):
        text = [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(60, 900))]
        listed.append((3 * k, " ".join(text)))
        for n, share in ((1, 0.015), (2, 0.12)):
            edited = list(text)
            for at in rng.sample(range(len(text)), max(1, int(share * len(text)))):
                edited[at] = "other"
            listed.append((3 * k + n, " ".join(edited)))
    listed += [(900, "two words"), (901, "Two  words"), (902, "two"), (903, ""), (904, None), (905, " ")]
    fps = {i: simhash.fingerprint((t or "").encode()) for i, t in listed}
    kept = kept_of(listed)
    far = [k for k in range(60) if len({3 * k, 3 * k + 1} & set(kept)) == 1 and (fps[3 * k] ^ fps[3 * k + 1]).bit_count() > 4]
    assert len(far) > 10
    got = near_copies.keep_one(spark.createDataFrame(listed, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == kept


def test_near_copies_of_kept_texts_only(spark):
    """In a chain of near copies the third is no copy of the first, and stays with it."""
    words_ = [f"v{k}" for k in range(400)]
    chain = [(k, " ".join(words_[12 * k : 12 * k + 150])) for k in range(12)]
    got = near_copies.keep_one(spark.createDataFrame(chain, "doc_id long, text string"))
    kept = kept_of(chain)
    assert sorted(r["doc_id"] for r in got.collect()) == kept and 4 <= len(kept) <= 6


def test_many_variants_of_one_text(spark):
    """1,500 texts with 1 to 5 words changed: many pairs are similar and yet no near copies. What goes is a near copy
    of one that stays, and of those that stay hardly any two are near copies."""
    rng = random.Random(6)
    base, listed = [f"v{k}" for k in range(150)], []
    for k in range(1500):
        text = list(base)
        for n, at in enumerate(rng.sample(range(150), rng.randrange(1, 6))):
            text[at] = f"x{k}-{n}"
        listed.append((k, " ".join(text)))
    got = {r["doc_id"] for r in near_copies.keep_one(spark.createDataFrame(listed, "doc_id long, text string")).collect()}
    sets = {i: shingle_set(t) for i, t in listed}
    near = {(i, j) for i in got for j in sets if i != j and jaccard(sets[i], sets[j]) >= 0.8}
    assert {j for _, j in near} >= set(sets) - got
    all_near = sum(jaccard(sets[i], sets[j]) >= 0.8 for i in sets for j in range(i))
    assert all_near > 20_000 and sum(j in got and i < j for i, j in near) < 0.05 * len(got)


def test_texts_that_share_an_id(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(100)) for c in "ab")
    df = spark.createDataFrame([(2, a), (2, b), (1, a + " tail"), (2, b), (3, b)], "doc_id long, text string")
    assert rows(near_copies.keep_one(df), "doc_id", "text") == [(1, a + " tail"), (2, b)]


def test_fingerprints_of_shingles_are_linked_by_trees(spark):
    """The stage of the pipeline takes SimHash links: copies whose shingles differ little are pairs of the trees already."""
    rng = random.Random(4)
    texts = [[f"v{rng.randrange(5000)}" for _ in range(600)] for _ in range(20)]
    listed = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(100 + k, " ".join([*t[:-1], "other"])) for k, t in enumerate(texts)]
    found, upto = near_copies.shingles(pa.array([t for _, t in listed]))
    fps = near_copies.fingerprints(found, upto)
    close = {k for k in range(20) if (int(fps[k]) ^ int(fps[20 + k])).bit_count() <= 4}
    df = spark.createDataFrame([(f"{i:03}".encode(), int(f)) for (i, _), f in zip(listed, fps.view("int64"), strict=True)], "copy binary, fp long")
    pairs = {tuple(sorted((int(r["first"]), int(r["copy"])))) for r in near_copies._near_fingerprints(df).collect()}
    assert len(close) > 15 and pairs == {(k, 100 + k) for k in close}
    assert list(near_copies.fingerprints(*near_copies.shingles(pa.array(["", None, " "])))) == [0, 0, 0]


def near_groups(spark, seed):
    """Texts whose fingerprints lie close to one of four, in families of near copies: (copy, fp, shingles)."""
    rng, listed = random.Random(seed), []
    for size in (1, 3, 6, 150):
        centre = rng.getrandbits(63)
        for k in range(size):
            fp = centre ^ sum(1 << b for b in rng.sample(range(63), rng.choice((0, 0, 1, 2, 3))))
            family, own = 1000 * rng.randrange(max(1, size // 5)), rng.sample(range(100), rng.randrange(88, 101))
            listed.append((rng.randbytes(16), fp, [family + w for w in own]))
    df = spark.createDataFrame(listed, "copy binary, fp long, shingles array<long>")
    close = {
        tuple(sorted((a, b))): jaccard(set(s), set(t)) >= 0.8
        for k, (a, x, s) in enumerate(listed) for b, y, t in listed[:k] if (x ^ y).bit_count() <= 4
    }
    return [a for a, _, _ in listed], df, close


def test_few_near_fingerprints(spark):
    """All pairs of a small group, not a tree of links that connects it; texts of one fingerprint with all the others."""
    listed = [(b"a", 0), (b"b", 1), (b"c", 3), (b"d", 7), (b"e", 7), (b"f", 1 << 40 | 63)]
    found = near_copies._near_fingerprints(spark.createDataFrame(listed, "copy binary, fp long")).collect()
    got = sorted((bytes(r["first"]), bytes(r["copy"])) for r in found)
    assert got == sorted((a, b) for a, x in listed for b, y in listed if a < b and (x ^ y).bit_count() <= 4)


def test_all_texts_of_near_fingerprints_are_compared(spark):
    """Each with each, not along a tree of links or with the first text of a fingerprint only."""
    _, df, close = near_groups(spark, 3)
    texts, got = df.select("copy", "fp"), lambda found: {(bytes(r["first"]), bytes(r["copy"])) for r in found.collect()}
    assert len(close) > 4000 and got(near_copies._near_fingerprints(texts, most=None)) == set(close)
    ask = {bytes(r["copy"]) for r in texts.where("hash(copy) % 3 = 0").collect()}
    found = near_copies._near_fingerprints(texts, F.expr("hash(copy) % 3 = 0"), None)
    assert got(found) == {p for p in close if set(p) & ask}
    # In small groups at once, in larger ones with heads first.
    found = near_copies._near_fingerprints(texts)
    assert got(found) < set(close) and len(got(found.where("head IS NULL"))) >= 3


@pytest.mark.parametrize("asks", ["true", "hash(copy) % 3 = 0"])
def test_near_copies_by_trees(spark, asks):
    """Heads first: every pair of near copies is linked, or one of the two is to an earlier text."""
    copies, df, close = near_groups(spark, 4)
    df = stored(df.withColumn("asks", F.expr(asks)), "texts")
    ask = {bytes(r["copy"]) for r in df.where("asks").collect()}
    pairs = near_copies._near_fingerprints(df, F.col("asks"))
    found, starred = near_copies._tree_links(pairs, df.select("copy", "fp", "asks"), df.select("copy", "shingles"), 0.8)
    assert starred.count() > 100
    links = {(bytes(r["first"]), bytes(r["copy"])) for r in found.collect()}
    near, later = {p for p, is_near in close.items() if is_near}, {b for _, b in links}
    assert links <= near and links and not later & set(copies) - {b for _, b in near}
    assert all(p in links or set(p) & later for p in near if set(p) & ask)


def test_near_copies_of_one_fingerprint(spark):
    """A shingle that most of a text consists of makes fingerprints equal; near copies are what the other shingles say."""
    rng, listed = random.Random(8), []
    for family in range(6):
        base = [f"v{family}-{k}" for k in range(90)]
        for k in range(5):
            text = list(base)
            text[rng.randrange(90)] = f"x{family}-{k}"
            listed.append((5 * family + k, "same " * 150 + " ".join(text)))
    fps = near_copies.fingerprints(*near_copies.shingles(pa.array([t for _, t in listed])))
    assert len(set(fps.tolist())) == 1
    got = near_copies.keep_one(spark.createDataFrame(listed, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == kept_of(listed)

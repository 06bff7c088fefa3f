"""URL filters: rules by host and path, and a naive Bayes score of segmented words for all other urls.

Runs of letters in hosts and paths are split into words by Viterbi decoding under unigram counts
of the corpus. Only substrings of such runs are looked up, by a join with the word counts, so no
dictionary travels to the tasks. A multinomial naive Bayes model then scores the words. It is
additive, so hosts and path shapes (paths with their numbers blanked) are segmented and scored
once each, and urls only join two scores. Training labels come with the caller's urls, or from
seed words: a host with one of them counts as unwanted, and the model learns what else is in such
hosts.

Defined cases: a null url or one without `://` has empty host and path, no words and the prior's
verdict; without labelled urls of both kinds everything is allowed; an unknown run stays whole if
no split is more likely; repeated rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.llm.tables import is_small, prefixed, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules (verdict, host and path) of the query.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Words that mark a host as unwanted for training, and their count in the unigram model at least.
SEEDS = ("ads", "adult", "banner", "bets", "casino", "pills", "poker", "porn", "sex", "spam", "tracker", "viagra", "xxx")
SEED_COUNT = 50
#: Longest word of the unigram model (longer ones are unknown strings), smoothing.
LONGEST, ALPHA = 20, 1.0


@dataclass(frozen=True)
class Filter:
    rules: tuple[tuple[str, str], ...] = RULES
    seeds: tuple[str, ...] = SEEDS


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _parts(text: Column) -> Column:
    """Runs of letters, and `0` for each run of digits."""
    lowered = F.regexp_replace(F.translate(text, UPPER, LOWER), "[0-9]+", " 0 ")
    return F.array_remove(F.split(lowered, "[^a-z0]+"), "")


def word_counts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """word, n: how often the wanted words occur. texts: text; wanted: word."""
    words = texts.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x00-\x60\x7B-\x7F]+")).alias("word"))
    if is_small(wanted):
        words = words.join(F.broadcast(wanted), "word", "left_semi")
        return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(wanted, "word", "left_semi")


def split_words(run: str, count: dict[str, int], total: float) -> list[str]:
    """The most likely words of a run. An unknown string of k letters counts 1 in 10**k."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        options = []
        for begin in range(max(0, end - LONGEST), end):
            known = count.get(run[begin:end])
            cost = math.log(known / total) if known else -math.log(total) - math.log(10) * (end - begin)
            options.append((best[begin][0] + cost, begin))
        best.append(max(options))
    out, end = [], len(run)
    while end:
        begin = best[end][1]
        out.append(run[begin:end])
        end = begin
    return out[::-1]


def _segmented(total: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("run").to_pylist()
            pairs = zip(runs, batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True)
            words = [split_words(r, dict(zip(ws, ns, strict=True)), total) for r, ws, ns in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(words, pa.list_(pa.string()))], ["run", "words"])

    return run


def segment(runs: DataFrame, texts: DataFrame, seeds: tuple[str, ...]) -> DataFrame:
    """run and its `words`, for every distinct run of letters. runs: run; texts: text, the corpus."""
    runs = stored(runs.distinct(), "runs")
    # Position by position, with a hash for the run: a long one is neither repeated nor one array of its substrings.
    placed = runs.where("run <> ''").select(F.md5("run").alias("key"), "run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i"))
    tails = placed.select("key", F.col("run").substr(F.col("i"), F.lit(LONGEST)).alias("tail")).distinct()
    heads = F.transform(F.sequence(F.lit(1), F.length("tail")), lambda k: F.substring("tail", F.lit(1), k))
    inside = stored(tails.select("key", F.explode(heads).alias("word")), "substrings")
    counts = word_counts(texts, inside.select("word").distinct())
    spark = runs.sparkSession
    marked = spark.createDataFrame([(x, SEED_COUNT) for x in seeds], "word string, n long")
    counts = counts.unionByName(marked).groupBy("word").agg(F.max("n").alias("n"))
    counts = stored(counts, "unigrams")
    total = float(max(2, counts.agg(F.sum("n")).first()[0] or 0))
    # A run has at most LONGEST words at each of its letters.
    known = inside.distinct().join(counts, "word").groupBy("key").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("counts"))
    none = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    whole = runs.join(known, F.md5("run") == F.col("key"), "left").select("run", *(F.coalesce(c, e).alias(c) for c, e in zip(("words", "counts"), none, strict=True)))
    return whole.mapInArrow(_segmented(total), "run string, words array<string>")


def _words_of(table: DataFrame, key: str, segments: DataFrame) -> DataFrame:
    """One row per key and word of it, repeats included."""
    runs = table.select(key, F.explode(_parts(F.col(key))).alias("run"))
    return runs.join(segments, "run", "left").select(key, F.explode(F.coalesce("words", F.array("run"))).alias("word"))


def _scores(words: DataFrame, key: str, weights: DataFrame, name: str) -> DataFrame:
    return words.join(weights, "word").groupBy(key).agg(F.sum("weight").alias(name))


def url_verdicts(
    pages: DataFrame, corpus: DataFrame, options: Filter | None = None, *, labelled: DataFrame | None = None,
    page_id: str = "page_id", url: str = "url", text: str = "text",
) -> DataFrame:
    """One row per url: page_id, host, path, rule, verdict and the naive Bayes `score` (log odds).

    corpus: texts for the unigram counts. labelled: urls with `unwanted` 0 or 1; without it the
    urls themselves are the training set, labelled by the seed words in their hosts.
    """
    options = options or Filter()
    shape = F.regexp_replace(F.translate(F.col("path"), UPPER, LOWER), "[0-9]+", "0")
    split = lambda df: df.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("shape", shape)
    urls = stored(split(prefixed(pages, page_id=page_id, url=url)).drop("url"), "urls")
    train = urls.select("host", "shape", F.lit(None).cast("int").alias("unwanted"))
    if labelled is not None:
        train = split(prefixed(labelled, url="url", unwanted="unwanted")).select("host", "shape", "unwanted")
    # Distinct hosts and shapes: what follows is as large as those.
    both = urls.select("host", "shape").unionByName(train.select("host", "shape"))
    hosts, shapes = (stored(both.select(c).distinct(), c) for c in ("host", "shape"))
    runs = [t.select(F.explode(_parts(F.col(c))).alias("run")) for t, c in ((hosts, "host"), (shapes, "shape"))]
    segments = stored(segment(runs[0].unionByName(runs[1]), prefixed(corpus, text=text), options.seeds), "segments")
    host_words, shape_words = (stored(_words_of(t, c, segments), f"{c}-words") for t, c in ((hosts, "host"), (shapes, "shape")))
    if labelled is None:
        seeded = host_words.where(F.col("word").isin(*options.seeds)).select("host").distinct().withColumn("hit", F.lit(1))
        train = train.drop("unwanted").join(seeded, "host", "left").withColumn("unwanted", F.coalesce("hit", F.lit(0))).drop("hit")
    counted = stored(train.groupBy("host", "shape", "unwanted").agg(F.count(F.lit(1)).alias("n")), "training")
    per = lambda c: counted.groupBy(c, "unwanted").agg(F.sum("n").alias("n"))
    seen = host_words.join(per("host"), "host").select("word", "unwanted", "n").unionByName(
        shape_words.join(per("shape"), "shape").select("word", "unwanted", "n")
    )
    kind = lambda k: F.sum(F.when(F.col("unwanted") == k, F.col("n")).otherwise(0))
    words = stored(seen.groupBy("word").agg(kind(1).alias("bad"), kind(0).alias("good")), "word-kinds")
    n, bad, good = words.agg(F.count(F.lit(1)), F.sum("bad"), F.sum("good")).first()
    row = counted.agg(kind(1), kind(0)).first()
    wrong, right = row[0] or 0, row[1] or 0
    if wrong and right:
        chance = lambda c, total: F.log((F.col(c) + ALPHA) / (total + ALPHA * n))
        weights = stored(words.select("word", (chance("bad", bad) - chance("good", good)).alias("weight")), "weights")
        prior = math.log(wrong / right)
    else:
        weights, prior = words.select("word", F.lit(0.0).alias("weight")), -1.0
    by_host = stored(_scores(host_words, "host", weights, "of_host"), "host-scores")
    by_shape = stored(_scores(shape_words, "shape", weights, "of_shape"), "shape-scores")
    scored = urls.join(by_host, "host", "left").join(by_shape, "shape", "left")
    score = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in ("of_host", "of_shape")), F.lit(prior))
    rule, verdict = rule_for(F.col("host"), F.col("path"), options.rules)
    learned = F.when(score > 0, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), score.alias("score")
    )

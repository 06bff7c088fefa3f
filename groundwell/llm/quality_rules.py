"""Quality rules: counts of a text, and how far its histograms are from its language's.

Two histograms of a document, of its character classes and of the common words of its language,
meet the sums of all documents of that language by Jensen-Shannon distance. Everything is a
column expression of one row; only the sums per language are shuffled.

Defined cases: a null text counts as empty and fails the base rules; documents without language,
or of a language with few words, meet the sums over all languages; a language without a list of
common words is judged by characters alone; repeated rows are judged one by one; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.llm.tables import is_small, prefixed, stored, with_row

SPACES = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
UPPER = r"\p{Lu}"
DIGIT = "[0-9]"
PUNCTUATION = r"""[!"'()+,\-./:;=?@\[\\\]^_`{}~]"""
#: Frequent function words of a language; a word counts in lower case and without punctuation beside it.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "that", "is", "was", "for", "with", "as", "on", "be", "at", "by", "are"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "sur"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "ein"],
}
#: Words a text needs, and the share of repeated words it may have, in percent.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Largest distances, words a document needs to be judged by them, and words a language needs for sums of its own.
MAX_CHARS, MAX_COMMON, JUDGED_WORDS, LANGUAGE_WORDS = 0.25, 0.33, 100, 20_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACES}+"), "")


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, f"{pattern}+", ""))


def repeated_words(df: DataFrame, words: str, name: str) -> DataFrame:
    """Adds the number of words that lie in a window of three words found at two places or more.

    Windows are hashed and sorted inside the row; only texts in which two hashes are equal go on
    to positions.
    """
    size = F.size(words)
    word = lambda i: F.get(words, i)
    df = df.withColumn(
        "_w3",
        F.when(
            size >= 3,
            F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    places = F.sequence(F.lit(0), F.size("_w3") - 1)
    df = df.withColumn(
        "_at",
        F.when(
            F.size(F.array_distinct("_w3")) < F.size("_w3"),
            F.sort_array(F.arrays_zip(F.col("_w3").alias("h"), places.alias("i"))),
        ),
    )
    # Equal windows are neighbours now: the one before or the one after has the same hash.
    rows = F.size("_at")
    none = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("int").alias("i"))
    before = F.concat(F.array(none), F.slice("_at", F.lit(1), rows - 1))
    after = F.concat(F.slice("_at", F.lit(2), rows - 1), F.array(none))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    marked = F.zip_with(
        F.zip_with("_at", before, lambda x, b: F.struct(x.alias("x"), same(x, b).alias("b"))),
        after,
        lambda y, a: F.when(y["b"] | same(y["x"], a), y["x"]["i"]),
    )
    df = df.withColumn("_hit", F.when(F.col("_at").isNotNull(), F.sort_array(F.array_compact(marked))))
    gaps = F.zip_with(
        "_hit", F.slice("_hit", F.lit(2), F.size("_hit")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))
    )
    covered = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, gap: total + gap)
    return df.withColumn(name, F.coalesce(covered, F.lit(0).cast("bigint"))).drop("_w3", "_at", "_hit")


def counts(docs: DataFrame, *keep: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """The columns `keep`, `_lang`, the counts of the base rules and both histograms."""
    df = docs.select(
        *keep, F.col(lang).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_text")
    ).withColumn("_words", words_of(F.col("_text")))
    df = repeated_words(df, "_words", "n_repeat_words")
    chars = F.length("_text")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        *keep,
        "_lang",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (chars - _without(F.col("_text"), SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        *((chars - _without(F.col("_text"), p)).cast("bigint").alias(n) for n, p in (("_up", UPPER), ("_num", DIGIT), ("_pun", PUNCTUATION))),
        chars.cast("bigint").alias("_chars"),
        _common_words(F.col("_lang"), F.col("_text")).alias("_found"),
    )
    spaces = F.col("_chars") - F.col("word_chars")
    rest = F.col("word_chars") - F.col("n_symbols") - F.col("_up") - F.col("_num") - F.col("_pun")
    common = F.lit(None).cast("array<bigint>")
    for code, listed in COMMON.items():
        each = [F.size("_found") - F.size(F.array_remove("_found", w)) for w in listed]
        bins = F.array(*each, F.col("n_words").cast("int") - F.size("_found"))
        common = F.when(F.col("_lang") == code, F.transform(bins, lambda n: F.greatest(n, F.lit(0)).cast("bigint"))).otherwise(common)
    return df.select(
        *keep, "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array(spaces, F.col("_up"), F.col("_num"), F.col("n_symbols"), F.col("_pun"), rest).alias("_classes"),
        common.alias("_common"),
    )


def _common_words(lang: Column, text: Column) -> Column:
    """The words of the text that are common in its language, repeats included."""
    words = F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    out = F.lit(None).cast("array<string>")
    for code, listed in COMMON.items():
        out = F.when(lang == code, F.filter(words, _among(listed))).otherwise(out)
    return out


def _among(listed: list[str]) -> Callable[[Column], Column]:
    return lambda word: word.isin(listed)


def distance(ours: Column, theirs: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms; null if one is empty."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x).cast("double")
    part = lambda x, m: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    pairs = F.zip_with(ours, theirs, lambda a, b: F.struct((a / total(ours)).alias("p"), (b / total(theirs)).alias("q")))
    sums = F.aggregate(
        pairs,
        F.lit(0.0),
        lambda s, x: s + part(x["p"], (x["p"] + x["q"]) / 2) + part(x["q"], (x["p"] + x["q"]) / 2),
    )
    return F.when(
        (total(ours) > 0) & (total(theirs) > 0), F.sqrt(F.greatest(sums / (2 * math.log(2)), F.lit(0.0)))
    )


BINS = {"_classes": 6, "_common": 1 + max(len(x) for x in COMMON.values())}


def _summed(column: str, bins: int) -> Column:
    return F.array(*(F.coalesce(F.sum(F.get(column, F.lit(i))), F.lit(0)).cast("bigint") for i in range(bins)))


def references(counted: DataFrame) -> DataFrame:
    """Summed histograms and words, `_n`, of every language."""
    sums = [_summed(c, n).alias(f"{c}_ref") for c, n in BINS.items()]
    return counted.groupBy("_lang").agg(F.sum("n_words").alias("_n"), *sums)


def judge(counted: DataFrame) -> DataFrame:
    """Adds `char_distance`, `word_distance`, `base_failed` and `kept`."""
    refs = stored(references(counted), "language-sums")
    # Six numbers: the sums over all languages.
    overall = refs.agg(_summed("_classes_ref", BINS["_classes"]).alias("sums")).first()["sums"]
    own = refs.where(F.col("_lang").isNotNull() & (F.col("_n") >= LANGUAGE_WORDS)).drop("_n")
    met = counted.join(F.broadcast(own) if is_small(own) else own, "_lang", "left")
    rest = F.lit(overall).cast("array<bigint>")
    chars = distance(F.col("_classes"), F.coalesce(F.col("_classes_ref"), rest))
    common = distance(F.col("_common"), F.col("_common_ref"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    far = F.coalesce(F.col("char_distance") > MAX_CHARS, F.lit(False)) | F.coalesce(
        F.col("word_distance") > MAX_COMMON, F.lit(False)
    )
    return (
        met.withColumn("char_distance", chars)
        .withColumn("word_distance", common)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~((F.col("n_words") >= JUDGED_WORDS) & far))
        .drop("_lang", "_classes", "_common", "_classes_ref", "_common_ref")
    )


def quality_rules(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, counts, distances, `base_failed` and `kept`."""
    return judge(stored(counts(prefixed(docs, doc_id=doc_id, text=text, lang=lang), "doc_id", text="text", lang="lang"), "quality"))


def keep_good(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that are kept, with all their columns."""
    row = with_row(docs, _t=docs[text], _l=docs[lang])
    judged = judge(stored(counts(row, "row", text="_t", lang="_l"), "quality"))
    return judged.where("kept").select("row.*")

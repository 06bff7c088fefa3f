import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns that some operator might use itself.
EXTRA = ("id", "key", "h", "size", "row", "shard", "seq", "fp", "words", "sections", "n_words", "target", "_row", "_kept", "spaced", "tie", "site", "_hit", "hit", "_id", "_copy", "copy", "a.b")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties and clashing columns."""
    prose = " ".join(f"word{k % 97} and{k % 13}" for k in range(60))
    rows = [
        (1, prose, "en", "a"), (1, prose, "en", "a"), (2, None, None, None), (None, prose, "en", "b"), (3, "", "de", "b"),
        (4, " \n\t \r\n", "xx", "a"), (5, "x", None, "c"), (6, prose + " tail", "en", None), (7, "All rights reserved. " * 3, "en", "c"),
        (8, " ".join(f"z{k}" for k in range(60_000)), "fr", "a"), (9, "ein\x00wort é🙂\u00a0ü\n" * 30, "de", "d"), (None, None, None, None),
        (10, "w" * 300_000, "en", "d"),
    ]
    schema = DOCUMENTS + "".join(f", `{c}` string" for c in EXTRA)
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["x"] * len(EXTRA)) for r in rows], schema)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)

"""Percentiles of values that lie close together."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwell.operators import quantiles

PROBS = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def test_close_values_are_cut_until_few_are_sorted(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SORTED", 4)
    monkeypatch.setattr(quantiles, "PARTS", 16)
    kept, real = [], quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda rows, picks: kept.append((picks, real(rows, picks))) or kept[-1][1])
    rng = random.Random(4)
    groups = {
        # All in one bucket, among them many equal ones.
        "close": [0.9991 + rng.random() * 1e-4 for _ in range(400)] + [0.99915] * 100,
        "same": [3.5] * 50,
        "minus": [-1.0 - rng.random() * 1e-6 for _ in range(300)],
        "mixed": [rng.gauss(0, 5) for _ in range(200)] + [0.0] * 20,
        # Neighbouring doubles: no cut can do better than single values.
        "least": [float(np.nextafter(1.0, 2.0)) if i % 3 else 1.0 for i in range(90)],
        None: [1.0, 2.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in [*vs, None]]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in quantiles.percentiles(df, ["g"], F.col("v"), PROBS).collect()}
    for k, vs in groups.items():
        assert [got[k][p] for p in PROBS] == pytest.approx([np.percentile(vs, 100 * p) for p in PROBS.values()], abs=1e-12)
    before, after = kept[0]
    assert before.agg(F.max("n")).first()[0] >= 400
    # What is sorted: a few rows, or one value.
    assert after.where("n > 4 AND lo < hi").isEmpty()

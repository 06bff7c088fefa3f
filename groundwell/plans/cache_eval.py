"""Threshold sweeps over question pairs. Every sweep is one pass of conditional counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.operators.budget import best_per_group
from groundwell.operators.quantiles import percentiles

# Pair kinds, swept thresholds, adoption limits.
SAME, DIFFERENT = "same_intent", "different_intent"
THRESHOLDS = tuple(round(0.85 + 0.01 * i, 2) for i in range(15))
CANDIDATES = (0.80, 0.82, 0.84, 0.85, 0.86, 0.87, 0.88, 0.90)
DIRECT = 0.95
ADOPT_MAX_FALSE, ADOPT_MIN_HIT = 0.02, 0.50
DIRECTS, DIRECT_CANDIDATES = (0.95, 0.96, 0.97, 0.98), (0.80, 0.85)
LEVEL2_MAX_FALSE, LEVEL2_MIN_HIT = 0.02, 0.40


def _rate(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0))


def _rows(totals: DataFrame, keys: tuple[str, ...], rows: list[Column]) -> DataFrame:
    return totals.select(*keys, F.inline(F.array(*rows)))


def _kinds() -> tuple[Column, Column]:
    return F.col("kind") == SAME, F.col("kind") == DIFFERENT


def sweep(pairs: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Hit and false-hit rate, precision, recall and F1 per threshold; NULL over nothing."""
    same, diff = _kinds()
    hit = lambda t: F.col("similarity") >= t
    totals = pairs.agg(
        F.count_if(same).alias("same_total"),
        F.count_if(diff).alias("diff_total"),
        *(F.count_if(same & hit(t)).alias(f"s{i}") for i, t in enumerate(thresholds)),
        *(F.count_if(diff & hit(t)).alias(f"d{i}") for i, t in enumerate(thresholds)),
    )
    rows = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.col(f"s{i}").alias("same_hits"), F.col("same_total"),
            F.col(f"d{i}").alias("diff_hits"), F.col("diff_total"),
        )
        for i, t in enumerate(thresholds)
    ]
    out = _rows(totals, (), rows).withColumns(
        {
            "hit_rate": _rate(F.col("same_hits"), F.col("same_total")),
            "false_hit_rate": _rate(F.col("diff_hits"), F.col("diff_total")),
            "precision": _rate(F.col("same_hits"), F.col("same_hits") + F.col("diff_hits")),
        }
    )
    p, r = F.col("precision"), F.col("hit_rate")
    return out.withColumns({"recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r))})


def recommend(swept: DataFrame, max_false_hit_rate: float = 0.0) -> DataFrame:
    """The row with the highest hit rate within the false-hit limit; the lower threshold on a
    tie; no row if none qualifies."""
    fit = swept.where(F.col("hit_rate").isNotNull() & (F.col("false_hit_rate") <= max_false_hit_rate))
    return fit.orderBy(F.desc("hit_rate"), "threshold").limit(1)


def distribution(pairs: DataFrame) -> DataFrame:
    spread = pairs.groupBy("kind").agg(
        F.min("similarity").alias("min"), F.max("similarity").alias("max"), F.avg("similarity").alias("mean")
    )
    ranks = percentiles(pairs, ["kind"], F.col("similarity"), {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return spread.join(ranks, "kind")


def boundary_cases(pairs: DataFrame, n: int = 5) -> DataFrame:
    """The same-intent pairs least alike and the different-intent pairs most alike."""
    far = F.when(F.col("kind") == SAME, F.col("similarity")).otherwise(-F.col("similarity"))
    return best_per_group(pairs, ["kind"], [far, F.col("id")], n)


def verify_sweep(
    pairs: DataFrame,
    params: list[tuple[float | None, float]] | None = None,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Hit quality per (direct threshold, candidate threshold).

    At or above the direct threshold a pair hits; from the candidate threshold on it hits
    if the verifier said so; a direct threshold of None sends every pair to the verifier.
    """
    params = params if params is not None else [(DIRECT, c) for c in CANDIDATES]
    same, diff = _kinds()
    sim, said_yes = F.col("similarity"), F.coalesce("verify_same", F.lit(False))
    cols = [F.count_if(same).alias("same_total"), F.count_if(diff).alias("diff_total")]
    rows = []
    for i, (direct, candidate) in enumerate(params):
        at_once = F.lit(False) if direct is None else sim >= direct
        asked = ~at_once & (sim >= candidate)
        hit = at_once | (asked & said_yes)
        parts = {
            "same_hits": same & hit, "diff_hits": diff & hit, "verify_calls_same": same & asked,
            "verify_calls_diff": diff & asked, "direct_hits_diff": diff & at_once,
        }
        cols += [F.count_if(c).alias(f"{n}_{i}") for n, c in parts.items()]
        rows.append(
            F.struct(
                F.lit("always_verify" if direct is None else "direct").alias("mode"),
                F.lit(direct).cast("double").alias("direct_threshold"),
                F.lit(float(candidate)).alias("candidate_threshold"),
                "same_total", "diff_total",
                *(F.col(f"{n}_{i}").alias(n) for n in parts),
            )
        )
    totals = pairs.groupBy(*keys).agg(*cols)
    out = _rows(totals, keys, rows).withColumns(
        {
            "hit_rate": _rate(F.col("same_hits"), F.col("same_total")),
            "false_hit_rate": _rate(F.col("diff_hits"), F.col("diff_total")),
            "verify_calls": F.col("verify_calls_same") + F.col("verify_calls_diff"),
        }
    )

    def meets(max_false: float, min_hit: float) -> Column:
        return F.coalesce((F.col("false_hit_rate") <= max_false) & (F.col("hit_rate") >= min_hit), F.lit(False))

    return out.withColumns(
        {"adopt": meets(ADOPT_MAX_FALSE, ADOPT_MIN_HIT), "meets_l2": meets(LEVEL2_MAX_FALSE, LEVEL2_MIN_HIT)}
    )


def direct_sweep(pairs: DataFrame) -> DataFrame:
    return verify_sweep(pairs, [(d, c) for d in (*DIRECTS, None) for c in DIRECT_CANDIDATES])


def _wrong(kind: str) -> Column:
    same, diff = _kinds()
    return diff & F.col("verify_same") if kind == "false_yes" else same & ~F.col("verify_same")


def verify_stats(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The verifier on its own, over all pairs it judged."""
    judged = pairs.where(F.col("verify_same").isNotNull())
    stats = judged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_wrong("false_yes")).alias("false_yes"),
        F.count_if(_wrong("false_no")).alias("false_no"),
        F.avg("verify_prompt_tokens").alias("avg_prompt_tokens"),
        F.avg("verify_completion_tokens").alias("avg_completion_tokens"),
        F.count_distinct("verify_model").alias("models"),
        F.count_distinct(F.when(F.col("verify_prompt_version") != "", F.col("verify_prompt_version"))).alias("prompt_versions"),
    ).withColumn("accuracy", (F.col("total") - F.col("false_yes") - F.col("false_no")) / F.col("total"))
    lat = percentiles(judged, list(keys), F.col("verify_latency_ms"), {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95})
    if keys:
        return stats.join(lat, list(keys), "left")
    # Two rows with different columns, put into one.
    both = stats.unionByName(lat, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def misjudged(pairs: DataFrame) -> DataFrame:
    """(id, error) of the pairs the verifier got wrong."""
    error = F.when(_wrong("false_yes"), "false_yes").when(_wrong("false_no"), "false_no")
    return pairs.select("id", error.alias("error")).where(F.col("error").isNotNull())


def verify_outcomes(pairs: DataFrame) -> DataFrame:
    outcome = F.coalesce(F.when(F.col("verify_outcome") != "", F.col("verify_outcome")), F.lit("-"))
    return pairs.where(F.col("verify_same").isNotNull()).groupBy(outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("n")
    )


def version_comparison(pairs: DataFrame, candidates: tuple[float, ...] = (0.80, 0.85)) -> DataFrame:
    """Verifier and hit quality per prompt version; pairs without a version form version ''."""
    key = ("verify_prompt_version",)
    rows = pairs.withColumn(key[0], F.coalesce(key[0], F.lit("")))
    stats = verify_stats(rows, key).select(*key, "total", "accuracy", "false_yes", "false_no")
    swept = verify_sweep(rows, [(DIRECT, c) for c in candidates], key).groupBy(*key).agg(
        *(
            F.max(F.when(F.col("candidate_threshold") == c, F.col("hit_rate"))).alias(f"hit_rate_{round(c * 100)}")
            for c in candidates
        ),
        F.max(F.when(F.col("candidate_threshold") == candidates[0], F.col("false_hit_rate"))).alias("false_hit_rate"),
    )
    return stats.join(swept, list(key))

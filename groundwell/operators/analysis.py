"""Model analyses with the rule-based ones behind them, for commits, documents and workspaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.functions.text import is_blank


def analyse(
    rows: DataFrame,
    replies: DataFrame,
    key: str,
    columns: list[str],
    mode: str = "llm",
    *,
    defaults: dict[str, str] | None = None,
    selected: str | None = None,
) -> DataFrame:
    """`rows` with `columns` from the model where it answered, and `analysis_mode`.

    rows: key and the rule-based `columns`; replies: key, the same columns, error (NULL if the
    call went well). In any mode but `llm` no reply is used and the mode is named as given. A call
    that failed or has no reply leaves the rules' columns (`llm_fallback`); an empty column of a good
    reply takes its default. `selected` names a boolean column: rows without it are not sent to the
    model, and stay with the rules in mode `rule`.
    """
    mode = mode.strip().lower()
    if mode != "llm":
        return rows.withColumn("analysis_mode", F.lit(mode))
    told = replies.select(key, F.struct(*columns).alias("_reply"), F.col("error").isNull().alias("_good"))
    asked = F.lit(True) if selected is None else F.coalesce(F.col(selected), F.lit(False))
    good = asked & F.coalesce(F.col("_good"), F.lit(False))

    def value(name: str):
        said = F.col(f"_reply.{name}")
        if name in (defaults or {}):
            said = F.when(is_blank(F.coalesce(said, F.lit(""))), F.lit(defaults[name])).otherwise(said)
        return F.when(good, said).otherwise(F.col(name))

    used = F.when(good, "llm").when(asked, "llm_fallback").otherwise("rule")
    return (
        rows.join(told, key, "left")
        .withColumns({name: value(name) for name in columns} | {"analysis_mode": used})
        .drop("_reply", "_good")
    )

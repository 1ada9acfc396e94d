"""Combining models: fixed weights, and choice by market regime.

Long scores are (model, as_of, ticker, score). Mapping tables (regime -> model, weight) have a handful of
rows fixed by configuration and become literal map columns, so selection adds no join.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwise.functions.exprs import literal_rows, ratio
from panelwise.functions.joins import CONFIGS, DAYS, bounded


def _lit_map(m: Mapping[str, float | str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in m.items() for x in kv])


def weighted_ensemble(scores: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Weighted sum over models; a missing score counts 0 unless every model lacks it."""
    w = F.try_element_at(_lit_map({k: float(v) for k, v in weights.items()}), F.col("model"))
    return scores.groupBy("as_of", "ticker").agg(F.sum(w * F.col("score")).alias("score"))


def selection_table(
    spark: SparkSession, regime_weights: Mapping[str, Mapping[str, float]], default: Mapping[str, float]
) -> DataFrame:
    """(regime, model, weight) with the default under regime NULL. Negative weights and zero totals are errors."""
    rows = []
    for regime, weights in [*regime_weights.items(), (None, default)]:
        if any(w < 0 for w in weights.values()):
            raise ValueError(f"regime {regime}: weight must be >= 0")
        if sum(weights.values()) == 0:
            raise ValueError(f"regime {regime}: total weight is 0")
        rows += [(regime, m, float(w)) for m, w in weights.items()]
    return literal_rows(spark, ["regime", "model", "weight"], rows)


def selector_from_config(spark: SparkSession, config: Mapping) -> DataFrame:
    """``{"type": "regime_based" | "regime_weighted", ...}`` -> selection table."""
    kind = config.get("type")
    if kind == "regime_based":
        single = {r: {m: 1.0} for r, m in config["regime_models"].items()}
        return selection_table(spark, single, {config.get("default", "momentum"): 1.0})
    if kind == "regime_weighted":
        return selection_table(spark, config["regime_weights"], config["default"])
    raise ValueError(f"unknown selector type {kind}")


def select_models(regimes: DataFrame, table: DataFrame) -> DataFrame:
    """(as_of, regime) -> (as_of, regime, model, share). Shares of one regime sum to 1.

    Both sides are bounded: one row per decision date and one per configured (regime, model).
    """
    total = table.groupBy(F.col("regime").alias("of")).agg(F.sum("weight").alias("total"))
    share = table.join(total, F.col("regime").eqNullSafe(F.col("of"))).select(
        "regime", "model", ratio("weight", "total").alias("share")
    )
    known = share.filter(F.col("regime").isNotNull()).select(F.col("regime").alias("known")).distinct()
    keyed = regimes.join(bounded(known, CONFIGS), F.col("regime") == F.col("known"), "left")
    return keyed.join(bounded(share.withColumnRenamed("regime", "key"), CONFIGS), F.col("known").eqNullSafe(F.col("key"))).select(
        "as_of", "regime", "model", "share"
    )


def apply_selection(scores: DataFrame, selection: DataFrame) -> DataFrame:
    """Scores under the selected model or blend. One model keeps its NULLs; a blend turns all-missing into 0."""
    n = selection.groupBy("as_of").agg(F.count("*").alias("n_models"))
    j = scores.join(bounded(selection, 10 * DAYS), ["as_of", "model"]).join(bounded(n, DAYS), "as_of")
    out = j.groupBy("as_of", "ticker").agg(
        F.sum(F.col("score") * F.col("share")).alias("s"), F.max("n_models").alias("n"), F.first("regime").alias("regime")
    )
    return out.select(
        "as_of", "ticker", "regime", F.when(F.col("n") > 1, F.coalesce("s", F.lit(0.0))).otherwise(F.col("s")).alias("score")
    )


def selection_history(selection: DataFrame) -> DataFrame:
    """(as_of, regime, selection) with a readable label; a label holds at most the configured models."""
    part = F.concat_ws(":", "model", F.concat(F.round(F.col("share") * 100).cast("int").cast("string"), F.lit("%")))
    label = F.array_join(F.array_sort(F.collect_list(part)), ", ")
    single = F.concat(F.lit("model="), F.max("model"))
    return selection.groupBy("as_of", "regime").agg(
        F.when(F.count("*") == 1, single).otherwise(F.concat(F.lit("ensemble=["), label, F.lit("]"))).alias("selection")
    )


def selection_stats(selection: DataFrame) -> DataFrame:
    return selection.select("as_of", "regime").distinct().groupBy("regime").agg(F.count("*").alias("n"))

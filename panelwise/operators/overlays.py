"""Risk overlays: each takes (strategy_id, as_of, ticker, weight) and returns the same shape.

Diagnostics travel as extra columns with the overlay's prefix. Overlays chain with ``DataFrame.transform``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwise.functions.exprs import ratio
from panelwise.functions.joins import CONFIGS, DAYS, bounded

KEYS = ["strategy_id", "as_of"]
# A parameter is a number for all strategies, or the name of a column that holds each strategy's own.
Parameter = float | str
# Instruments that receive the defensive share.
DEFENSIVE = ("AGG", "TLT", "GLD", "USMV", "SPLV")


def par(x: Parameter) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def volatility_target(
    weights: DataFrame, returns: DataFrame, target: Parameter = 0.15, lookback_days: int = 60, halflife: float = 20.0,
    min_scale: Parameter = 0.25, max_scale: Parameter = 1.5, min_rows: int = 20,
) -> DataFrame:
    """Scale a portfolio to the target volatility, from exponentially weighted squared portfolio returns.

    The read window of ``lookback_days`` is exploded on the weight side (few rows), which turns the range join
    into an equi-join on (date, ticker). Returns whose previous bar lies before the window are not used.
    """
    # "$CASH$" has no bars, so it drops out of the join by itself.
    held = weights.filter(F.col("weight") > 0).select(
        *KEYS, "ticker", "weight", F.explode(F.sequence(F.date_sub("as_of", lookback_days), F.date_sub("as_of", 1))).alias("date")
    )
    bars = returns.select("date", "ticker", "r", "prev_date")
    inside = F.col("prev_date") >= F.date_sub("as_of", lookback_days)
    port = held.join(bars, ["date", "ticker"]).filter(inside).groupBy(*KEYS, "date").agg(
        F.sum(F.col("weight") * F.col("r")).alias("r")
    )
    age = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("date").desc())) - 1
    lam = 0.5 ** (1.0 / halflife)
    aged = port.withColumn("_w", F.pow(F.lit(lam), age))
    vol = aged.groupBy(*KEYS).agg(
        F.sqrt(ratio(F.sum(F.col("_w") * F.col("r") * F.col("r")), F.sum("_w")) * 252.0).alias("realized_vol"),
        F.count("*").alias("vol_rows"),
    )
    j = weights.join(vol, KEYS, "left")
    def within(x: Column) -> Column:
        return F.least(F.greatest(x, par(min_scale)), par(max_scale))

    scale = F.when(F.coalesce("vol_rows", F.lit(0)) < min_rows, 1.0).when(
        F.col("realized_vol") < 0.01, within(F.lit(1.0))
    ).otherwise(F.when(F.col("realized_vol").isNotNull(), within(par(target) / F.col("realized_vol"))))
    return j.withColumn("scale_factor", scale).withColumn("weight", F.col("weight") * F.col("scale_factor")).drop("vol_rows")


def position_limit(weights: DataFrame, max_weight: Parameter = 0.25, redistribute: bool = True) -> DataFrame:
    """Cap positions; hand the excess once to the uncapped ones in proportion, and cap again."""
    by = Window.partitionBy(*KEYS)
    capped = F.least(F.col("weight"), par(max_weight))
    w = weights.withColumns({"_cap": capped, "_over": F.col("weight") - capped})
    excess = F.sum("_over").over(by)
    open_ = (F.col("_cap") > 0) & (F.col("_cap") < par(max_weight))
    pool = F.sum(F.when(open_, F.col("_cap"))).over(by)
    w = w.withColumns({"excess_weight": excess, "_pool": pool})
    add = F.when(open_ & (F.col("excess_weight") > 0), F.col("excess_weight") * ratio("_cap", "_pool"))
    final = F.least(F.col("_cap") + F.coalesce(add, F.lit(0.0)), par(max_weight))
    return w.withColumn("weight", final if redistribute else F.col("_cap")).drop("_cap", "_over", "_pool")


def drawdown_breaker(
    weights: DataFrame, states: DataFrame, levels: Sequence[tuple[str, Parameter, Parameter]] = (
        ("EXIT", 0.30, 0.25), ("HARD", 0.20, 0.50), ("SOFT", 0.10, 0.75)),
) -> DataFrame:
    """Cut exposure by drawdown from the peak. ``states``: (strategy_id, as_of, nav, peak_nav); none means full exposure."""
    dd = F.when(F.col("peak_nav") > 0, (F.col("peak_nav") - F.col("nav")) / F.col("peak_nav")).otherwise(0.0)
    j = weights.join(states.select(*KEYS, "nav", "peak_nav"), KEYS, "left").withColumn("drawdown", dd)
    factor, level = F, F
    for name, at, keep in levels:
        factor = factor.when(F.col("drawdown") >= par(at), par(keep))
        level = level.when(F.col("drawdown") >= par(at), name)
    return j.withColumns({"exposure_factor": factor.otherwise(1.0), "breaker_level": level.otherwise("NONE")}).withColumn(
        "weight", F.col("weight") * F.col("exposure_factor")
    ).drop("nav", "peak_nav")


def volatility_regime(
    weights: DataFrame, vix: DataFrame, defensive: Sequence[str] = DEFENSIVE, high: Parameter = 30.0, elevated: Parameter = 25.0,
    high_share: Parameter = 0.50, elevated_share: Parameter = 0.25, carry: Sequence[str] = (),
) -> DataFrame:
    """Move a share to defensive instruments when the volatility index is high. ``vix``: (as_of, vix), one row per date.

    Non-defensive weights shrink to 1 - share; the share is split evenly over the defensives, which are added when absent.
    ``carry``: columns with one value for each strategy and date that stay.
    """
    level = F.when(F.col("vix").isNull(), "UNKNOWN").when(F.col("vix") >= par(high), "HIGH_VOL").when(
        F.col("vix") >= par(elevated), "ELEVATED_VOL").otherwise("NORMAL")
    share = F.when(F.col("vix") >= par(high), par(high_share)).when(F.col("vix") >= par(elevated), par(elevated_share)).otherwise(0.0)
    is_def = F.col("ticker").isin(list(defensive))
    by = Window.partitionBy(*KEYS)
    w = weights.select(*KEYS, "ticker", "weight", *carry).join(bounded(vix.groupBy("as_of").agg(F.max("vix").alias("vix")), DAYS), "as_of", "left")
    risky = F.sum(F.when(~is_def, F.col("weight"))).over(by)
    first = F.row_number().over(by.orderBy("ticker")) == 1
    w = w.withColumns({"vix_level": level, "_share": share, "_risky": risky, "_first": first})
    moved = (F.col("_share") > 0) & (F.col("_risky") > 0)
    own = F.struct("ticker", F.when(moved & ~is_def, F.col("weight") * (1.0 - F.col("_share"))).otherwise(F.col("weight")).alias("weight"))
    adds = [F.struct(F.lit(d).alias("ticker"), (F.col("_share") / len(defensive)).alias("weight")) for d in defensive]
    rows = F.when(moved & F.col("_first"), F.array(own, *adds)).otherwise(F.array(own))
    extra = ["vix_level", *carry]
    return w.select(*KEYS, *extra, F.inline(rows)).groupBy(*KEYS, *extra, "ticker").agg(F.sum("weight").alias("weight"))


def chain(weights: DataFrame, overlays: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    return reduce(lambda df, f: df.transform(f).select(*KEYS, "ticker", "weight"), overlays, weights)


# Parameters of a configuration row; a null first one of an overlay turns it off.
PARAMETERS = {
    "target_vol": None, "min_scale": 0.25, "max_scale": 1.5, "max_weight": None, "soft": None, "hard": None, "exit": None,
    "soft_keep": 0.75, "hard_keep": 0.50, "exit_keep": 0.25, "high_vix": None, "elevated_vix": None, "high_share": 0.50,
    "elevated_share": 0.25,
}
MEASURES = ("realized_vol", "scale_factor", "excess_weight", "drawdown", "exposure_factor", "defensive_share")


def configured(
    weights: DataFrame, configs: DataFrame, returns: DataFrame, states: DataFrame, vix: DataFrame, defensive: Sequence[str] = DEFENSIVE,
) -> DataFrame:
    """All four overlays with the parameters of each configuration row: volatility, limit, breaker, volatility regime, in this order.

    ``configs``: (strategy_id, config) and any of ``PARAMETERS``; a strategy may have several rows, which run side by side
    in one plan. Unknown columns are refused. Returns (strategy_id, config, as_of, ticker, weight, diagnostics, levels):
    what each overlay measured or did, and the names of the levels it found, as maps. Overlays that are off leave no entry.
    """
    unknown = set(configs.columns) - {"strategy_id", "config", *PARAMETERS}
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")

    def own(name: str) -> Column:
        given = F.col(name).cast("double") if name in configs.columns else F.lit(None).cast("double")
        default = PARAMETERS[name]
        return (given if default is None else F.coalesce(given, F.lit(default))).alias(f"p_{name}")

    rows = configs.select("strategy_id", "config", *[own(n) for n in PARAMETERS])
    names = [f"p_{n}" for n in PARAMETERS]
    # Configurations are strategies of their own while the overlays run.
    key = F.struct(F.col("strategy_id"), F.col("config"))
    w = weights.select(*KEYS, "ticker", "weight").join(bounded(rows, CONFIGS), "strategy_id")
    w = w.withColumn("strategy_id", key).drop("config")
    known = states.select(*KEYS, "nav", "peak_nav").join(bounded(rows.select("strategy_id", "config"), CONFIGS), "strategy_id")
    known = known.withColumn("strategy_id", key).drop("config")

    def switched(after: DataFrame, on: str, *measures: str) -> DataFrame:
        """The overlay's weights and measures where its parameter is given."""
        out = after.withColumn("weight", F.when(F.col(on).isNotNull(), F.col("weight")).otherwise(F.col("_before")))
        return out.withColumns({m: F.when(F.col(on).isNotNull(), F.col(m)) for m in measures}).drop("_before")

    def before(df: DataFrame) -> DataFrame:
        return df.withColumn("_before", F.col("weight"))

    w = switched(volatility_target(before(w), returns, "p_target_vol", min_scale="p_min_scale", max_scale="p_max_scale"),
                 "p_target_vol", "realized_vol", "scale_factor")
    w = switched(position_limit(before(w), "p_max_weight"), "p_max_weight", "excess_weight")
    w = switched(drawdown_breaker(before(w), known, (
        ("EXIT", "p_exit", "p_exit_keep"), ("HARD", "p_hard", "p_hard_keep"), ("SOFT", "p_soft", "p_soft_keep"))),
        "p_soft", "drawdown", "exposure_factor", "breaker_level")
    # Off means thresholds that nothing reaches.
    off = {n: F.coalesce(n, F.lit(float("inf"))) for n in ("p_high_vix", "p_elevated_vix")}
    on = F.col("p_high_vix").isNotNull()
    seen = w.withColumn("_on", on).withColumns(off)
    carry = ["_on", *names, *MEASURES[:-1], "breaker_level"]
    w = volatility_regime(seen, vix, defensive, "p_high_vix", "p_elevated_vix", "p_high_share", "p_elevated_share", carry)
    share = F.when(F.col("vix_level") == "HIGH_VOL", F.col("p_high_share")).when(
        F.col("vix_level") == "ELEVATED_VOL", F.col("p_elevated_share")).otherwise(0.0)
    w = w.withColumns({"defensive_share": F.when(F.col("_on"), share), "vix_level": F.when(F.col("_on"), F.col("vix_level"))})

    def present(columns: Sequence[str]) -> Column:
        cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns])
        return F.map_from_entries(F.filter(cells, lambda e: e["value"].isNotNull()))

    return w.select(F.col("strategy_id.strategy_id").alias("strategy_id"), F.col("strategy_id.config").alias("config"), "as_of", "ticker",
                    "weight", present(MEASURES).alias("diagnostics"), present(("breaker_level", "vix_level")).alias("levels"))

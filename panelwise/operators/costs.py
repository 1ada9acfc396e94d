"""Trading cost as a fraction of portfolio value, per (strategy_id, as_of).

Input: the weight pairs of ``construction.paired``. Flat cost scales with turnover. The other models
return the trade-weighted average rate, not multiplied by turnover; ``times_turnover`` scales it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelwise.functions.exprs import ratio

MOVE = F.abs
BPS = 10_000.0

# Half-spread estimates by ticker, in basis points.
DEFAULT_SPREADS = {
    "SPY": 1.0, "QQQ": 1.0, "IWM": 2.0, "VOO": 1.5, "VTI": 1.0, "VEA": 2.0, "VWO": 3.0, "EEM": 5.0,
    "TLT": 3.0, "GLD": 2.0, "VNQ": 5.0, "AGG": 2.0, "BND": 2.0, "XLF": 2.0, "XLE": 2.0, "XLK": 2.0,
    "XLV": 2.0, "ARKK": 15.0, "ARKG": 15.0, "TAN": 20.0, "ICLN": 15.0,
}


def _move() -> Column:
    return F.abs(F.coalesce("next_w", F.lit(0.0)) - F.coalesce("prev_w", F.lit(0.0)))


def _check(**values: float) -> None:
    for k, v in values.items():
        if v < 0:
            raise ValueError(f"{k} must be >= 0, got {v}")


def _per_rebalance(pairs: DataFrame, cost: Column) -> DataFrame:
    return pairs.groupBy("strategy_id", "as_of").agg(
        (0.5 * F.sum(_move())).alias("turnover"), F.coalesce(cost, F.lit(0.0)).alias("cost")
    )


def _average_rate(rate_bps: Column, times_turnover: bool) -> Column:
    avg = ratio(F.sum(rate_bps * _move()), F.sum(_move())) / BPS
    return avg * 0.5 * F.sum(_move()) if times_turnover else avg


def flat(pairs: DataFrame, cost_bps: float = 10.0) -> DataFrame:
    _check(cost_bps=cost_bps)
    return _per_rebalance(pairs, 0.5 * F.sum(_move()) * (cost_bps / BPS))


def slippage(
    pairs: DataFrame, base_spread_bps: float = 5.0, impact_coefficient: float = 2.0, times_turnover: bool = False
) -> DataFrame:
    _check(base_spread_bps=base_spread_bps, impact_coefficient=impact_coefficient)
    return _per_rebalance(pairs, _average_rate(base_spread_bps + _move() * impact_coefficient * 100.0, times_turnover))


def spread(
    pairs: DataFrame, spreads: DataFrame, default_bps: float = 10.0, times_turnover: bool = False
) -> DataFrame:
    """``spreads``: (ticker, spread_bps), one row per instrument; joined without a hint, missing rows default."""
    _check(default_bps=default_bps)
    p = pairs.join(spreads.groupBy("ticker").agg(F.max("spread_bps").alias("spread_bps")), "ticker", "left")
    return _per_rebalance(p, _average_rate(F.coalesce("spread_bps", F.lit(float(default_bps))), times_turnover))


def impact(pairs: DataFrame, impact_coefficient: float = 5.0, times_turnover: bool = False) -> DataFrame:
    _check(impact_coefficient=impact_coefficient)
    return _per_rebalance(pairs, _average_rate(impact_coefficient * F.sqrt(_move()), times_turnover))

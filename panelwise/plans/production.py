"""Production day for all dates at once: gate, overlays, trades, checks, status; regime-driven rebalance."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from panelwise.functions.dates import schedule_days
from panelwise.functions.exprs import ratio
from panelwise.functions.joins import DAYS, bounded
from panelwise.operators import construction, overlays, regimes as R, trades as T
from panelwise.sources.storage import durable


def production_run(
    targets: DataFrame, current: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]], sectors: DataFrame,
    start: str, end: str, schedule: str, threshold: float = 0.0, max_turnover: float = 0.5, max_sector: float = 0.4,
) -> DataFrame:
    """(strategy_id, as_of, status, n_trades, turnover) for every business day.

    Days outside the schedule are skipped; a rebalance day with a failed check is blocked, otherwise pending.
    """
    adjusted = overlays.chain(targets, steps)
    pairs = T.align(current, adjusted)
    # Summary and both checks read the trades: written once, so that the signals behind them run once.
    trades = durable(T.diff_trades(pairs, threshold))
    summary = trades.groupBy("strategy_id", "as_of").agg(
        F.count("*").alias("n_trades"), (0.5 * F.sum(F.abs("delta_weight"))).alias("turnover")
    )
    checks = T.check_turnover(trades, max_turnover).unionByName(T.check_sectors(trades, sectors, max_sector))
    passed = checks.groupBy("strategy_id", "as_of").agg(F.bool_and("passed").alias("passed"))
    days = trades.select("strategy_id").distinct().select(
        "strategy_id", F.explode(schedule_days(start, end, "daily")).alias("as_of")
    )
    gate = F.array_contains(schedule_days(start, end, schedule), F.col("as_of"))
    j = days.join(summary, ["strategy_id", "as_of"], "left").join(passed, ["strategy_id", "as_of"], "left")
    status = F.when(~gate, "skipped").when(F.coalesce("passed", F.lit(True)), "pending").otherwise("blocked")
    return j.select(
        "strategy_id", "as_of", status.alias("status"), F.coalesce("n_trades", F.lit(0)).alias("n_trades"),
        F.coalesce("turnover", F.lit(0.0)).alias("turnover"),
    )


def regime_rebalance(
    scores: DataFrame, regimes: DataFrame, mapping: Mapping[str, str], fallback: str, calendar: DataFrame,
    prices: DataFrame, top_n: int = 5, portfolio_value: float = 100_000.0,
) -> tuple[DataFrame, DataFrame]:
    """Regime -> strategy -> scores -> fully invested targets -> share trades, for all decision dates.

    ``scores``: (model, as_of, ticker, score). Returns (targets, trades); dates without scores have no targets.
    """
    chosen = R.map_strategy(regimes, mapping, fallback)
    picked = scores.join(bounded(chosen, DAYS), (scores["as_of"] == chosen["as_of"]) & (scores["model"] == chosen["strategy"])).select(
        scores["as_of"], "ticker", "score", "regime", "strategy"
    )
    w = construction.top_x_fully_invested(picked, top_n, ["as_of"]).withColumn("strategy_id", F.lit("regime"))
    tgt = T.to_shares(w.join(prices, ["as_of", "ticker"]), portfolio_value)
    return tgt, T.share_trades(T.consecutive(tgt, calendar, T.SHARE_FIELDS))


def rebalance_summary(trades: DataFrame) -> DataFrame:
    """Trade counts and traded share of the notional per rebalance."""
    act = F.col("action") != "HOLD"
    return trades.groupBy("as_of").agg(
        F.count_if(act).alias("num_trades"),
        F.coalesce(ratio(F.sum(F.when(act, F.col("notional_value"))), F.sum("notional_value")), F.lit(0.0)).alias("turnover"),
    )

"""Registered queries: macro reads, regimes, regime statistics, regime-driven rebalance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwise.functions.dates import schedule_days
from panelwise.functions.exprs import literal_rows, num, sig
from panelwise.operators import asof, regimes as R, signals as S
from panelwise.operators.returns import benchmark_prices
from panelwise.operators.schedule_defaults import END, START
from panelwise.plans.catalog.metrics_q import strategies
from panelwise.plans.catalog.portfolio_q import monthly
from panelwise.plans.catalog.signals_q import BENCH, MODEL_SQL, MODELS, month_marks
from panelwise.plans.production import rebalance_summary, regime_rebalance
from panelwise.plans.registry import query
from panelwise.plans.sqlkit import sig as q_sig, with_ctes
from panelwise.sources.panel import bars_from_orders, macro_from_orders

SNAP_SQL = ", ".join(f"{q_sig(v, 11)} AS {k}" for k, v in R.SNAPSHOT.items())


@query("macro_snapshot", with_ctes(
    "macro_at", f"SELECT as_of, {SNAP_SQL}, coalesce(VIX > 25, FALSE) AS is_high_vol, coalesce(T10Y2Y < 0, FALSE) AS is_inverted FROM macro_at"))
def macro_snapshot(spark: SparkSession, root: str) -> DataFrame:
    s = R.macro_snapshot(macro_from_orders(spark, root), schedule_days(START, END, "monthly"))
    return s.select("as_of", *[sig(k, 11).alias(k) for k in R.SNAPSHOT], "is_high_vol", "is_inverted")


@query("macro_wide_table", with_ctes("macro_w", f"SELECT date, {q_sig('VIX', 11)} AS VIX, {q_sig('T10Y2Y', 11)} AS T10Y2Y, {q_sig('DGS10', 11)} AS DGS10 FROM macro_w"))
def macro_wide_table(spark: SparkSession, root: str) -> DataFrame:
    w = R.macro_wide(macro_from_orders(spark, root), ["VIX", "T10Y2Y", "DGS10"])
    return w.select("date", *[sig(c, 11).alias(c) for c in ("VIX", "T10Y2Y", "DGS10")])


@query("macro_indicator_read", with_ctes(
    "macro", f"SELECT date, {q_sig('value', 11)} AS value FROM macro WHERE indicator = 'T10Y2Y' AND date <= DATE '2000-06-30' AND date >= DATE '2000-06-30' - 365"))
def macro_indicator_read(spark: SparkSession, root: str) -> DataFrame:
    m = R.macro_read(macro_from_orders(spark, root), "YIELD_CURVE_10Y2Y", "2000-06-30", 365)
    return m.select("date", sig("value", 11).alias("value"))


@query("macro_series_range", with_ctes(
    "macro", f"SELECT date, {q_sig('value', 11)} AS value FROM macro WHERE indicator = 'VIX' AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"))
def macro_series_range(spark: SparkSession, root: str) -> DataFrame:
    return R.macro_range(macro_from_orders(spark, root), "VIX", "1997-01-01", "1998-12-31").select("date", sig("value", 11).alias("value"))


BYVOL = "WHEN v > 30 THEN 'HIGH_VOL' WHEN v > 20 THEN 'ELEVATED_VOL' ELSE 'RISK_ON' END"
FILL = (
    "SELECT date, last_value(VIX IGNORE NULLS) OVER (ORDER BY date) AS v, last_value(T10Y2Y IGNORE NULLS) OVER (ORDER BY date) AS s FROM macro_w"
)


@query("macro_regime_variants", with_ctes(
    "macro_w", f"SELECT date, CASE WHEN v IS NULL OR s IS NULL THEN 'UNKNOWN' WHEN s < 0 THEN 'RECESSION_WARNING' {BYVOL} AS alpha, "
    f"CASE WHEN s < 0 THEN 'RECESSION_WARNING' WHEN v IS NULL THEN 'UNKNOWN' {BYVOL} AS monitor, "
    "CASE WHEN v IS NULL OR s IS NULL THEN 'UNKNOWN' WHEN v > 30 AND s < -0.5 THEN 'RECESSION_WARNING' WHEN v > 30 THEN 'HIGH_VOL' WHEN v > 20 OR s < 0 THEN 'ELEVATED_VOL' ELSE 'RISK_ON' END AS accessor "
    "FROM f", f=FILL))
def macro_regime_variants(spark: SparkSession, root: str) -> DataFrame:
    d = R.daily_macro_regime(macro_from_orders(spark, root))
    return d.select("date", *[R.macro_regime("vix", "spread", v).alias(v) for v in ("alpha", "monitor", "accessor")])


LEVELS = {"RISK_ON": 0, "ELEVATED_VOL": 1, "HIGH_VOL": 2, "RECESSION_WARNING": 3, "UNKNOWN": -1}
SEV = "CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEVELS.items()) + " END"
ALERT_SQL = dict(
    f=FILL,
    dmr=f"SELECT *, CASE WHEN s < 0 THEN 'RECESSION_WARNING' WHEN v IS NULL THEN 'UNKNOWN' {BYVOL} AS regime FROM f",
    ch="SELECT * FROM (SELECT *, lag(regime) OVER (ORDER BY date) AS prev FROM dmr) WHERE prev <> regime",
    al=f"SELECT date, prev AS previous_regime, regime, CASE WHEN {SEV.format(x='regime')} > {SEV.format(x='prev')} AND regime IN ('HIGH_VOL', 'RECESSION_WARNING') THEN 'CRITICAL' "
    f"WHEN {SEV.format(x='regime')} > {SEV.format(x='prev')} AND regime = 'ELEVATED_VOL' THEN 'WARNING' ELSE 'INFO' END AS level FROM ch",
)


@query("regime_change_alerts", with_ctes("macro_w", "SELECT date, previous_regime, regime, level FROM al", **ALERT_SQL))
def regime_change_alerts(spark: SparkSession, root: str) -> DataFrame:
    a = R.regime_alerts(R.daily_macro_regime(macro_from_orders(spark, root)))
    return a.select("date", "previous_regime", "regime", "level")


@query("macro_regime_stats", with_ctes(
    "macro_w", "SELECT regime, count(*) AS n, round(count(*) / (SELECT count(*) FROM r), 6) AS share FROM r GROUP BY 1",
    f=FILL, r=f"SELECT CASE WHEN s < 0 THEN 'RECESSION_WARNING' WHEN v IS NULL THEN 'UNKNOWN' {BYVOL} AS regime FROM f ORDER BY date DESC LIMIT 252"))
def macro_regime_stats(spark: SparkSession, root: str) -> DataFrame:
    s = R.history_stats(R.daily_macro_regime(macro_from_orders(spark, root)), 252)
    return s.select("regime", "n", num("share").alias("share"))


# --- trend and volatility labels -----------------------------------------------------------------------------------


def indicators(spark: SparkSession, root: str) -> DataFrame:
    vix = macro_from_orders(spark, root).filter(F.col("indicator") == "VIX")
    return R.trend_indicators(benchmark_prices(bars_from_orders(spark, root), BENCH), vix)


def labels(spark: SparkSession, root: str) -> DataFrame:
    return R.hysteresis_labels(indicators(spark, root))


LABEL_SQL = dict(
    b1="SELECT date, close AS price FROM bars WHERE ticker = 'Brand#1'",
    ind="SELECT b1.date, price, CASE WHEN count(*) OVER w = 200 THEN avg(price) OVER w END AS ma, m.VIX AS vix FROM b1 "
    "ASOF LEFT JOIN (SELECT date AS md, VIX FROM macro_w) m ON b1.date >= m.md WINDOW w AS (ORDER BY b1.date ROWS 199 PRECEDING)",
    ok="SELECT * FROM ind WHERE ma IS NOT NULL AND vix IS NOT NULL",
    lab0="SELECT *, coalesce(last_value(CASE WHEN price < ma * 0.98 THEN 'downtrend' WHEN price > ma * 1.02 THEN 'uptrend' END IGNORE NULLS) OVER (ORDER BY date), "
    "CASE WHEN first_value(price >= ma) OVER (ORDER BY date) THEN 'uptrend' ELSE 'downtrend' END) AS trend, "
    "coalesce(last_value(CASE WHEN vix > 25 THEN 'high_vol' WHEN vix < 20 THEN 'low_vol' END IGNORE NULLS) OVER (ORDER BY date), 'low_vol') AS vol FROM ok",
    lab="SELECT *, trend || '_' || vol AS regime FROM lab0",
)


@query("regime_indicators", with_ctes("bars macro_w", f"SELECT date, {q_sig('price', 13)} AS price, {q_sig('ma', 13)} AS ma, {q_sig('vix', 13)} AS vix FROM ind",
                                      **{k: LABEL_SQL[k] for k in ("b1", "ind")}))
def regime_indicators(spark: SparkSession, root: str) -> DataFrame:
    return indicators(spark, root).select("date", *[sig(c, 13).alias(c) for c in ("price", "ma", "vix")])


@query("regime_label_history", with_ctes(
    "bars macro_w", "SELECT date, regime, trend, vol, coalesce(lag(regime) OVER (ORDER BY date) <> regime, TRUE) AS regime_changed FROM lab", **LABEL_SQL))
def regime_label_history(spark: SparkSession, root: str) -> DataFrame:
    return labels(spark, root).select("date", "regime", "trend", "vol", "regime_changed")


@query("regime_label_thresholds", with_ctes(
    "bars macro_w", "SELECT date, trend || '_' || vol AS regime FROM lab0",
    **{**{k: LABEL_SQL[k] for k in ("b1", "ind", "ok")}, "lab0": LABEL_SQL["lab0"].replace("0.98", "0.9").replace("1.02", "1.1").replace("> 25", "> 30").replace("< 20", "< 15")}))
def regime_label_thresholds(spark: SparkSession, root: str) -> DataFrame:
    """Same labels under a wider band and other volatility levels."""
    out = R.hysteresis_labels(indicators(spark, root), band=0.1, vix_high=30.0, vix_low=15.0)
    return out.select("date", "regime")


RS_SQL = dict(
    LABEL_SQL,
    j="SELECT r.ticker, l.regime, r.date, r.r FROM rets r JOIN lab l ON l.date = r.date WHERE r.r IS NOT NULL",
    g="SELECT *, product(1 + r) OVER (PARTITION BY ticker, regime ORDER BY date) AS cum FROM j",
    h="SELECT *, cum / max(cum) OVER (PARTITION BY ticker, regime ORDER BY date) - 1 AS dd FROM g",
    st0="SELECT ticker AS strategy_id, regime, arg_max(cum, date) - 1 AS total_return, stddev_samp(r) * sqrt(252) AS volatility, min(dd) AS max_drawdown, count(*) AS num_days FROM h GROUP BY 1, 2",
    st="SELECT *, num_days / sum(num_days) OVER (PARTITION BY strategy_id) AS pct, pow(1 + total_return, 252.0 / num_days) - 1 AS ann FROM st0",
)


@query("regime_strategy_stats", with_ctes(
    "rets macro_w", f"SELECT strategy_id, regime, {q_sig('total_return')} AS total_return, {q_sig('ann', 7)} AS annualized_return, {q_sig('volatility')} AS volatility, "
    f"{q_sig('CASE WHEN volatility > 0 THEN ann / volatility ELSE 0 END', 7)} AS sharpe_ratio, round(max_drawdown, 6) AS max_drawdown, num_days, round(pct, 6) AS pct_of_period FROM st WHERE num_days >= 5", **RS_SQL))
def regime_strategy_stats(spark: SparkSession, root: str) -> DataFrame:
    s = R.strategy_by_regime(strategies(spark, root), labels(spark, root))
    return s.select("strategy_id", "regime", sig("total_return").alias("total_return"), sig("annualized_return", 7).alias("annualized_return"),
                    sig("volatility").alias("volatility"), sig("sharpe_ratio", 7).alias("sharpe_ratio"), num("max_drawdown").alias("max_drawdown"),
                    "num_days", num("pct_of_period").alias("pct_of_period"))


@query("regime_best_strategy", with_ctes(
    "rets macro_w", f"SELECT regime, strategy_id AS strategy, {q_sig('score', 7)} AS score, num_days FROM (SELECT *, ann / volatility AS score, "
    "row_number() OVER (PARTITION BY regime ORDER BY ann / volatility DESC, strategy_id) AS k FROM st WHERE num_days >= 20) WHERE k = 1", **RS_SQL))
def regime_best_strategy(spark: SparkSession, root: str) -> DataFrame:
    b = R.best_by_regime(R.strategy_by_regime(strategies(spark, root), labels(spark, root)))
    return b.select("regime", "strategy", sig("score", 7).alias("score"), "num_days")


@query("regime_distribution", with_ctes(
    "bars macro_w", "SELECT regime, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lab GROUP BY 1", **LABEL_SQL))
def regime_distribution(spark: SparkSession, root: str) -> DataFrame:
    return R.distribution(labels(spark, root)).select("regime", "n", num("share").alias("share"))


REGIMES = ["uptrend_low_vol", "uptrend_high_vol", "downtrend_low_vol", "downtrend_high_vol"]


@query("regime_yearly_share", with_ctes(
    "bars macro_w", "SELECT CAST(year(date) AS BIGINT) AS year, " + ", ".join(f"round(100.0 * count(*) FILTER (regime = '{r}') / count(*), 6) AS {r}" for r in REGIMES)
    + " FROM lab GROUP BY 1", **LABEL_SQL))
def regime_yearly_share(spark: SparkSession, root: str) -> DataFrame:
    y = R.yearly_share(labels(spark, root), REGIMES)
    return y.select(F.col("year").cast("long").alias("year"), *[num(r).alias(r) for r in REGIMES])


@query("benchmark_returns_by_regime", with_ctes(
    "bars macro_w", f"SELECT regime, count(r) AS n, {q_sig('avg(r)')} AS mean_daily, {q_sig('stddev_samp(r)')} AS std_daily, {q_sig('avg(r) * 252 / (stddev_samp(r) * sqrt(252))')} AS sharpe FROM "
    "(SELECT *, price / lag(price) OVER (ORDER BY date) - 1 AS r FROM lab) GROUP BY 1", **LABEL_SQL))
def benchmark_returns_by_regime(spark: SparkSession, root: str) -> DataFrame:
    b = R.returns_by_regime(labels(spark, root))
    return b.select("regime", "n", *[sig(c).alias(c) for c in ("mean_daily", "std_daily", "sharpe")])


@query("regime_current", with_ctes(
    "bars macro_w", "SELECT date, regime, trend, vol, round((price / ma - 1) * 100, 6) AS price_vs_ma_pct FROM lab ORDER BY date DESC LIMIT 1", **LABEL_SQL))
def regime_current(spark: SparkSession, root: str) -> DataFrame:
    return R.current_summary(labels(spark, root)).select("date", "regime", "trend", "vol", num("price_vs_ma_pct").alias("price_vs_ma_pct"))


@query("regime_history_window", with_ctes(
    "bars macro_w", "SELECT date, regime FROM lab WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'", **LABEL_SQL))
def regime_history_window(spark: SparkSession, root: str) -> DataFrame:
    return asof.read_range(labels(spark, root), "1998-01-01", "1999-12-31").select("date", "regime")


# Initial regime -> strategy mapping and its fallback.
REGIME_STRATEGY = {
    "uptrend_low_vol": "momentum_acceleration",
    "uptrend_high_vol": "vol_adjusted_momentum",
    "downtrend_low_vol": "momentum",
    "downtrend_high_vol": "vol_adjusted_momentum",
}
FALLBACK = "momentum_acceleration"


def regimes_monthly(spark: SparkSession, root: str) -> DataFrame:
    return regimes_of(spark, root, schedule_days(START, END, "monthly"))


def regimes_of(spark: SparkSession, root: str, days: Column) -> DataFrame:
    lab = labels(spark, root).select(F.lit("m").alias("k"), "date", "regime")
    marks = asof.markers(literal_rows(spark, ["k"], [("m",)]), days)
    return asof.as_of(lab, marks, ["k"], ["regime"], inclusive=True).select("as_of", "regime")


MAP_SQL = dict(
    LABEL_SQL,
    rg="SELECT r.as_of, l.regime FROM rebal r ASOF LEFT JOIN lab l ON r.as_of >= l.date",
    st="SELECT as_of, regime, CASE regime " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REGIME_STRATEGY.items()) + f" ELSE '{FALLBACK}' END AS strategy FROM rg",
)


@query("regime_strategy_map", with_ctes("bars macro_w rebal", "SELECT as_of, regime, strategy FROM st", **MAP_SQL))
def regime_strategy_map(spark: SparkSession, root: str) -> DataFrame:
    return R.map_strategy(regimes_monthly(spark, root), REGIME_STRATEGY, FALLBACK).select("as_of", "regime", "strategy")


REB_SQL = dict(
    MODEL_SQL, **MAP_SQL,
    pk="SELECT s.as_of, s.ticker, st.regime, st.strategy, row_number() OVER (PARTITION BY s.as_of ORDER BY s.score DESC, s.ticker) AS k FROM scores s JOIN st ON st.as_of = s.as_of AND st.strategy = s.model WHERE s.score IS NOT NULL",
    tg="SELECT p.as_of, p.ticker, p.regime, p.strategy, 1.0 / count(*) OVER (PARTITION BY p.as_of) AS weight, px.price FROM pk p JOIN px ON px.as_of = p.as_of AND px.ticker = p.ticker WHERE k <= 5",
)


def _rebalance(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    sigs = [S.momentum(63, 50), S.vol_adjusted_momentum(63, 50), S.momentum_acceleration(21, 63, 50)]
    wide = S.score(bars_from_orders(spark, root), month_marks(spark, root), sigs)
    return regime_rebalance(
        S.to_scores(wide, MODELS), regimes_monthly(spark, root), REGIME_STRATEGY, FALLBACK, monthly(spark), wide.select("as_of", "ticker", "price")
    )


@query("regime_rebalance_targets", with_ctes(
    "rets px macro_w", f"SELECT as_of, ticker, regime, strategy, round(weight, 6) AS weight, {q_sig('weight * 100000 / price')} AS shares FROM tg", **REB_SQL))
def regime_rebalance_targets(spark: SparkSession, root: str) -> DataFrame:
    tgt, _ = _rebalance(spark, root)
    return tgt.select("as_of", "ticker", "regime", "strategy", num("weight").alias("weight"), sig("shares").alias("shares"))


@query("regime_rebalance_trades", with_ctes(
    "rets px macro_w",
    "SELECT as_of, count(*) FILTER (abs(ts - cs) >= 0.01) AS num_trades, round(coalesce(sum(abs((ts - cs) * price)) FILTER (abs(ts - cs) >= 0.01) / NULLIF(sum(abs((ts - cs) * price)), 0), 0), 6) AS turnover FROM "
    "(SELECT coalesce(t.as_of, c.as_of) AS as_of, coalesce(t.shares, 0) AS ts, coalesce(c.shares, 0) AS cs, coalesce(t.price, c.price) AS price FROM th t FULL JOIN "
    "(SELECT r.next_as_of AS as_of, ticker, shares, price FROM th JOIN rebal r USING (as_of) WHERE r.next_as_of IS NOT NULL) c ON c.as_of = t.as_of AND c.ticker = t.ticker) GROUP BY 1",
    **REB_SQL, th="SELECT as_of, ticker, weight * 100000 / price AS shares, price FROM tg"))
def regime_rebalance_trades(spark: SparkSession, root: str) -> DataFrame:
    _, trades = _rebalance(spark, root)
    return rebalance_summary(trades).select("as_of", "num_trades", num("turnover").alias("turnover"))

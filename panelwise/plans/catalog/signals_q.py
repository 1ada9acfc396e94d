"""Registered queries: signals, weights, value curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwise.functions.dates import schedule_days, schedule_table
from panelwise.functions.exprs import num, sig
from panelwise.operators import accounting, asof, construction, ensembles as E, regimes as R, signals as S
from panelwise.operators.returns import benchmark_returns, daily_returns
from panelwise.operators.schedule_defaults import END, START
from panelwise.plans.registry import SQL, query
from panelwise.plans.sqlkit import bnum, sig as q_sig, with_ctes
from panelwise.sources.panel import bars_from_orders, macro_from_orders, members_from_orders

BENCH = "Brand#1"
LOOKBACK, MIN_PERIODS = 63, 50


def month_marks(spark: SparkSession, root: str) -> DataFrame:
    return asof.markers(members_from_orders(spark, root), schedule_days(START, END, "monthly"))


def momentum_scores_wide(spark: SparkSession, root: str) -> DataFrame:
    wide = S.score(bars_from_orders(spark, root), month_marks(spark, root), [S.momentum(LOOKBACK, MIN_PERIODS, "score")])
    return wide.select("as_of", "ticker", "score")


def momentum_weights(spark: SparkSession, root: str, min_periods: int = MIN_PERIODS, top_n: int = 5) -> DataFrame:
    bars = bars_from_orders(spark, root)
    wide = S.score(bars, month_marks(spark, root), [S.momentum(LOOKBACK, min_periods)])
    scored = accounting.forward_growth(wide).withColumn("strategy_id", F.lit("momentum"))
    return construction.top_n_equal_weight(
        scored, top_n, ["strategy_id", "as_of"], score="momentum", carry=("price", "growth")
    )


def flagship(spark: SparkSession, root: str) -> DataFrame:
    w = momentum_weights(spark, root, min_periods=10)
    curve = accounting.periodic_value(w, schedule_table(spark, schedule_days(START, END, "monthly")))
    return accounting.run_summary(curve)


def span_sql(rows: int, days: int, min_periods: int, out: str = "score") -> str:
    """Momentum by a plain range join: the check does not share the running-frame plan."""
    return (
        f"SELECT ticker, as_of, CASE WHEN max(n) >= {min_periods} AND count(*) >= 2 THEN "
        f"arg_max(close, date) / arg_min(close, date) - 1 END AS {out} FROM (SELECT m.ticker, r.as_of, b.close, b.date, "
        "row_number() OVER (PARTITION BY m.ticker, r.as_of ORDER BY b.date DESC) AS k, "
        "count(*) OVER (PARTITION BY m.ticker, r.as_of) AS n "
        "FROM members m CROSS JOIN rebal r JOIN bars b ON b.ticker = m.ticker AND b.date < r.as_of "
        f"AND b.date >= r.as_of - {days}) WHERE k <= {rows} GROUP BY 1, 2"
    )


MOM_SQL = span_sql(LOOKBACK, LOOKBACK + 50, MIN_PERIODS)
GRID = "SELECT m.ticker, r.as_of, s.score FROM members m CROSS JOIN rebal r LEFT JOIN s USING (ticker, as_of)"


@query("momentum_scores", with_ctes("bars members rebal", f"SELECT ticker, as_of, {q_sig('score')} AS score FROM g", s=MOM_SQL, g=GRID))
def momentum_scores(spark: SparkSession, root: str) -> DataFrame:
    wide = S.score(bars_from_orders(spark, root), month_marks(spark, root), [S.momentum(LOOKBACK, MIN_PERIODS)])
    return wide.select("ticker", "as_of", sig("momentum").alias("score"))


@query("momentum_scores_in_rows", with_ctes(
    "bars members rebal", f"SELECT ticker, as_of, {q_sig('score')} AS score FROM g", s=span_sql(LOOKBACK, 100_000, MIN_PERIODS), g=GRID))
def momentum_scores_in_rows(spark: SparkSession, root: str) -> DataFrame:
    """Momentum over a number of rows, however many calendar days they span."""
    wide = S.score(bars_from_orders(spark, root), month_marks(spark, root), [S.in_rows(S.momentum(LOOKBACK, MIN_PERIODS))])
    return wide.select("ticker", "as_of", sig("momentum").alias("score"))


WEIGHTS_SQL = dict(
    s=MOM_SQL,
    g=GRID,
    rk="SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY score DESC NULLS LAST, ticker) AS k FROM g",
    w="SELECT as_of, ticker, CAST(0.2 AS DOUBLE) AS weight FROM rk WHERE k <= 5 AND score IS NOT NULL UNION ALL "
    "SELECT as_of, '$CASH$', 1 - CAST(0.2 AS DOUBLE) * count(score) FROM rk WHERE k <= 5 GROUP BY 1 HAVING count(score) < 5",
    pxn="SELECT *, lead(price) OVER (PARTITION BY ticker ORDER BY as_of) / price AS growth FROM px",
    aw="SELECT r.as_of, r.seq, r.next_as_of, w.ticker, w.weight FROM rebal r JOIN w USING (as_of)",
    prev="SELECT next_as_of AS as_of, ticker, weight FROM aw WHERE next_as_of IS NOT NULL UNION ALL "
    "SELECT min(as_of), '$CASH$', CAST(1.0 AS DOUBLE) FROM rebal",
    pair="SELECT coalesce(a.as_of, p.as_of) AS as_of, coalesce(a.ticker, p.ticker) AS ticker, "
    "coalesce(p.weight, 0) AS prev_w, coalesce(a.weight, 0) AS next_w FROM aw a FULL JOIN prev p "
    "ON a.as_of = p.as_of AND a.ticker = p.ticker",
    turn="SELECT as_of, 0.5 * sum(abs(next_w - prev_w)) AS turnover FROM pair GROUP BY 1",
    gross="SELECT a.next_as_of AS as_of, sum(a.weight * CASE WHEN a.ticker = '$CASH$' THEN 1 ELSE p.growth END) AS gross "
    "FROM aw a LEFT JOIN pxn p ON a.as_of = p.as_of AND a.ticker = p.ticker GROUP BY 1",
    curve0="SELECT t.as_of, turnover, 100000 * product(coalesce(gross, 1) * (1 - turnover * 0.001)) OVER (ORDER BY t.as_of) AS nav, "
    "coalesce(gross, 1) AS gross FROM turn t LEFT JOIN gross g ON t.as_of = g.as_of",
    curve="SELECT as_of, turnover, nav, coalesce(lag(nav) OVER (ORDER BY as_of), 100000) * gross * turnover * 0.001 AS cost, "
    "nav / lag(nav) OVER (ORDER BY as_of) - 1 AS returns FROM curve0",
)


@query(
    "momentum_backtest",
    with_ctes(
        "px",
        f"SELECT 'momentum' AS strategy_id, as_of, {q_sig('nav')} AS nav, {q_sig('cost')} AS cost, "
        f"round(turnover, 6) AS turnover, {q_sig('returns')} AS returns FROM curve",
        **WEIGHTS_SQL,
    ),
)
def momentum_backtest(spark: SparkSession, root: str) -> DataFrame:
    w = momentum_weights(spark, root)
    c = accounting.periodic_value(w, schedule_table(spark, schedule_days(START, END, "monthly")))
    return c.select("strategy_id", "as_of", sig("nav").alias("nav"), sig("cost").alias("cost"),
                    num("turnover").alias("turnover"), sig("returns").alias("returns"))


# --- other signals -------------------------------------------------------------------------------------------------


def _score_sql(body: str, names: str = "bars members rebal", score: str = q_sig("score"), **ctes: str) -> str:
    """Every member at every date, with the scores of ``s`` where they exist."""
    return with_ctes(names, f"SELECT m.ticker, r.as_of, {score} AS score FROM members m CROSS JOIN rebal r LEFT JOIN s USING (ticker, as_of)", **ctes, s=body)


def _window_sql(days: int) -> str:
    """Rows of every lookback window with their age ``k`` (1 = newest) and the window size ``n``."""
    return (
        "SELECT m.ticker, r.as_of, b.close, b.date, b.r, "
        "row_number() OVER (PARTITION BY m.ticker, r.as_of ORDER BY b.date DESC) AS k, "
        "count(*) OVER (PARTITION BY m.ticker, r.as_of) AS n "
        "FROM members m CROSS JOIN rebal r JOIN rets b ON b.ticker = m.ticker AND b.date < r.as_of "
        f"AND b.date >= r.as_of - {days}"
    )


def _ret(rows: int) -> str:
    return f"(max(close) FILTER (k = 1) / max(close) FILTER (k = least(n, {rows})) - 1)"


def _scored(spark: SparkSession, root: str, signal: S.Signal) -> DataFrame:
    bars = bars_from_orders(spark, root)
    bench = benchmark_returns(bars, BENCH) if signal.needs_benchmark else None
    return S.score(bars, month_marks(spark, root), [signal], bench)


@query("momentum_acceleration_scores", _score_sql(
    f"SELECT ticker, as_of, CASE WHEN max(n) >= 50 THEN {_ret(21)} - {_ret(63)} END AS score FROM w GROUP BY 1, 2",
    "rets members rebal", w=_window_sql(113), score="round(score, 6)"))
def momentum_acceleration_scores(spark: SparkSession, root: str) -> DataFrame:
    df = _scored(spark, root, S.momentum_acceleration(21, 63, 50))
    return df.select("ticker", "as_of", num("momentum_acceleration").alias("score"))


@query("vol_adjusted_momentum_scores", _score_sql(
    f"SELECT ticker, as_of, CASE WHEN max(n) >= 50 AND count(r) FILTER (k < least(n, 63)) >= 10 THEN {_ret(63)} / "
    "greatest(stddev_samp(r) FILTER (k < least(n, 63)) * sqrt(252), 0.01) END AS score FROM w GROUP BY 1, 2",
    "rets members rebal", w=_window_sql(113)))
def vol_adjusted_momentum_scores(spark: SparkSession, root: str) -> DataFrame:
    df = _scored(spark, root, S.vol_adjusted_momentum(63, 50))
    return df.select("ticker", "as_of", sig("vol_adjusted_momentum").alias("score"))


@query("residual_momentum_scores", _score_sql(
    "SELECT w.ticker, w.as_of, CASE WHEN w.ticker <> 'Brand#1' AND regr_count(w.r, b.r) >= 50 THEN "
    "regr_intercept(w.r, b.r) * regr_count(w.r, b.r) END AS score FROM w JOIN bench b ON w.date = b.date "
    "WHERE w.k < w.n GROUP BY 1, 2",
    "bench members rebal", w=_window_sql(176), score="round(score, 6)"))
def residual_momentum_scores(spark: SparkSession, root: str) -> DataFrame:
    df = _scored(spark, root, S.residual_momentum(126, 50, BENCH))
    return df.select("ticker", "as_of", num("residual_momentum").alias("score"))


TREND_SQL = (
    "SELECT as_of, CASE WHEN count(*) = 100 THEN arg_max(close, date) > avg(close) ELSE TRUE END AS bullish FROM "
    "(SELECT r.as_of, b.close, b.date, row_number() OVER (PARTITION BY r.as_of ORDER BY b.date DESC) AS k "
    "FROM rebal r LEFT JOIN bars b ON b.ticker = 'Brand#1' AND b.date < r.as_of) WHERE k <= 100 GROUP BY 1"
)
SAFE = ("Brand#2", "Brand#3", "Brand#4")
SAFE_SQL = "('Brand#2', 'Brand#3', 'Brand#4')"


@query("trend_regime_flags", with_ctes(
    "bars rebal", "SELECT as_of, CASE WHEN bullish THEN 'BULLISH' ELSE 'DEFENSIVE' END AS regime FROM t", t=TREND_SQL))
def trend_regime_flags(spark: SparkSession, root: str) -> DataFrame:
    flags = S.trend_flag(bars_from_orders(spark, root), month_marks(spark, root), BENCH, 100)
    return flags.select("as_of", F.when(F.col("bullish"), "BULLISH").otherwise("DEFENSIVE").alias("regime"))


def trend_filtered_wide(spark: SparkSession, root: str) -> DataFrame:
    bars, marks = bars_from_orders(spark, root), month_marks(spark, root)
    wide = S.score(bars, marks, [S.momentum(63, 50, "trend_filtered_momentum", read_days=150)])
    return S.trend_filtered(wide, S.trend_flag(bars, marks, BENCH, 100), "trend_filtered_momentum", SAFE)


@query("trend_filtered_momentum_scores", with_ctes(
    "bars members rebal",
    f"SELECT m.ticker, r.as_of, CASE WHEN t.bullish THEN {q_sig('s.score')} WHEN m.ticker IN {SAFE_SQL} THEN 1.0 ELSE 0.0 END AS score "
    "FROM members m CROSS JOIN rebal r LEFT JOIN s USING (ticker, as_of) JOIN t USING (as_of)",
    s=span_sql(63, 150, 50), t=TREND_SQL))
def trend_filtered_momentum_scores(spark: SparkSession, root: str) -> DataFrame:
    return trend_filtered_wide(spark, root).select("ticker", "as_of", sig("trend_filtered_momentum").alias("score"))


@query("dual_momentum_scores", with_ctes(
    "bars members rebal",
    f"SELECT ticker, as_of, CASE WHEN on_ THEN (CASE WHEN pass THEN {q_sig('score')} ELSE 0.0 END) WHEN ticker IN {SAFE_SQL} THEN 1.0 "
    "ELSE 0.0 END AS score, CASE WHEN on_ THEN 'MOMENTUM' ELSE 'SAFE' END AS signal_type FROM "
    "(SELECT *, coalesce(bool_or(pass) OVER (PARTITION BY as_of), FALSE) AS on_ FROM p)",
    s=MOM_SQL, g=GRID, p=f"SELECT *, coalesce(score > 0.02 * 63 / 252, FALSE) AND ticker NOT IN {SAFE_SQL} AS pass FROM g"))
def dual_momentum_scores(spark: SparkSession, root: str) -> DataFrame:
    wide = _scored(spark, root, S.momentum(63, 50, "score"))
    out = S.dual_momentum(wide, "score", 63, 0.02, SAFE)
    return out.select("ticker", "as_of", sig("score").alias("score"), "signal_type")


@query("value_momentum_components", with_ctes(
    "bars members rebal",
    "SELECT ticker, as_of, round(momentum_z, 7) AS momentum_z, round(value_z, 7) AS value_z, "
    "round(0.3 * momentum_z + 0.7 * value_z, 7) AS blended FROM (SELECT *, "
    "(mom - avg(mom) OVER d) / NULLIF(stddev_samp(mom) OVER d, 0) AS momentum_z, "
    "(avg(val) OVER d - val) / NULLIF(stddev_samp(val) OVER d, 0) AS value_z "
    "FROM members m CROSS JOIN rebal r LEFT JOIN s1 USING (ticker, as_of) LEFT JOIN s2 USING (ticker, as_of) "
    "WINDOW d AS (PARTITION BY as_of))",
    s1=span_sql(63, 176, 50, "mom"), s2=span_sql(126, 176, 50, "val")))
def value_momentum_components(spark: SparkSession, root: str) -> DataFrame:
    bars = bars_from_orders(spark, root)
    wide = S.score(bars, month_marks(spark, root), [S.momentum(63, 50, "mom", 176), S.momentum(126, 50, "val", 176)])
    out = S.value_momentum(wide, "mom", "val", 0.3, 0.7)
    return out.select("ticker", "as_of", num("momentum_z", 7).alias("momentum_z"), num("value_z", 7).alias("value_z"),
                      num("blended", 7).alias("blended"))


@query("basic_features")
def basic_features(spark: SparkSession, root: str) -> DataFrame:
    rets = daily_returns(bars_from_orders(spark, root))
    f = S.business_window_features(rets, month_marks(spark, root))
    return f.select("ticker", "as_of", num("momentum").alias("momentum"), num("vol").alias("vol"))


FEATURES_SQL = with_ctes(
    "rets members rebal",
    f"SELECT m.ticker, r.as_of, round(coalesce(product(1 + x.r) FILTER (x.bi >= r.bi - 131 AND x.bi <= r.bi - 5), 1) - 1, 6) AS momentum, "
    "round(stddev_samp(x.r) FILTER (x.bi >= r.bi - 60), 6) AS vol FROM members m CROSS JOIN rb0 r "
    "LEFT JOIN rb x ON x.ticker = m.ticker AND x.bi BETWEEN r.bi - 131 AND r.bi GROUP BY 1, 2",
    rb=f"SELECT ticker, {bnum('date')} AS bi, r FROM rets WHERE r IS NOT NULL",
    rb0=f"SELECT as_of, {bnum('as_of')} AS bi FROM rebal")
SQL["basic_features"] = FEATURES_SQL


@query("feature_signal_scores", f"SELECT ticker, as_of, momentum AS score FROM ({FEATURES_SQL})")
def feature_signal_scores(spark: SparkSession, root: str) -> DataFrame:
    """A signal that is a precomputed feature column."""
    return basic_features(spark, root).select("ticker", "as_of", F.col("momentum").alias("score"))


# --- ensembles and regime selection --------------------------------------------------------------------------------

MODELS = ("momentum", "vol_adjusted_momentum", "momentum_acceleration")
MODEL_SQL = dict(
    w=_window_sql(113),
    sc="SELECT ticker, as_of, unnest(['momentum', 'vol_adjusted_momentum', 'momentum_acceleration']) AS model, "
    f"unnest([CASE WHEN max(n) >= 50 THEN {_ret(63)} END, "
    f"CASE WHEN max(n) >= 50 AND count(r) FILTER (k < least(n, 63)) >= 10 THEN {_ret(63)} / "
    "greatest(stddev_samp(r) FILTER (k < least(n, 63)) * sqrt(252), 0.01) END, "
    f"CASE WHEN max(n) >= 50 THEN {_ret(21)} - {_ret(63)} END]) AS score FROM w GROUP BY 1, 2",
    scores="SELECT m.ticker, r.as_of, k.model, s.score FROM members m CROSS JOIN rebal r CROSS JOIN "
    "(SELECT unnest(['momentum', 'vol_adjusted_momentum', 'momentum_acceleration']) AS model) k "
    "LEFT JOIN sc s ON s.ticker = m.ticker AND s.as_of = r.as_of AND s.model = k.model",
)


def model_scores(spark: SparkSession, root: str) -> DataFrame:
    """Three models from one pass, in long form."""
    sigs = [S.momentum(63, 50), S.vol_adjusted_momentum(63, 50), S.momentum_acceleration(21, 63, 50)]
    wide = S.score(bars_from_orders(spark, root), month_marks(spark, root), sigs)
    return S.to_scores(wide, MODELS)


@query("model_scores_long", with_ctes(
    "rets members rebal", f"SELECT ticker, as_of, model, round(score, 6) AS score FROM scores", **MODEL_SQL))
def model_scores_long(spark: SparkSession, root: str) -> DataFrame:
    return model_scores(spark, root).select("ticker", "as_of", "model", num("score").alias("score"))


@query("weighted_ensemble_scores", with_ctes(
    "rets members rebal",
    "SELECT ticker, as_of, round(sum(score * CASE model WHEN 'momentum' THEN 0.5 WHEN 'vol_adjusted_momentum' THEN 0.3 "
    "ELSE 0.2 END), 6) AS score FROM scores GROUP BY 1, 2", **MODEL_SQL))
def weighted_ensemble_scores(spark: SparkSession, root: str) -> DataFrame:
    out = E.weighted_ensemble(
        model_scores(spark, root), {"momentum": 0.5, "vol_adjusted_momentum": 0.3, "momentum_acceleration": 0.2}
    )
    return out.select("ticker", "as_of", num("score").alias("score"))


def regimes_at(spark: SparkSession, root: str, variant: str = "alpha") -> DataFrame:
    at = R.macro_as_of(macro_from_orders(spark, root), schedule_days(START, END, "monthly"), {"vix": "VIX", "spread": "T10Y2Y"})
    return at.select("as_of", R.macro_regime("vix", "spread", variant).alias("regime"))


REGIME_SQL = (
    "SELECT as_of, CASE WHEN VIX IS NULL OR T10Y2Y IS NULL THEN 'UNKNOWN' WHEN T10Y2Y < 0 THEN 'RECESSION_WARNING' "
    "WHEN VIX > 30 THEN 'HIGH_VOL' WHEN VIX > 20 THEN 'ELEVATED_VOL' ELSE 'RISK_ON' END AS regime FROM macro_at"
)
# The selector configuration of the registered queries.
BASED = {"type": "regime_based", "default": "momentum", "regime_models": {
    "RISK_ON": "momentum", "ELEVATED_VOL": "vol_adjusted_momentum", "RECESSION_WARNING": "momentum_acceleration"}}
WEIGHTED = {"type": "regime_weighted", "default": {"momentum": 1.0, "vol_adjusted_momentum": 1.0}, "regime_weights": {
    "RISK_ON": {"momentum": 3.0, "momentum_acceleration": 1.0},
    "RECESSION_WARNING": {"vol_adjusted_momentum": 1.0}}}
BASED_SQL = (
    "SELECT as_of, regime, CASE regime WHEN 'RISK_ON' THEN 'momentum' WHEN 'ELEVATED_VOL' THEN 'vol_adjusted_momentum' "
    "WHEN 'RECESSION_WARNING' THEN 'momentum_acceleration' ELSE 'momentum' END AS model, 1.0 AS share FROM rg"
)
WEIGHTED_SQL = (
    "SELECT as_of, regime, t.model, t.share FROM rg JOIN (VALUES ('RISK_ON', 'momentum', 0.75), "
    "('RISK_ON', 'momentum_acceleration', 0.25), ('RECESSION_WARNING', 'vol_adjusted_momentum', 1.0), "
    "('*', 'momentum', 0.5), ('*', 'vol_adjusted_momentum', 0.5)) t(key, model, share) "
    "ON t.key = CASE WHEN rg.regime IN ('RISK_ON', 'RECESSION_WARNING') THEN rg.regime ELSE '*' END"
)


def _selection(spark: SparkSession, root: str, config: dict) -> DataFrame:
    return E.select_models(regimes_at(spark, root), E.selector_from_config(spark, config))


@query("regime_based_selection", with_ctes("macro_at", f"SELECT as_of, regime, model FROM ({BASED_SQL})", rg=REGIME_SQL))
def regime_based_selection(spark: SparkSession, root: str) -> DataFrame:
    return _selection(spark, root, BASED).select("as_of", "regime", "model")


@query("regime_weighted_selection", with_ctes(
    "macro_at", f"SELECT as_of, regime, model, round(CAST(share AS DOUBLE), 6) AS share FROM ({WEIGHTED_SQL})", rg=REGIME_SQL))
def regime_weighted_selection(spark: SparkSession, root: str) -> DataFrame:
    return _selection(spark, root, WEIGHTED).select("as_of", "regime", "model", num("share").alias("share"))


def _selected_sql(sel: str) -> str:
    return with_ctes(
        "rets members rebal macro_at",
        f"SELECT s.ticker, s.as_of, any_value(sl.regime) AS regime, round(CASE WHEN count(*) > 1 THEN coalesce(sum(s.score * sl.share), 0) ELSE sum(s.score * sl.share) END, 6) AS score "
        "FROM scores s JOIN sl ON sl.as_of = s.as_of AND sl.model = s.model GROUP BY 1, 2",
        **MODEL_SQL, rg=REGIME_SQL, sl=sel)


@query("regime_selected_scores", _selected_sql(BASED_SQL))
def regime_selected_scores(spark: SparkSession, root: str) -> DataFrame:
    out = E.apply_selection(model_scores(spark, root), _selection(spark, root, BASED))
    return out.select("ticker", "as_of", "regime", num("score").alias("score"))


@query("regime_aware_scores", _selected_sql(WEIGHTED_SQL))
def regime_aware_scores(spark: SparkSession, root: str) -> DataFrame:
    out = E.apply_selection(model_scores(spark, root), _selection(spark, root, WEIGHTED))
    return out.select("ticker", "as_of", "regime", num("score").alias("score"))


@query("regime_aware_history", with_ctes(
    "macro_at",
    "SELECT as_of, any_value(regime) AS regime, CASE WHEN count(*) = 1 THEN 'model=' || max(model) ELSE 'ensemble=[' || "
    "string_agg(model || ':' || CAST(CAST(round(share * 100) AS INTEGER) AS VARCHAR) || '%', ', ' ORDER BY model) || ']' END AS selection "
    f"FROM ({WEIGHTED_SQL}) GROUP BY as_of", rg=REGIME_SQL))
def regime_aware_history(spark: SparkSession, root: str) -> DataFrame:
    return E.selection_history(_selection(spark, root, WEIGHTED))


@query("regime_selection_stats", with_ctes("macro_at", "SELECT regime, count(*) AS n FROM rg GROUP BY 1", rg=REGIME_SQL))
def regime_selection_stats(spark: SparkSession, root: str) -> DataFrame:
    return E.selection_stats(_selection(spark, root, WEIGHTED))

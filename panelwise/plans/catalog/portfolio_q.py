"""Registered queries: construction, costs, overlays, trades, calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelwise import CASH
from panelwise.functions.dates import every_n_bdays, is_rebalance_day, schedule_days, schedule_table
from panelwise.functions.exprs import literal_rows, num, sig
from panelwise.functions.joins import DAYS, bounded
from panelwise.operators import accounting, construction, costs, overlays, pairwise, regimes as R, trades as T
from panelwise.operators.calendar import next_rebalance
from panelwise.operators.returns import daily_returns
from panelwise.operators.schedule_defaults import END, START
from panelwise.plans.catalog.signals_q import MOM_SQL, GRID, SAFE, WEIGHTS_SQL, momentum_weights, momentum_scores_wide
from panelwise.plans.production import production_run, regime_rebalance
from panelwise.plans.registry import query
from panelwise.plans.sqlkit import bnum, sig as q_sig, with_ctes
from panelwise.sources.panel import bars_from_orders, macro_from_orders, reference_from_orders
from panelwise.sources.storage import durable

WSQL = {k: WEIGHTS_SQL[k] for k in ("s", "g", "rk", "w")}
PSQL = {k: WEIGHTS_SQL[k] for k in ("s", "g", "rk", "w", "aw", "prev", "pair")}
CSQL = {k: v for k, v in WEIGHTS_SQL.items()}


def monthly(spark: SparkSession) -> DataFrame:
    return schedule_table(spark, schedule_days(START, END, "monthly"))


def pairs(spark: SparkSession, root: str) -> DataFrame:
    return construction.paired(momentum_weights(spark, root), monthly(spark))


@query("top_n_weights", with_ctes("bars members rebal", "SELECT as_of, ticker, round(weight, 6) AS weight FROM w", **WSQL))
def top_n_weights(spark: SparkSession, root: str) -> DataFrame:
    return momentum_weights(spark, root).select("as_of", "ticker", num("weight").alias("weight"))


@query("top_x_clipped_weights", with_ctes(
    "bars members rebal",
    "SELECT as_of, ticker, round(c / sum(c) OVER (PARTITION BY as_of), 6) AS weight FROM "
    "(SELECT as_of, ticker, least(1.0 / count(*) OVER (PARTITION BY as_of), CAST(0.2 AS DOUBLE)) AS c FROM rk WHERE k <= 4 AND score IS NOT NULL)",
    **{k: WSQL[k] for k in ("s", "g", "rk")}))
def top_x_clipped_weights(spark: SparkSession, root: str) -> DataFrame:
    out = construction.top_x_fully_invested(momentum_scores_wide(spark, root), 4, ["as_of"], 0.0, 0.2)
    return out.select("as_of", "ticker", num("weight").alias("weight"))


@query("weight_turnover", with_ctes(
    "bars members rebal", "SELECT as_of, round(0.5 * sum(abs(next_w - prev_w)), 6) AS turnover FROM pair GROUP BY 1", **PSQL))
def weight_turnover(spark: SparkSession, root: str) -> DataFrame:
    return construction.turnover(pairs(spark, root)).select("as_of", num("turnover").alias("turnover"))


def _cost_sql(cost: str) -> str:
    return with_ctes(
        "bars members rebal",
        f"SELECT as_of, round(coalesce({cost}, 0), 9) AS cost FROM (SELECT *, abs(next_w - prev_w) AS mv, "
        "CASE ticker WHEN 'Brand#1' THEN 1.0 WHEN 'Brand#2' THEN 2.0 WHEN 'Brand#3' THEN 15.0 ELSE 10.0 END AS sp FROM pair) GROUP BY 1",
        **PSQL)


@query("cost_flat", _cost_sql("0.5 * sum(mv) * 0.001"))
def cost_flat(spark: SparkSession, root: str) -> DataFrame:
    return costs.flat(pairs(spark, root)).select("as_of", num("cost", 9).alias("cost"))


@query("cost_slippage", _cost_sql("sum((5.0 + mv * 200) * mv) / NULLIF(sum(mv), 0) / 10000"))
def cost_slippage(spark: SparkSession, root: str) -> DataFrame:
    return costs.slippage(pairs(spark, root)).select("as_of", num("cost", 9).alias("cost"))


@query("cost_spread", _cost_sql("sum(sp * mv) / NULLIF(sum(mv), 0) / 10000"))
def cost_spread(spark: SparkSession, root: str) -> DataFrame:
    table = literal_rows(spark, ["ticker", "spread_bps"], [("Brand#1", 1.0), ("Brand#2", 2.0), ("Brand#3", 15.0)])
    return costs.spread(pairs(spark, root), table).select("as_of", num("cost", 9).alias("cost"))


@query("cost_impact", _cost_sql("sum(5 * sqrt(mv) * mv) / NULLIF(sum(mv), 0) / 10000"))
def cost_impact(spark: SparkSession, root: str) -> DataFrame:
    return costs.impact(pairs(spark, root)).select("as_of", num("cost", 9).alias("cost"))


@query("holdings_history", with_ctes(
    "px", f"SELECT w.as_of, w.ticker, {q_sig('w.weight * nav')} AS notional, "
    f"{q_sig('w.weight * nav / CASE WHEN w.ticker = {c} THEN 1 ELSE price END').replace('{c}', chr(39) + CASH + chr(39))} AS shares "
    "FROM w JOIN curve USING (as_of) LEFT JOIN px ON px.as_of = w.as_of AND px.ticker = w.ticker", **CSQL))
def holdings_history(spark: SparkSession, root: str) -> DataFrame:
    w = momentum_weights(spark, root)
    h = accounting.holdings(w, accounting.periodic_value(w, monthly(spark)))
    return h.select("as_of", "ticker", sig("notional").alias("notional"), sig("shares").alias("shares"))


@query("backtest_summary", with_ctes(
    "px", f"SELECT {q_sig('arg_max(nav, as_of) / 100000 - 1')} AS total_return, round(coalesce(avg(returns) / NULLIF(stddev_samp(returns), 0) * sqrt(12), 0), 6) AS sharpe_ratio, "
    f"round(min(dd), 6) AS max_drawdown, {q_sig('sum(cost)')} AS total_costs, count(*) AS num_rebalances FROM "
    "(SELECT *, nav / max(nav) OVER (ORDER BY as_of) - 1 AS dd FROM curve)", **CSQL))
def backtest_summary(spark: SparkSession, root: str) -> DataFrame:
    s = accounting.run_summary(accounting.periodic_value(momentum_weights(spark, root), monthly(spark)))
    return s.select(sig("total_return").alias("total_return"), num("sharpe_ratio").alias("sharpe_ratio"),
                    num("max_drawdown").alias("max_drawdown"), sig("total_costs").alias("total_costs"), "num_rebalances")


@query("ewma_covariance", with_ctes(
    "rets rebal",
    "SELECT a.as_of, a.ticker AS i, b.ticker AS j, round(sum(a.w * a.r * b.r) - any_value(ma.mu) * any_value(mb.mu), 6) AS cov "
    "FROM x a JOIN x b ON a.as_of = b.as_of AND a.date = b.date AND a.ticker <= b.ticker "
    "JOIN mu ma ON ma.as_of = a.as_of AND ma.ticker = a.ticker JOIN mu mb ON mb.as_of = b.as_of AND mb.ticker = b.ticker GROUP BY 1, 2, 3",
    d=f"SELECT r.as_of, t.date FROM rebal r JOIN (SELECT DISTINCT date FROM rets WHERE r IS NOT NULL) t ON t.date <= r.as_of AND {bnum('t.date')} >= {bnum('r.as_of')} - 252",
    dw="SELECT as_of, date, p / sum(p) OVER (PARTITION BY as_of) AS w FROM (SELECT *, pow(0.5, (row_number() OVER (PARTITION BY as_of ORDER BY date DESC) - 1) / 60.0) AS p FROM d)",
    x="SELECT dw.as_of, dw.date, dw.w, r.ticker, r.r FROM dw JOIN rets r ON r.date = dw.date WHERE r.r IS NOT NULL",
    mu="SELECT as_of, ticker, sum(w * r) AS mu FROM x GROUP BY 1, 2"))
def ewma_covariance(spark: SparkSession, root: str) -> DataFrame:
    c = pairwise.ewma_covariance(daily_returns(bars_from_orders(spark, root)), schedule_days(START, END, "monthly"))
    return c.select("as_of", "i", "j", num("cov").alias("cov"))


@query("one_hot_exposures", with_ctes("reference", "SELECT DISTINCT ticker, sector AS category, CAST(1.0 AS DOUBLE) AS exposure FROM reference"))
def one_hot_exposures(spark: SparkSession, root: str) -> DataFrame:
    """A row for each category a ticker is in, so the schema doesn't depend on the data."""
    return T.exposures_long(reference_from_orders(spark, root), "sector")


# --- overlays ------------------------------------------------------------------------------------------------------

VOL_SQL = dict(
    CSQL,
    pr="SELECT w.as_of, x.date, sum(w.weight * x.r) AS r FROM w JOIN rets x ON x.ticker = w.ticker AND x.date < w.as_of "
    "AND x.prev_date >= w.as_of - 60 WHERE w.weight > 0 GROUP BY 1, 2",
    vol="SELECT as_of, sqrt(sum(p * r * r) / sum(p) * 252) AS vol, count(*) AS n FROM (SELECT *, pow(0.5, "
    "(row_number() OVER (PARTITION BY as_of ORDER BY date DESC) - 1) / 20.0) AS p FROM pr) GROUP BY 1",
)


@query("overlay_volatility_target", with_ctes(
    "px rets", "SELECT w.as_of, w.ticker, round(w.weight * sc, 6) AS weight, round(sc, 6) AS scale_factor, round(vol, 6) AS realized_vol FROM "
    "(SELECT w.*, vol, CASE WHEN coalesce(n, 0) < 20 THEN 1.0 WHEN vol < 0.01 THEN 1.0 ELSE least(greatest(0.15 / vol, 0.25), 1.5) END AS sc "
    "FROM w LEFT JOIN vol USING (as_of)) w", **VOL_SQL))
def overlay_volatility_target(spark: SparkSession, root: str) -> DataFrame:
    o = overlays.volatility_target(momentum_weights(spark, root), daily_returns(bars_from_orders(spark, root)))
    return o.select("as_of", "ticker", num("weight").alias("weight"), num("scale_factor").alias("scale_factor"),
                    num("realized_vol").alias("realized_vol"))


def ranked_weights(spark: SparkSession, root: str) -> DataFrame:
    """Five names with falling weights 0.4 .. 0.05, so that limits and redistribution have work."""
    w = momentum_weights(spark, root).filter(F.col("rank").isNotNull())
    table = F.array(*[F.lit(x) for x in (0.40, 0.30, 0.15, 0.10, 0.05)])
    return w.withColumn("weight", F.element_at(table, F.col("rank"))).select("strategy_id", "as_of", "ticker", "weight")


RW = "SELECT as_of, ticker, CAST([0.40, 0.30, 0.15, 0.10, 0.05][k] AS DOUBLE) AS weight FROM rk WHERE k <= 5 AND score IS NOT NULL"


@query("overlay_position_limit", with_ctes(
    "bars members rebal",
    "SELECT as_of, ticker, round(least(cap + CASE WHEN cap > 0 AND cap < 0.25 AND ex > 0 THEN ex * cap / NULLIF(pool, 0) ELSE 0 END, 0.25), 6) AS weight, "
    "round(ex, 6) AS excess_weight FROM (SELECT *, sum(weight - cap) OVER d AS ex, sum(CASE WHEN cap > 0 AND cap < 0.25 THEN cap END) OVER d AS pool "
    "FROM (SELECT *, least(weight, CAST(0.25 AS DOUBLE)) AS cap FROM rw) WINDOW d AS (PARTITION BY as_of))",
    **{k: WSQL[k] for k in ("s", "g", "rk")}, rw=RW))
def overlay_position_limit(spark: SparkSession, root: str) -> DataFrame:
    o = overlays.position_limit(ranked_weights(spark, root))
    return o.select("as_of", "ticker", num("weight").alias("weight"), num("excess_weight").alias("excess_weight"))


def with_peak(curve: DataFrame) -> DataFrame:
    by = Window.partitionBy("strategy_id").orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("peak_nav", F.max("nav").over(by))


@query("overlay_drawdown_breaker", with_ctes(
    "px", "SELECT w.as_of, w.ticker, round(w.weight * CASE WHEN dd >= 0.3 THEN 0.25 WHEN dd >= 0.2 THEN 0.5 WHEN dd >= 0.1 THEN 0.75 ELSE 1 END, 6) AS weight, "
    "CASE WHEN dd >= 0.3 THEN 'EXIT' WHEN dd >= 0.2 THEN 'HARD' WHEN dd >= 0.1 THEN 'SOFT' ELSE 'NONE' END AS breaker_level FROM w JOIN "
    "(SELECT as_of, (pk - nav) / pk AS dd FROM (SELECT *, max(nav) OVER (ORDER BY as_of) AS pk FROM curve)) USING (as_of)", **CSQL))
def overlay_drawdown_breaker(spark: SparkSession, root: str) -> DataFrame:
    w = momentum_weights(spark, root)
    o = overlays.drawdown_breaker(w, with_peak(accounting.periodic_value(w, monthly(spark))))
    return o.select("as_of", "ticker", num("weight").alias("weight"), "breaker_level")


def vix_at(spark: SparkSession, root: str) -> DataFrame:
    return R.macro_as_of(macro_from_orders(spark, root), schedule_days(START, END, "monthly"), {"vix": "VIX"})


VIX_SQL = dict(
    sh="SELECT w.*, v.VIX AS vix, CASE WHEN v.VIX >= 30 THEN 0.5 WHEN v.VIX >= 25 THEN 0.25 ELSE 0.0 END AS sh, "
    "sum(CASE WHEN ticker NOT IN ('Brand#2', 'Brand#3', 'Brand#4') THEN weight END) OVER (PARTITION BY w.as_of) AS risky "
    "FROM w LEFT JOIN macro_at v USING (as_of)",
    ov="SELECT as_of, ticker, sum(weight) AS weight FROM (SELECT as_of, ticker, CASE WHEN sh > 0 AND risky > 0 AND "
    "ticker NOT IN ('Brand#2', 'Brand#3', 'Brand#4') THEN weight * (1 - sh) ELSE weight END AS weight FROM sh UNION ALL "
    "SELECT DISTINCT as_of, d.t, sh / 3.0 FROM sh CROSS JOIN (VALUES ('Brand#2'), ('Brand#3'), ('Brand#4')) d(t) WHERE sh > 0 AND risky > 0) GROUP BY 1, 2",
)


@query("overlay_volatility_regime", with_ctes(
    "bars members rebal macro_at", "SELECT as_of, ticker, round(CAST(weight AS DOUBLE), 6) AS weight FROM ov", **WSQL, **VIX_SQL))
def overlay_volatility_regime(spark: SparkSession, root: str) -> DataFrame:
    o = overlays.volatility_regime(momentum_weights(spark, root), vix_at(spark, root), SAFE)
    return o.select("as_of", "ticker", num("weight").alias("weight"))


CHAIN_SQL = dict(
    VIX_SQL,
    lim="SELECT as_of, ticker, least(cap + CASE WHEN cap > 0 AND cap < 0.15 AND ex > 0 THEN ex * cap / NULLIF(pool, 0) ELSE 0 END, 0.15) AS weight "
    "FROM (SELECT *, sum(weight - cap) OVER d AS ex, sum(CASE WHEN cap > 0 AND cap < 0.15 THEN cap END) OVER d AS pool FROM "
    "(SELECT as_of, ticker, CAST(weight AS DOUBLE) AS weight, least(CAST(weight AS DOUBLE), CAST(0.15 AS DOUBLE)) AS cap FROM ov) WINDOW d AS (PARTITION BY as_of))",
)


def overlay_steps(spark: SparkSession, root: str) -> list:
    return [
        lambda w: overlays.volatility_regime(w, vix_at(spark, root), SAFE),
        lambda w: overlays.position_limit(w, 0.15),
    ]


@query("overlay_chain", with_ctes(
    "bars members rebal macro_at", "SELECT as_of, ticker, round(weight, 6) AS weight FROM lim", **WSQL, **CHAIN_SQL))
def overlay_chain(spark: SparkSession, root: str) -> DataFrame:
    o = overlays.chain(momentum_weights(spark, root), overlay_steps(spark, root))
    return o.select("as_of", "ticker", num("weight").alias("weight"))


# Two configurations of one strategy: all overlays, and one without the volatility regime.
CONFIG_COLUMNS = ["strategy_id", "config", "target_vol", "min_scale", "max_scale", "max_weight", "soft", "hard", "exit", "high_vix", "elevated_vix"]
CONFIG_ROWS = [("momentum", "careful", 3.0, 0.25, 1.0, 0.15, 0.1, 0.2, 0.3, 30.0, 25.0), ("momentum", "wide", 6.0, 0.5, 1.5, 0.25, 0.2, 0.4, 0.6, None, None)]
CONFIGURED_SQL = dict(
    VOL_SQL,
    cf=f"SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL' if v is None else repr(v) if isinstance(v, str) else f'CAST({v} AS DOUBLE)' for v in r[1:]) + ')' for r in CONFIG_ROWS)}) "
    "t(config, tv, mins, maxs, mw, soft, hard, xt, hv, ev)",
    v1="SELECT w.as_of, w.ticker, w.weight, cf.*, vol, CASE WHEN coalesce(n, 0) < 20 THEN 1.0 WHEN vol < 0.01 THEN least(greatest(1.0, mins), maxs) ELSE least(greatest(tv / vol, mins), maxs) END AS sc "
    "FROM w CROSS JOIN cf LEFT JOIN vol USING (as_of)",
    v2="SELECT *, weight * sc - cap AS over FROM (SELECT *, least(weight * sc, mw) AS cap FROM v1)",
    v3="SELECT *, sum(over) OVER d AS ex, sum(CASE WHEN cap > 0 AND cap < mw THEN cap END) OVER d AS pool FROM v2 WINDOW d AS (PARTITION BY config, as_of)",
    v4="SELECT *, least(cap + CASE WHEN cap > 0 AND cap < mw AND ex > 0 THEN ex * cap / NULLIF(pool, 0) ELSE 0 END, mw) AS w2 FROM v3",
    st="SELECT as_of, (pk - nav) / pk AS dd FROM (SELECT *, max(nav) OVER (ORDER BY as_of) AS pk FROM curve)",
    v5="SELECT *, CASE WHEN dd >= xt THEN 0.25 WHEN dd >= hard THEN 0.5 WHEN dd >= soft THEN 0.75 ELSE 1.0 END AS ef, "
    "CASE WHEN dd >= xt THEN 'EXIT' WHEN dd >= hard THEN 'HARD' WHEN dd >= soft THEN 'SOFT' ELSE 'NONE' END AS lv FROM v4 LEFT JOIN st USING (as_of)",
    v6="SELECT v5.*, w2 * ef AS w3, CASE WHEN hv IS NULL THEN NULL WHEN m.VIX IS NULL THEN 'UNKNOWN' WHEN m.VIX >= hv THEN 'HIGH_VOL' WHEN m.VIX >= ev THEN 'ELEVATED_VOL' ELSE 'NORMAL' END AS vl "
    "FROM v5 LEFT JOIN macro_at m USING (as_of)",
    v7="SELECT *, CASE vl WHEN 'HIGH_VOL' THEN 0.5 WHEN 'ELEVATED_VOL' THEN 0.25 ELSE 0.0 END AS sh, sum(CASE WHEN ticker NOT IN ('Brand#2', 'Brand#3', 'Brand#4') THEN w3 END) OVER (PARTITION BY config, as_of) AS risky FROM v6",
    v8="SELECT config, as_of, ticker, CASE WHEN sh > 0 AND risky > 0 AND ticker NOT IN ('Brand#2', 'Brand#3', 'Brand#4') THEN w3 * (1 - sh) ELSE w3 END AS weight, vol, sc, ex, dd, ef, lv, vl, sh FROM v7 UNION ALL "
    "SELECT DISTINCT config, as_of, d.t, sh / 3.0, vol, sc, ex, dd, ef, lv, vl, sh FROM v7 CROSS JOIN (VALUES ('Brand#2'), ('Brand#3'), ('Brand#4')) d(t) WHERE sh > 0 AND risky > 0",
)


def configured_weights(spark: SparkSession, root: str) -> DataFrame:
    # Weights feed the overlays and the value curve that the breaker looks at.
    w = durable(momentum_weights(spark, root))
    peaks = with_peak(accounting.periodic_value(w, monthly(spark)))
    return overlays.configured(w, literal_rows(spark, CONFIG_COLUMNS, CONFIG_ROWS), daily_returns(bars_from_orders(spark, root)), peaks,
                               vix_at(spark, root), SAFE)


@query("overlay_configurations", with_ctes(
    "px rets macro_at", "SELECT config, as_of, ticker, round(CAST(sum(weight) AS DOUBLE), 6) AS weight FROM v8 GROUP BY 1, 2, 3", **CONFIGURED_SQL))
def overlay_configurations(spark: SparkSession, root: str) -> DataFrame:
    """Four overlays from configuration rows, both configurations in one job."""
    return configured_weights(spark, root).select("config", "as_of", "ticker", num("weight").alias("weight"))


@query("overlay_diagnostics", with_ctes(
    "px rets macro_at", "SELECT DISTINCT config, as_of, round(vol, 6) AS realized_vol, round(CAST(sc AS DOUBLE), 6) AS scale_factor, round(CAST(ex AS DOUBLE), 6) AS excess_weight, round(dd, 6) AS drawdown, "
    "round(CAST(ef AS DOUBLE), 6) AS exposure_factor, lv AS breaker_level, vl AS vix_level, CASE WHEN vl IS NOT NULL THEN round(CAST(sh AS DOUBLE), 6) END AS defensive_share FROM v8", **CONFIGURED_SQL))
def overlay_diagnostics(spark: SparkSession, root: str) -> DataFrame:
    """What each overlay measured and did, for each configuration and date."""
    c = configured_weights(spark, root)
    cells = [num(F.try_element_at("diagnostics", F.lit(m))).alias(m) for m in overlays.MEASURES]
    names = [F.try_element_at("levels", F.lit(n)).alias(n) for n in ("breaker_level", "vix_level")]
    return c.select("config", "as_of", *cells, *names).distinct()


# --- trades --------------------------------------------------------------------------------------------------------


def weight_pairs(spark: SparkSession, root: str) -> DataFrame:
    return pairs(spark, root).withColumnsRenamed({"prev_w": "current_weight", "next_w": "target_weight"})


@query("diff_trades", with_ctes(
    "bars members rebal",
    "SELECT as_of, ticker, round(prev_w, 6) AS current_weight, round(next_w, 6) AS target_weight, round(next_w - prev_w, 6) AS delta_weight "
    "FROM pair WHERE abs(next_w - prev_w) >= 0.01", **PSQL))
def diff_trades(spark: SparkSession, root: str) -> DataFrame:
    t = T.diff_trades(weight_pairs(spark, root), 0.01)
    return t.select("as_of", "ticker", *[num(c).alias(c) for c in ("current_weight", "target_weight", "delta_weight")])


@query("drift_report", with_ctes(
    "bars members rebal",
    "SELECT as_of, ticker, round(next_w - prev_w, 6) AS drift, round(abs(next_w - prev_w), 6) AS abs_drift "
    "FROM pair WHERE abs(next_w - prev_w) >= 0.02", **PSQL))
def drift_report(spark: SparkSession, root: str) -> DataFrame:
    return T.drift(weight_pairs(spark, root)).select("as_of", "ticker", num("drift").alias("drift"), num("abs_drift").alias("abs_drift"))


def share_targets(spark: SparkSession, root: str) -> DataFrame:
    w = momentum_weights(spark, root).filter(F.col("ticker") != CASH)
    return T.to_shares(w, 100_000.0)


@query("weights_to_shares", with_ctes(
    "px", f"SELECT w.as_of, w.ticker, round(w.weight * 100000, 6) AS notional, {q_sig('w.weight * 100000 / price')} AS shares "
    "FROM w JOIN px ON px.as_of = w.as_of AND px.ticker = w.ticker", **WSQL))
def weights_to_shares(spark: SparkSession, root: str) -> DataFrame:
    return share_targets(spark, root).select("as_of", "ticker", num("notional").alias("notional"), sig("shares").alias("shares"))


def at_next(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Re-key rows to the following decision date; the calendar has one row per date."""
    nxt = bounded(calendar.select("as_of", "next_as_of"), DAYS)
    return df.join(nxt, "as_of").filter(F.col("next_as_of").isNotNull()).withColumn("as_of", F.col("next_as_of")).drop("next_as_of")


SHARE_SQL = dict(
    WSQL,
    tg="SELECT w.as_of, w.ticker, w.weight, w.weight * 100000 / price AS shares, price FROM w JOIN px ON px.as_of = w.as_of AND px.ticker = w.ticker",
    cu="SELECT r.next_as_of AS as_of, ticker, weight, shares, price FROM tg JOIN rebal r USING (as_of) WHERE r.next_as_of IS NOT NULL",
    tr="SELECT coalesce(t.as_of, c.as_of) AS as_of, coalesce(t.ticker, c.ticker) AS ticker, coalesce(c.shares, 0) AS cs, coalesce(t.shares, 0) AS ts, "
    "coalesce(t.price, c.price) AS price FROM tg t FULL JOIN cu c ON t.as_of = c.as_of AND t.ticker = c.ticker",
)


@query("share_trades", with_ctes(
    "px", f"SELECT as_of, ticker, CASE WHEN abs(ts - cs) < 0.01 THEN 'HOLD' WHEN ts > cs THEN 'BUY' ELSE 'SELL' END AS action, "
    f"{q_sig('cs')} AS current_shares, {q_sig('ts')} AS target_shares, {q_sig('abs((ts - cs) * price)')} AS notional_value FROM tr", **SHARE_SQL))
def share_trades(spark: SparkSession, root: str) -> DataFrame:
    t = T.share_trades(T.consecutive(share_targets(spark, root), monthly(spark), T.SHARE_FIELDS))
    return t.select("as_of", "ticker", "action", *[sig(c).alias(c) for c in ("current_shares", "target_shares", "notional_value")])


CHECK_SQL = (
    "SELECT as_of, 'max_turnover' AS check_name, round(0.5 * sum(abs(next_w - prev_w)), 6) AS value, 0.5 * sum(abs(next_w - prev_w)) <= 0.7 AS passed FROM pair GROUP BY 1 "
    "UNION ALL SELECT as_of, 'sector_concentration', round(max(w), 6), max(w) <= 0.45 FROM (SELECT as_of, coalesce(sector, 'Unknown') AS sector, sum(next_w) AS w "
    "FROM pair LEFT JOIN (SELECT name AS nm, sector FROM reference) ON nm = ticker WHERE next_w > 0 GROUP BY 1, 2) GROUP BY 1 "
    "UNION ALL SELECT as_of, 'min_trade', CAST(count(*) FILTER (abs(next_w - prev_w) < 0.01) AS DOUBLE), TRUE FROM pair GROUP BY 1"
)


def sectors(spark: SparkSession, root: str) -> DataFrame:
    return reference_from_orders(spark, root).select(F.col("name").alias("ticker"), "sector")


@query("pre_trade_checks", with_ctes("bars members rebal reference", CHECK_SQL, **PSQL))
def pre_trade_checks(spark: SparkSession, root: str) -> DataFrame:
    t = durable(T.diff_trades(weight_pairs(spark, root)))
    out = T.check_turnover(t, 0.7).unionByName(T.check_sectors(t, sectors(spark, root), 0.45)).unionByName(T.check_small_trades(t))
    return out.select("as_of", F.col("check").alias("check_name"), num("value").alias("value"), "passed")


PROD_SQL = dict(
    WSQL, **CHAIN_SQL,
    tgt="SELECT r.as_of, r.next_as_of, l.ticker, l.weight FROM rebal r JOIN lim l USING (as_of)",
    prv="SELECT r.next_as_of AS as_of, w.ticker, w.weight FROM w JOIN rebal r USING (as_of) WHERE r.next_as_of IS NOT NULL",
    pp="SELECT coalesce(a.as_of, p.as_of) AS as_of, coalesce(a.ticker, p.ticker) AS ticker, coalesce(p.weight, 0) AS prev_w, "
    "coalesce(a.weight, 0) AS next_w FROM tgt a FULL JOIN prv p ON a.as_of = p.as_of AND a.ticker = p.ticker",
    ck="SELECT t.as_of, n_trades, turnover, turnover <= 0.8 AND coalesce(s.mx, 0) <= 0.6 AS ok FROM (SELECT as_of, count(*) AS n_trades, "
    "0.5 * sum(abs(next_w - prev_w)) AS turnover FROM pp WHERE abs(next_w - prev_w) >= 0.005 GROUP BY 1) t LEFT JOIN "
    "(SELECT as_of, max(w) AS mx FROM (SELECT as_of, coalesce(sector, 'Unknown') AS sec, sum(next_w) AS w FROM pp LEFT JOIN "
    "(SELECT name AS nm, sector FROM reference) ON nm = ticker WHERE next_w > 0 AND abs(next_w - prev_w) >= 0.005 GROUP BY 1, 2) GROUP BY 1) s USING (as_of)",
)


@query("production_run", with_ctes(
    "bars members rebal reference macro_at",
    "SELECT d AS as_of, CASE WHEN r.as_of IS NULL THEN 'skipped' WHEN coalesce(ok, TRUE) THEN 'pending' ELSE 'blocked' END AS status, "
    "coalesce(n_trades, 0) AS n_trades, round(coalesce(turnover, 0), 6) AS turnover "
    "FROM days LEFT JOIN rebal r ON r.as_of = d LEFT JOIN ck ON ck.as_of = d WHERE isodow(d) < 6", **PROD_SQL))
def production_run_q(spark: SparkSession, root: str) -> DataFrame:
    w = momentum_weights(spark, root).select("strategy_id", "as_of", "ticker", "weight")
    out = production_run(
        w, at_next(w, monthly(spark)), overlay_steps(spark, root), sectors(spark, root), START, END, "monthly",
        threshold=0.005, max_turnover=0.8, max_sector=0.6,
    )
    return out.select("as_of", "status", "n_trades", num("turnover").alias("turnover"))


# --- calendars -----------------------------------------------------------------------------------------------------


@query("rebalance_calendars", with_ctes(
    "days rebal rebal_w rebal_me rebal_qe",
    "SELECT schedule, as_of, CAST(coalesce(sum(n), 0) AS BIGINT) AS orders FROM (SELECT *, lag(as_of) OVER (PARTITION BY schedule ORDER BY as_of) AS prev FROM ("
    "SELECT 'monthly' AS schedule, as_of FROM rebal UNION ALL SELECT 'weekly', as_of FROM rebal_w UNION ALL SELECT 'month_end', as_of FROM rebal_me "
    "UNION ALL SELECT 'quarter_end', as_of FROM rebal_qe UNION ALL SELECT 'every_21', d FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k FROM days "
    "WHERE isodow(d) < 6) WHERE k % 21 = 0)) c LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) o "
    "ON day <= as_of AND (prev IS NULL OR day > prev) GROUP BY 1, 2"))
def rebalance_calendars(spark: SparkSession, root: str) -> DataFrame:
    """Dates of each schedule with the orders since the one before."""
    from panelwise.sources.panel import table

    one = spark.range(1)
    cells = [
        one.select(F.lit(s).alias("schedule"), F.explode(schedule_days(START, END, s)).alias("as_of"))
        for s in ("monthly", "weekly", "month_end", "quarter_end")
    ]
    cells.append(one.select(F.lit("every_21").alias("schedule"), F.explode(every_n_bdays(START, END, 21)).alias("as_of")))
    out = cells[0]
    for c in cells[1:]:
        out = out.unionByName(c)
    out = out.withColumn("prev", F.lag("as_of").over(Window.partitionBy("schedule").orderBy("as_of")))
    # Both sides have one row a day at most.
    daily = table(spark, root, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    since = (F.col("day") <= F.col("as_of")) & (F.col("prev").isNull() | (F.col("day") > F.col("prev")))
    return out.join(bounded(daily, DAYS), since, "left").groupBy("schedule", "as_of").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("orders"))


@query("next_rebalance_dates", with_ctes(
    "bars days",
    "SELECT o.d AS as_of, "
    "(SELECT min(x) FROM (SELECT CAST(unnest(generate_series(o.d, o.d + 70, INTERVAL 1 DAY)) AS DATE) AS x) WHERE x > "
    "CASE isodow(o.d) WHEN 6 THEN o.d + 2 WHEN 7 THEN o.d + 1 ELSE o.d END AND x = last_day(x) - CAST(greatest(isodow(last_day(x)) - 5, 0) AS INTEGER)) AS next_monthly, "
    "(SELECT min(x) FROM (SELECT CAST(unnest(generate_series(o.d, o.d + 70, INTERVAL 1 DAY)) AS DATE) AS x) WHERE x > "
    "CASE isodow(o.d) WHEN 6 THEN o.d + 2 WHEN 7 THEN o.d + 1 ELSE o.d END AND isodow(x) = 5) AS next_weekly, "
    "o.d = last_day(o.d) - CAST(greatest(isodow(last_day(o.d)) - 5, 0) AS INTEGER) AS is_monthly "
    "FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) o"))
def next_rebalance_dates(spark: SparkSession, root: str) -> DataFrame:
    """Gate and next date for every day that has an order, weekends included."""
    from panelwise.sources.panel import table

    d = table(spark, root, "orders").select(F.col("o_orderdate").cast("date").alias("as_of")).distinct()
    return d.select(
        "as_of", next_rebalance("as_of", "monthly").alias("next_monthly"), next_rebalance("as_of", "weekly").alias("next_weekly"),
        is_rebalance_day("as_of", "monthly").alias("is_monthly"),
    )

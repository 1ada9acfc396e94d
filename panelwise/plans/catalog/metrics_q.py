"""Registered queries: returns, rolling statistics, performance, cycles, benchmarks, comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelwise.functions.dates import schedule_days, schedule_table
from panelwise.functions.exprs import change, num, sig
from panelwise.functions.joins import DAYS, bounded
from panelwise.operators import accounting, asof, benchmarks as B, comparison, construction, costs, metrics as M, rolling as W
from panelwise.operators.returns import benchmark_prices, benchmark_returns, daily_returns
from panelwise.operators.schedule_defaults import END, START
from panelwise.plans.catalog.portfolio_q import CSQL, WSQL, monthly
from panelwise.plans.catalog.signals_q import BENCH, momentum_weights
from panelwise.plans.registry import query
from panelwise.plans.sqlkit import sig as q_sig, with_ctes
from panelwise.sources.panel import bars_from_orders, macro_from_orders, members_from_orders, reference_from_orders
from panelwise.sources.storage import durable


def rets(spark: SparkSession, root: str) -> DataFrame:
    return daily_returns(bars_from_orders(spark, root))


def strategies(spark: SparkSession, root: str) -> DataFrame:
    """Each ticker held alone: one daily return series per strategy."""
    return rets(spark, root).filter(F.col("r").isNotNull()).select(F.col("ticker").alias("strategy_id"), "date", "r")


def curves(spark: SparkSession, root: str) -> DataFrame:
    return bars_from_orders(spark, root).select(F.col("ticker").alias("strategy_id"), "date", F.col("close").alias("nav"))


def priced(spark: SparkSession, root: str, schedule: str) -> DataFrame:
    """Last close before each decision date, and its growth to the next one."""
    marks = asof.markers(members_from_orders(spark, root), schedule_days(START, END, schedule))
    p = asof.as_of(bars_from_orders(spark, root), marks, ["ticker"], ["close"]).withColumnRenamed("close", "price")
    return accounting.forward_growth(p)


def calendar(spark: SparkSession, schedule: str) -> DataFrame:
    return schedule_table(spark, schedule_days(START, END, schedule))


# --- rolling -------------------------------------------------------------------------------------------------------


@query("daily_returns", with_ctes("rets", f"SELECT date, ticker, {q_sig('r')} AS r FROM rets"))
def daily_returns_q(spark: SparkSession, root: str) -> DataFrame:
    return rets(spark, root).select("date", "ticker", sig("r").alias("r"))


@query("moving_average_200", with_ctes(
    "bars", f"SELECT date, ticker, {q_sig('CASE WHEN count(*) OVER w = 200 THEN avg(close) OVER w END', 11)} AS ma FROM bars "
    "WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 199 PRECEDING)"))
def moving_average_200(spark: SparkSession, root: str) -> DataFrame:
    return W.moving_average(bars_from_orders(spark, root), "close", 200).select("date", "ticker", sig("ma", 11).alias("ma"))


@query("rolling_sharpe", with_ctes(
    "rets", "SELECT date, ticker, round(CASE WHEN count(*) OVER w >= 126 THEN avg(r) OVER w / NULLIF(stddev_samp(r) OVER w, 0) * sqrt(252) END, 6) AS rolling_sharpe "
    "FROM rets WHERE r IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING)"))
def rolling_sharpe(spark: SparkSession, root: str) -> DataFrame:
    return W.rolling_sharpe(rets(spark, root)).select("date", "ticker", num("rolling_sharpe").alias("rolling_sharpe"))


@query("rolling_volatility", with_ctes(
    "rets", "SELECT date, ticker, round(CASE WHEN count(*) OVER w = 21 THEN stddev_samp(r) OVER w * sqrt(252) END, 6) AS rolling_vol "
    "FROM rets WHERE r IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 20 PRECEDING)"))
def rolling_volatility(spark: SparkSession, root: str) -> DataFrame:
    return W.rolling_volatility(rets(spark, root)).select("date", "ticker", num("rolling_vol").alias("rolling_vol"))


def with_benchmark(spark: SparkSession, root: str) -> DataFrame:
    r = strategies(spark, root)
    return M.aligned(r, benchmark_returns(bars_from_orders(spark, root), BENCH)).withColumnRenamed("strategy_id", "ticker")


AL = "SELECT r.ticker, r.date, r.r, b.r AS b FROM rets r JOIN bench b ON b.date = r.date WHERE r.r IS NOT NULL"


@query("rolling_correlation", with_ctes(
    "bench", "SELECT date, ticker, round(CASE WHEN count(*) OVER w = 63 THEN corr(r, b) OVER w END, 6) AS rolling_corr "
    "FROM al WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 62 PRECEDING)", al=AL))
def rolling_correlation(spark: SparkSession, root: str) -> DataFrame:
    return W.rolling_correlation(with_benchmark(spark, root), "r", "b").select("date", "ticker", num("rolling_corr").alias("rolling_corr"))


@query("rolling_win_rate", with_ctes(
    "bench", "SELECT ticker, round(avg(CASE WHEN rr > rb THEN 1.0 ELSE 0.0 END), 6) AS rolling_win_rate, count(*) AS n_windows FROM "
    "(SELECT ticker, count(*) OVER w AS n, product(1 + r) OVER w AS rr, product(1 + b) OVER w AS rb FROM al "
    "WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING)) WHERE n = 252 AND ticker <> 'Brand#1' GROUP BY 1", al=AL))
def rolling_win_rate(spark: SparkSession, root: str) -> DataFrame:
    out = W.rolling_win_rate(with_benchmark(spark, root)).filter(F.col("ticker") != BENCH)
    return out.select("ticker", num("rolling_win_rate").alias("rolling_win_rate"), "n_windows")


@query("rolling_annual_return", with_ctes(
    "rets", f"SELECT date, ticker, {q_sig('CASE WHEN count(*) OVER w = 252 THEN product(1 + r) OVER w - 1 END', 7)} AS roll FROM rets "
    "WHERE r IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING)"))
def rolling_annual_return(spark: SparkSession, root: str) -> DataFrame:
    r = rets(spark, root).filter(F.col("r").isNotNull())
    return W.rolling_compound(r, "r", "roll").select("date", "ticker", sig("roll", 7).alias("roll"))


@query("drawdown_series", with_ctes(
    "bars", "SELECT date, ticker, round(close / max(close) OVER (PARTITION BY ticker ORDER BY date) - 1, 6) AS drawdown FROM bars"))
def drawdown_series(spark: SparkSession, root: str) -> DataFrame:
    d = M.drawdown_path(curves(spark, root), "nav")
    return d.select("date", F.col("strategy_id").alias("ticker"), num("drawdown").alias("drawdown"))


@query("cumulative_growth", with_ctes(
    "rets", f"SELECT date, ticker, {q_sig('product(1 + r) OVER (PARTITION BY ticker ORDER BY date)')} AS equity FROM rets WHERE r IS NOT NULL"))
def cumulative_growth(spark: SparkSession, root: str) -> DataFrame:
    return M.growth_path(strategies(spark, root)).select("date", F.col("strategy_id").alias("ticker"), sig("equity").alias("equity"))


@query("macro_zscore_percentile", with_ctes(
    "macro", "SELECT indicator, date, round(CASE WHEN n >= 20 THEN (value - mu) / NULLIF(sd, 0) END, 6) AS zscore, "
    "round(CASE WHEN n >= 5 THEN 100.0 * len(list_filter(vals, lambda v: v <= value)) / n END, 6) AS percentile FROM "
    "(SELECT *, count(*) OVER w AS n, avg(value) OVER w AS mu, stddev_samp(value) OVER w AS sd, list(value) OVER w AS vals FROM macro "
    "WINDOW w AS (PARTITION BY indicator ORDER BY date RANGE BETWEEN INTERVAL 252 DAY PRECEDING AND CURRENT ROW))"))
def macro_zscore_percentile(spark: SparkSession, root: str) -> DataFrame:
    m = W.macro_position(macro_from_orders(spark, root))
    return m.select("indicator", "date", num("zscore").alias("zscore"), num("percentile").alias("percentile"))


# --- performance ---------------------------------------------------------------------------------------------------

PERF = dict(
    e="SELECT ticker, date, r, product(1 + r) OVER (PARTITION BY ticker ORDER BY date) AS eq, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM rets WHERE r IS NOT NULL",
    d="SELECT *, eq / max(eq) OVER (PARTITION BY ticker ORDER BY date) - 1 AS dd FROM e",
    u="SELECT *, rn - max(CASE WHEN dd >= 0 THEN rn END) OVER (PARTITION BY ticker ORDER BY date) AS below FROM d",
    v="SELECT ticker, quantile_cont(r, 0.05) AS var, quantile_cont(r, 0.95) AS hi FROM e GROUP BY 1",
)
PERF_COLS = {
    "total_return": "arg_max(eq, date) - 1",
    "cagr": "pow(arg_max(eq, date), 252.0 / count(*)) - 1",
    "volatility": "stddev_samp(r) * sqrt(252)",
    "sharpe": "avg(r) / stddev_samp(r) * sqrt(252)",
    "sortino": "avg(r - 0.02 / 252) * 252 / (stddev_samp(r) FILTER (r - 0.02 / 252 < 0) * sqrt(252))",
    "calmar": "avg(r) * 252 / abs(min(dd))",
    "max_drawdown": "min(dd)",
    "win_rate": "avg(CASE WHEN r > 0 THEN 100.0 ELSE 0.0 END)",
    "var": "any_value(v.var)",
    "cvar": "avg(r) FILTER (r <= v.var)",
    "tail_ratio": "abs(any_value(v.hi)) / abs(any_value(v.var))",
}


@query("performance_table", with_ctes(
    "rets", "SELECT u.ticker AS strategy_id, count(*) AS n, max(below) AS max_drawdown_duration, "
    + ", ".join(f"{q_sig(x)} AS {k}" for k, x in PERF_COLS.items()) + " FROM u JOIN v ON v.ticker = u.ticker GROUP BY 1", **PERF))
def performance_table(spark: SparkSession, root: str) -> DataFrame:
    p = M.performance(strategies(spark, root), 252.0, risk_free=0.02)
    return p.select("strategy_id", "n", F.col("max_drawdown_duration").cast("long").alias("max_drawdown_duration"),
                    *[sig(c).alias(c) for c in PERF_COLS])


ACTIVE = dict(
    al=AL,
    e="SELECT *, product(1 + r) OVER w AS se, product(1 + b) OVER w AS be FROM al WINDOW w AS (PARTITION BY ticker ORDER BY date)",
    d="SELECT *, se / max(se) OVER w - 1 AS sd, be / max(be) OVER w - 1 AS bd FROM e WINDOW w AS (PARTITION BY ticker ORDER BY date)",
)
ACTIVE_COLS = {
    "strategy_total_return": "arg_max(se, date) - 1",
    "strategy_sharpe": "avg(r) / stddev_samp(r) * sqrt(252)",
    "strategy_sortino": "CASE WHEN count(*) FILTER (r < 0.02 / 252) = 0 THEN CAST('inf' AS DOUBLE) ELSE avg(r - 0.02 / 252) * 252 / (stddev_samp(r) FILTER (r - 0.02 / 252 < 0) * sqrt(252)) END",
    "strategy_max_dd": "min(sd)",
    "strategy_cagr": "pow(arg_max(se, date), 252.0 / count(*)) - 1",
    "benchmark_total_return": "arg_max(be, date) - 1",
    "benchmark_sharpe": "avg(b) / stddev_samp(b) * sqrt(252)",
    "benchmark_sortino": "avg(b - 0.02 / 252) * 252 / (stddev_samp(b) FILTER (b - 0.02 / 252 < 0) * sqrt(252))",
    "benchmark_max_dd": "min(bd)",
    "benchmark_cagr": "pow(arg_max(be, date), 252.0 / count(*)) - 1",
    "active_return": "arg_max(se, date) - arg_max(be, date)",
    "active_return_ann": "avg(r - b) * 252",
    "tracking_error": "stddev_samp(r - b) * sqrt(252)",
    "information_ratio": "avg(r - b) * 252 / (stddev_samp(r - b) * sqrt(252))",
    "beta": "covar_samp(r, b) / var_samp(b)",
    "alpha": "((avg(r) - 0.02 / 252) - covar_samp(r, b) / var_samp(b) * (avg(b) - 0.02 / 252)) * 252",
    "sharpe_difference": "avg(r) / stddev_samp(r) * sqrt(252) - avg(b) / stddev_samp(b) * sqrt(252)",
    "win_rate": "avg(CASE WHEN r > b THEN 100.0 ELSE 0.0 END)",
}


@query("active_metrics", with_ctes(
    "bench", "SELECT ticker AS strategy_id, count(*) AS n, " + ", ".join(f"{q_sig(x, 7)} AS {k}" for k, x in ACTIVE_COLS.items())
    + " FROM d WHERE ticker <> 'Brand#1' GROUP BY 1", **ACTIVE))
def active_metrics(spark: SparkSession, root: str) -> DataFrame:
    b = benchmark_returns(bars_from_orders(spark, root), BENCH)
    a = M.active(strategies(spark, root).filter(F.col("strategy_id") != BENCH), b, 252.0, 0.02)
    return a.select("strategy_id", "n", *[sig(c, 7).alias(c) for c in ACTIVE_COLS])


@query("attribution_metrics", with_ctes(
    "rets", "SELECT s.ticker AS strategy_id, b.ticker AS benchmark, count(*) AS n, "
    f"{q_sig('avg(s.r - b.r) * 252', 7)} AS excess_return, {q_sig('stddev_samp(s.r - b.r) * sqrt(252)', 7)} AS tracking_error, "
    f"{q_sig('covar_samp(s.r, b.r) / var_samp(b.r)', 7)} AS beta, {q_sig('(avg(s.r) - covar_samp(s.r, b.r) / var_samp(b.r) * avg(b.r)) * 252', 7)} AS alpha "
    "FROM rets s JOIN rets b ON b.date = s.date AND b.ticker IN ('Brand#1', 'Brand#2') AND s.ticker NOT IN ('Brand#1', 'Brand#2') "
    "WHERE s.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2"))
def attribution_metrics(spark: SparkSession, root: str) -> DataFrame:
    s, two = strategies(spark, root), ["Brand#1", "Brand#2"]
    b = s.filter(F.col("strategy_id").isin(two)).withColumnRenamed("strategy_id", "benchmark")
    a = M.attribution(s.filter(~F.col("strategy_id").isin(two)), b)
    return a.select("strategy_id", "benchmark", "n", *[sig(c, 7).alias(c) for c in ("excess_return", "tracking_error", "beta", "alpha")])


@query("concentration", with_ctes(
    "bars members rebal", "SELECT as_of, round(sum(weight * weight) / pow(sum(weight), 2), 6) AS herfindahl, "
    "round(pow(sum(weight), 2) / sum(weight * weight), 6) AS effective_n FROM w WHERE weight <> 0 GROUP BY 1", **WSQL))
def concentration(spark: SparkSession, root: str) -> DataFrame:
    c = M.concentration(momentum_weights(spark, root))
    return c.select("as_of", num("herfindahl").alias("herfindahl"), num("effective_n").alias("effective_n"))


@query("exposure_summary", with_ctes(
    "bars members rebal reference",
    "SELECT h.ticker, round(avg(coalesce(w.weight, 0)), 6) AS avg_weight, round(max(w.weight), 6) AS max_weight, round(min(w.weight), 6) AS min_weight_nonzero, "
    "round(avg(CASE WHEN w.weight > 0 THEN 1.0 ELSE 0.0 END), 6) AS hold_frequency, round(stddev_samp(coalesce(w.weight, 0)), 6) AS weight_std, any_value(f.sector) AS sector "
    "FROM (SELECT DISTINCT ticker FROM w) h CROSS JOIN rebal r LEFT JOIN w ON w.as_of = r.as_of AND w.ticker = h.ticker LEFT JOIN reference f ON f.name = h.ticker GROUP BY 1", **WSQL))
def exposure_summary(spark: SparkSession, root: str) -> DataFrame:
    sec = reference_from_orders(spark, root).select(F.col("name").alias("ticker"), "sector")
    e = M.exposure_summary(momentum_weights(spark, root), F.size(schedule_days(START, END, "monthly")), sec)
    return e.select("ticker", "sector", *[num(c).alias(c) for c in ("avg_weight", "max_weight", "min_weight_nonzero", "hold_frequency", "weight_std")])


@query("holdings_correlation", with_ctes(
    "bars members rebal",
    "SELECT a.ticker AS i, b.ticker AS j, round(corr(a.weight, b.weight), 6) AS corr FROM dn a JOIN dn b ON a.as_of = b.as_of AND a.ticker < b.ticker GROUP BY 1, 2",
    **WSQL, dn="SELECT h.ticker, r.as_of, coalesce(w.weight, 0) AS weight FROM (SELECT DISTINCT ticker FROM w WHERE weight <> 0) h CROSS JOIN rebal r "
    "LEFT JOIN w ON w.as_of = r.as_of AND w.ticker = h.ticker"))
def holdings_correlation(spark: SparkSession, root: str) -> DataFrame:
    c = comparison.holdings_correlation(momentum_weights(spark, root), schedule_days(START, END, "monthly"))
    return c.select("i", "j", num("corr").alias("corr"))


@query("strategy_return_correlation", with_ctes(
    "rets", "SELECT a.ticker AS i, b.ticker AS j, count(*) AS n, round(corr(a.r, b.r), 6) AS corr FROM rets a JOIN rets b ON a.date = b.date AND a.ticker < b.ticker "
    "WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2"))
def strategy_return_correlation(spark: SparkSession, root: str) -> DataFrame:
    c = comparison.return_correlation(strategies(spark, root))
    return c.select("i", "j", F.col("n").cast("long").alias("n"), num("corr").alias("corr"))


PAIR_SQL = (
    "SELECT a.ticker AS i, b.ticker AS j, count(*) AS n, avg(a.r) AS m1, avg(b.r) AS m2, avg(a.r) / stddev_samp(a.r) AS s1, avg(b.r) / stddev_samp(b.r) AS s2, "
    "corr(a.r, b.r) AS rho, var_samp(a.r) AS v1, var_samp(b.r) AS v2, stddev_samp(a.r - b.r) AS sdd FROM rets a JOIN rets b ON a.date = b.date AND a.ticker < b.ticker "
    "WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2")


@query("sharpe_difference_statistic", with_ctes(
    "rets",
    "SELECT i, j, n, round(s1, 6) AS sharpe_1, round(s2, 6) AS sharpe_2, round(CASE WHEN theta > 0 THEN (s1 - s2) / sqrt(theta) ELSE (m1 - m2) / (sdd / sqrt(n)) END, 5) AS t_statistic "
    "FROM (SELECT *, (2 - 2 * rho * sqrt(v1 / v2) - 0.5 * s1 * s1 - 0.5 * s2 * s2 + s1 * s2 * rho) / n AS theta FROM p)",
    p=PAIR_SQL))
def sharpe_difference_statistic(spark: SparkSession, root: str) -> DataFrame:
    t = comparison.sharpe_test(strategies(spark, root))
    return t.select("i", "j", "n", num("sharpe_1").alias("sharpe_1"), num("sharpe_2").alias("sharpe_2"), num("t_statistic", 5).alias("t_statistic"))


# Student's distribution with v degrees of freedom as a finite sum in the angle atan(t / sqrt(v)), one sum for even v and one for odd v.
T_SUM = dict(
    q="SELECT i, j, n, s1, s2, n - 1 AS v, t, atan(abs(t) / sqrt(n - 1)) AS th FROM (SELECT *, CASE WHEN theta > 0 THEN (s1 - s2) / sqrt(theta) ELSE (m1 - m2) / (sdd / sqrt(n)) END AS t "
    "FROM (SELECT *, (2 - 2 * rho * sqrt(v1 / v2) - 0.5 * s1 * s1 - 0.5 * s2 * s2 + s1 * s2 * rho) / n AS theta FROM p))",
    co="SELECT k, exp(sum(ln((2.0 * greatest(k, 1) - 1) / (2.0 * greatest(k, 1))) * least(k, 1)) OVER w) AS ev, "
    "exp(sum(ln(2.0 * greatest(k, 1) / (2.0 * greatest(k, 1) + 1)) * least(k, 1)) OVER w) AS od "
    "FROM (SELECT unnest(generate_series(0, (SELECT max(n) FROM p))) AS k) WINDOW w AS (ORDER BY k)",
    su="SELECT q.i, q.j, sum(CASE WHEN v % 2 = 0 THEN ev * pow(cos(th), 2 * k) ELSE od * pow(cos(th), 2 * k + 1) END) AS s "
    "FROM q JOIN co ON 2 * k + 2 + v % 2 <= v GROUP BY 1, 2",
    pv="SELECT q.*, CASE WHEN v % 2 = 0 THEN 1 - sin(th) * coalesce(s, 0) ELSE 1 - 2 / pi() * (th + sin(th) * coalesce(s, 0)) END AS pval FROM q LEFT JOIN su USING (i, j)",
)


@query("sharpe_difference_test", with_ctes(
    "rets", "SELECT i, j, n, round(s1, 6) AS sharpe_1, round(s2, 6) AS sharpe_2, round(t, 5) AS t_statistic, round(pval, 6) AS p_value, pval < 0.05 AS is_significant FROM pv",
    p=PAIR_SQL, **T_SUM))
def sharpe_difference_test(spark: SparkSession, root: str) -> DataFrame:
    t = comparison.sharpe_test(strategies(spark, root))
    return t.select("i", "j", "n", *[num(c).alias(c) for c in ("sharpe_1", "sharpe_2")], num("t_statistic", 5).alias("t_statistic"),
                    num("p_value").alias("p_value"), "is_significant")


@query("monthly_returns", with_ctes(
    "bars", "SELECT ticker AS strategy_id, period, round(v / NULLIF(lag(v) OVER (PARTITION BY ticker ORDER BY period), 0) - 1, 6) AS r FROM "
    "(SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS period, arg_max(close, date) AS v FROM bars GROUP BY 1, 2)"))
def monthly_returns(spark: SparkSession, root: str) -> DataFrame:
    return M.period_returns(curves(spark, root), "nav", "month").select("strategy_id", "period", num("r").alias("r"))


@query("yearly_returns", with_ctes(
    "bars", "SELECT ticker AS strategy_id, period, round(v / NULLIF(lag(v) OVER (PARTITION BY ticker ORDER BY period), 0) - 1, 6) AS r FROM "
    "(SELECT ticker, CAST(date_trunc('year', date) AS DATE) AS period, arg_max(close, date) AS v FROM bars GROUP BY 1, 2)"))
def yearly_returns(spark: SparkSession, root: str) -> DataFrame:
    return M.period_returns(curves(spark, root), "nav", "year").select("strategy_id", "period", num("r").alias("r"))


MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


@query("month_year_grid", with_ctes(
    "bars", "SELECT strategy_id, CAST(year(period) AS BIGINT) AS year, " + ", ".join(f"max(CASE WHEN month(period) = {i} THEN r END) AS {m}" for i, m in enumerate(MONTHS, 1))
    + " FROM (SELECT ticker AS strategy_id, period, round(v / NULLIF(lag(v) OVER (PARTITION BY ticker ORDER BY period), 0) - 1, 6) AS r FROM "
    "(SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS period, arg_max(close, date) AS v FROM bars GROUP BY 1, 2)) GROUP BY 1, 2"))
def month_year_grid(spark: SparkSession, root: str) -> DataFrame:
    g = M.month_grid(M.period_returns(curves(spark, root), "nav", "month"))
    return g.select("strategy_id", F.col("year").cast("long").alias("year"), *[num(m).alias(m) for m in MONTHS])


DD = dict(d="SELECT ticker, date, close / max(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS dd, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM bars")


@query("drawdown_episodes", with_ctes(
    "bars", 'SELECT ticker AS strategy_id, min(date) AS "start", max(date) AS "end", round(min(dd), 6) AS max_dd, CAST(max(date) - min(date) AS BIGINT) AS days FROM '
    "(SELECT *, rn - row_number() OVER (PARTITION BY ticker ORDER BY date) AS isl FROM d WHERE dd < -0.01) GROUP BY ticker, isl", **DD))
def drawdown_episodes(spark: SparkSession, root: str) -> DataFrame:
    e = M.drawdown_episodes(curves(spark, root), "nav")
    return e.select("strategy_id", "start", "end", num("max_dd").alias("max_dd"), F.col("days").cast("long").alias("days"))


@query("underwater_statistics", with_ctes(
    "bars", "SELECT ticker AS strategy_id, count(*) AS total_days, count(*) FILTER (dd < 0) AS underwater_days, round(count(*) FILTER (dd < 0) / count(*), 6) AS pct_underwater, "
    "max(rn - pk) AS longest_streak, round(coalesce(avg(dd) FILTER (dd < 0), 0), 6) AS avg_depth FROM "
    "(SELECT *, max(CASE WHEN dd >= 0 THEN rn END) OVER (PARTITION BY ticker ORDER BY date) AS pk FROM d) GROUP BY 1", **DD))
def underwater_statistics(spark: SparkSession, root: str) -> DataFrame:
    u = M.underwater(curves(spark, root), "nav")
    return u.select("strategy_id", "total_days", "underwater_days", num("pct_underwater").alias("pct_underwater"),
                    F.col("longest_streak").cast("long").alias("longest_streak"), num("avg_depth").alias("avg_depth"))


# --- cycles --------------------------------------------------------------------------------------------------------


def cycle_rows(spark: SparkSession, root: str) -> DataFrame:
    """Momentum value against the benchmark close on or before each rebalance."""
    curve = accounting.periodic_value(momentum_weights(spark, root), monthly(spark))
    b = benchmark_prices(bars_from_orders(spark, root), BENCH).select(F.lit(BENCH).alias("k"), "date", "price")
    marks = asof.markers(spark.range(1).select(F.lit(BENCH).alias("k")), schedule_days(START, END, "monthly"))
    seen = asof.as_of(b, marks, ["k"], ["price"], inclusive=True).select("as_of", F.col("price").alias("bench"))
    return M.cycles(curve.join(bounded(seen, DAYS), "as_of"))


@query("benchmark_price_fallback", with_ctes("bars", f"SELECT date, {q_sig('avg(close)', 9)} AS price FROM bars GROUP BY 1"))
def benchmark_price_fallback(spark: SparkSession, root: str) -> DataFrame:
    """A benchmark that the panel lacks: mean close of all tickers on each day."""
    return benchmark_prices(bars_from_orders(spark, root), "no such ticker").select("date", sig("price", 9).alias("price"))


CYC = dict(
    CSQL,
    bx="SELECT r.as_of, b.close AS bench FROM rebal r ASOF LEFT JOIN (SELECT date, close FROM bars WHERE ticker = 'Brand#1') b ON r.as_of >= b.date",
    cy="SELECT as_of AS start_date, lead(as_of) OVER w AS end_date, lead(nav) OVER w / nav - 1 AS sr, lead(bench) OVER w / bench - 1 AS br FROM curve JOIN bx USING (as_of) WINDOW w AS (ORDER BY as_of)",
    cc="SELECT *, sr - br AS ar FROM cy WHERE end_date IS NOT NULL",
)


@query("cycle_table", with_ctes(
    "px", "SELECT start_date, end_date, round(sr, 6) AS strat_return, round(br, 6) AS bench_return, round(ar, 6) AS active_return, ar > 0 AS is_win FROM cc", **CYC))
def cycle_table(spark: SparkSession, root: str) -> DataFrame:
    c = cycle_rows(spark, root)
    return c.select("start_date", "end_date", *[num(x).alias(x) for x in ("strat_return", "bench_return", "active_return")], "is_win")


@query("cycle_summary", with_ctes(
    "px", "SELECT count(*) AS total_cycles, count(*) FILTER (ar > 0) AS winning_cycles, count(*) FILTER (ar <= 0) AS losing_cycles, round(count(*) FILTER (ar > 0) / count(*), 6) AS win_rate, "
    "round(avg(ar), 6) AS avg_active_return, round(coalesce(avg(ar) FILTER (ar > 0), 0), 6) AS avg_win_return, round(coalesce(avg(ar) FILTER (ar <= 0), 0), 6) AS avg_loss_return, "
    "round(max(ar), 6) AS best_active_return, arg_max(start_date, ar) AS best_start, round(min(ar), 6) AS worst_active_return, arg_min(start_date, ar) AS worst_start, "
    "count(*) FILTER (ar > 0) / count(*) >= 0.8 AS meets_criterion FROM cc", **CYC))
def cycle_summary(spark: SparkSession, root: str) -> DataFrame:
    s = M.cycle_summary(cycle_rows(spark, root))
    return s.select("total_cycles", "winning_cycles", "losing_cycles", "best_start", "worst_start", "meets_criterion",
                    *[num(c).alias(c) for c in ("win_rate", "avg_active_return", "avg_win_return", "avg_loss_return", "best_active_return", "worst_active_return")])


# --- benchmarks ----------------------------------------------------------------------------------------------------


def _px_sql(cal: str) -> str:
    return (
        "SELECT *, lead(price) OVER (PARTITION BY ticker ORDER BY as_of) / price AS growth FROM (SELECT m.ticker, r.as_of, b.close AS price "
        f"FROM members m CROSS JOIN {cal} r ASOF LEFT JOIN bars b ON m.ticker = b.ticker AND r.as_of > b.date)"
    )


def _value_sql(w: str, cal: str, **more: str) -> str:
    """Cost-free curve of the weights ``w`` (as_of, ticker, weight, growth)."""
    return with_ctes(
        f"bars members {cal}",
        f"SELECT as_of, {q_sig('100000 * product(coalesce(g, 1)) OVER (ORDER BY as_of)')} AS nav FROM "
        "(SELECT as_of, lag(gross) OVER (ORDER BY as_of) AS g FROM (SELECT as_of, sum(weight * growth) AS gross FROM w GROUP BY 1))",
        p=_px_sql(cal), **more, w=w)


@query("benchmark_buy_and_hold", with_ctes(
    "bars members rebal_me", f"SELECT as_of, {q_sig('100000 * price / first_value(price) OVER (ORDER BY as_of)')} AS nav FROM p WHERE ticker = 'Brand#1' AND price IS NOT NULL",
    p=_px_sql("rebal_me")))
def benchmark_buy_and_hold(spark: SparkSession, root: str) -> DataFrame:
    return B.hold(priced(spark, root, "month_end"), BENCH, "bench:hold").select("as_of", sig("nav").alias("nav"))


@query("benchmark_fixed_mix", _value_sql(
    "SELECT as_of, ticker, growth, weight FROM (SELECT *, CASE ticker WHEN 'Brand#1' THEN CAST(0.6 AS DOUBLE) ELSE 0.4 END AS weight, count(price) OVER (PARTITION BY as_of) AS c "
    "FROM p WHERE ticker IN ('Brand#1', 'Brand#2')) WHERE c = 2", "rebal_qe"))
def benchmark_fixed_mix(spark: SparkSession, root: str) -> DataFrame:
    w = B.fixed_mix(priced(spark, root, "quarter_end"), {"Brand#1": 0.6, "Brand#2": 0.4}, "bench:60_40")
    return B.value(w, calendar(spark, "quarter_end")).select("as_of", sig("nav").alias("nav"))


@query("benchmark_equal_weight", _value_sql(
    "SELECT as_of, ticker, growth, 1.0 / count(*) OVER (PARTITION BY as_of) AS weight FROM p WHERE price > 0", "rebal_me"))
def benchmark_equal_weight(spark: SparkSession, root: str) -> DataFrame:
    w = B.equal_weight(priced(spark, root, "month_end"))
    return B.value(w, calendar(spark, "month_end")).select("as_of", sig("nav").alias("nav"))


@query("benchmark_perfect_foresight", _value_sql(
    "SELECT as_of, '*' AS ticker, sum(CAST(0.2 AS DOUBLE) * growth) FILTER (k <= 5) AS growth, 1.0 AS weight FROM k GROUP BY 1", "rebal_me",
    k="SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY growth DESC NULLS LAST, ticker) AS k FROM p"))
def benchmark_perfect_foresight(spark: SparkSession, root: str) -> DataFrame:
    w = B.perfect_foresight(priced(spark, root, "month_end"), 5)
    return B.value(w, calendar(spark, "month_end")).select("as_of", sig("nav").alias("nav"))


@query("benchmark_random_selection", with_ctes(
    "bars members rebal_me",
    f"SELECT as_of, {q_sig('avg(nav)', 7)} AS nav, {q_sig('stddev_samp(nav)', 7)} AS std FROM (SELECT trial, as_of, 100000 * product(coalesce(g, 1)) OVER (PARTITION BY trial ORDER BY as_of) AS nav FROM "
    "(SELECT trial, as_of, lag(gross) OVER (PARTITION BY trial ORDER BY as_of) AS g FROM (SELECT trial, as_of, sum(CAST(0.2 AS DOUBLE) * growth) AS gross FROM dr WHERE k <= 5 GROUP BY 1, 2))) GROUP BY 1",
    p=_px_sql("rebal_me"),
    dr="SELECT *, row_number() OVER (PARTITION BY trial, as_of ORDER BY md5('42|' || trial || '|' || as_of || '|' || ticker), ticker) AS k FROM p CROSS JOIN (SELECT unnest(range(100)) AS trial) WHERE price > 0"))
def benchmark_random_selection(spark: SparkSession, root: str) -> DataFrame:
    """Mean and deviation over 100 seeded random portfolios."""
    w = B.random_selection(priced(spark, root, "month_end"), 5, 100)
    s = B.random_summary(B.value(w, calendar(spark, "month_end")))
    return s.select("as_of", sig("nav", 7).alias("nav"), sig("std", 7).alias("std"))


def benchmark_set(spark: SparkSession, root: str) -> DataFrame:
    """Strategy and benchmark curves on the same month-end dates, under one key."""
    p, cal = priced(spark, root, "month_end"), calendar(spark, "month_end")
    weights = [B.equal_weight(p), B.perfect_foresight(p, 5)]
    cols = ["strategy_id", "as_of", "ticker", "weight", "growth"]
    w = weights[0].select(*cols).unionByName(weights[1].select(*cols))
    return B.value(w, cal).unionByName(B.hold(p, BENCH, "bench:hold"))


@query("benchmark_set_comparison", with_ctes(
    "bars members rebal_me",
    f"SELECT strategy_id, {q_sig('arg_max(nav, as_of) / 100000 - 1')} AS total_return, round(avg(r) / stddev_samp(r) * sqrt(12), 6) AS sharpe, round(stddev_samp(r) * sqrt(12), 6) AS volatility "
    "FROM (SELECT *, nav / lag(nav) OVER (PARTITION BY strategy_id ORDER BY as_of) - 1 AS r FROM c) GROUP BY 1",
    p=_px_sql("rebal_me"),
    k="SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY growth DESC NULLS LAST, ticker) AS k FROM p",
    g="SELECT 'bench:equal_weight' AS strategy_id, as_of, avg(coalesce(growth, 0)) AS gross FROM p WHERE price > 0 GROUP BY 1, 2 UNION ALL "
    "SELECT 'bench:foresight', as_of, sum(CAST(0.2 AS DOUBLE) * growth) FILTER (k <= 5) FROM k GROUP BY 1, 2",
    c="SELECT strategy_id, as_of, 100000 * product(coalesce(g, 1)) OVER (PARTITION BY strategy_id ORDER BY as_of) AS nav FROM "
    "(SELECT *, lag(gross) OVER (PARTITION BY strategy_id ORDER BY as_of) AS g FROM g) UNION ALL "
    "SELECT 'bench:hold', as_of, 100000 * price / first_value(price) OVER (ORDER BY as_of) FROM p WHERE ticker = 'Brand#1' AND price IS NOT NULL"))
def benchmark_set_comparison(spark: SparkSession, root: str) -> DataFrame:
    c = benchmark_set(spark, root)
    p = M.performance(c.select("strategy_id", F.col("as_of").alias("date"), F.col("returns").alias("r")), 12.0)
    final = c.groupBy("strategy_id").agg((F.max_by("nav", "as_of") / 100_000.0 - 1.0).alias("growth"))
    return p.join(final, "strategy_id").select(
        "strategy_id", sig("growth").alias("total_return"), num("sharpe").alias("sharpe"), num("volatility").alias("volatility")
    )


def _beside_sql() -> str:
    """Five benchmarks and the strategy as curves (strategy_id, as_of, nav, ppy), then their statistics."""
    def lagged(name: str, gross: str) -> str:
        return (f"SELECT '{name}' AS strategy_id, as_of, 100000 * product(coalesce(g, 1)) OVER (ORDER BY as_of) AS nav, 12 AS ppy FROM "
                f"(SELECT as_of, lag(gross) OVER (ORDER BY as_of) AS g FROM ({gross}))")

    return with_ctes(
        "px rebal_qe",
        f"SELECT c.strategy_id, CASE WHEN c.strategy_id IN ('bench:random', 'bench:foresight') THEN any_value(bn.n) END AS n_selected, {q_sig('arg_max(nav, as_of) / 100000 - 1', 7)} AS total_return, "
        "round(avg(r) / stddev_samp(r) * sqrt(any_value(ppy)), 6) AS sharpe, round(stddev_samp(r) * sqrt(any_value(ppy)), 6) AS volatility "
        "FROM (SELECT *, nav / lag(nav) OVER (PARTITION BY strategy_id ORDER BY as_of) - 1 AS r FROM c) c CROSS JOIN bn GROUP BY c.strategy_id",
        **CSQL,
        bn="SELECT greatest(1, CAST(round_even(avg(n), 0) AS INTEGER)) AS n FROM (SELECT as_of, count(*) FILTER (ticker <> '$CASH$' AND weight > 0) AS n FROM w GROUP BY 1)",
        fk="SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY growth DESC NULLS LAST, ticker) AS k, count(growth) OVER (PARTITION BY as_of) AS known FROM pxn",
        dr="SELECT *, row_number() OVER (PARTITION BY trial, as_of ORDER BY md5('42|' || trial || '|' || as_of || '|' || ticker), ticker) AS k FROM pxn CROSS JOIN (SELECT unnest(range(100)) AS trial) WHERE price > 0",
        rg="SELECT trial, as_of, sum(growth) / any_value(n) AS gross FROM dr CROSS JOIN bn WHERE k <= n GROUP BY 1, 2",
        rn="SELECT as_of, 100000 * product(coalesce(g, 1)) OVER (PARTITION BY trial ORDER BY as_of) AS nav FROM (SELECT *, lag(gross) OVER (PARTITION BY trial ORDER BY as_of) AS g FROM rg)",
        pq=_px_sql("rebal_qe"),
        mx="SELECT as_of, sum(wt * growth) AS gross FROM (SELECT *, CASE ticker WHEN 'Brand#1' THEN 0.6 ELSE 0.4 END AS wt, count(price) OVER (PARTITION BY as_of) AS c FROM pq WHERE ticker IN ('Brand#1', 'Brand#2')) WHERE c = 2 GROUP BY 1",
        c="SELECT 'momentum' AS strategy_id, as_of, nav, 12 AS ppy FROM curve UNION ALL "
        "SELECT 'bench:hold', as_of, 100000 * price / first_value(price) OVER (ORDER BY as_of), 12 FROM px WHERE ticker = 'Brand#1' AND price IS NOT NULL UNION ALL "
        + lagged("bench:equal_weight", "SELECT as_of, avg(coalesce(growth, 0)) AS gross FROM pxn WHERE price > 0 GROUP BY 1") + " UNION ALL "
        + lagged("bench:foresight", "SELECT as_of, CASE WHEN any_value(known) >= any_value(n) THEN sum(growth) FILTER (k <= n) / any_value(n) ELSE 1 END AS gross FROM fk CROSS JOIN bn GROUP BY 1") + " UNION ALL "
        + lagged("bench:60_40", "SELECT * FROM mx").replace("12 AS ppy", "4 AS ppy") + " UNION ALL "
        "SELECT 'bench:random', as_of, avg(nav), 12 FROM rn GROUP BY as_of")


@query("benchmark_set_beside_strategy", _beside_sql())
def benchmark_set_beside_strategy(spark: SparkSession, root: str) -> DataFrame:
    """Five benchmarks on the strategy's schedule (the mix on quarter ends) beside it; random and foresight hold as many names as it does on average."""
    weights = durable(momentum_weights(spark, root))
    p, cal = durable(priced(spark, root, "monthly")), monthly(spark)
    like = B.like_strategy(p, weights)
    cols = ["strategy_id", "as_of", "nav"]
    rand = B.random_summary(B.value(B.random_selection(like, "n_selected", 100), cal))
    mix = B.value(B.fixed_mix(priced(spark, root, "quarter_end"), {"Brand#1": 0.6, "Brand#2": 0.4}, "bench:60_40"), calendar(spark, "quarter_end"))
    own = accounting.periodic_value(weights, cal)
    rest = [B.hold(p, BENCH, "bench:hold"), B.value(B.equal_weight(p), cal), B.value(B.foresight_like(like), cal), rand]

    def statistics(c: DataFrame, ppy: float) -> DataFrame:
        r = change(F.col("nav"), F.lag("nav").over(Window.partitionBy("strategy_id").orderBy("as_of")))
        final = c.groupBy("strategy_id").agg((F.max_by("nav", "as_of") / 100_000.0 - 1.0).alias("growth"))
        return M.performance(c.select("strategy_id", F.col("as_of").alias("date"), r.alias("r")), ppy).join(final, "strategy_id")

    monthly_ones = reduce(DataFrame.unionByName, [x.select(*cols) for x in [own, *rest]])
    s = statistics(monthly_ones, 12.0).unionByName(statistics(mix.select(*cols), 4.0))
    size = like.select("n_selected").limit(1)
    sized = F.col("strategy_id").isin("bench:random", "bench:foresight")
    return s.crossJoin(F.broadcast(size)).select(
        "strategy_id", F.when(sized, F.col("n_selected")).alias("n_selected"), sig("growth", 7).alias("total_return"), num("sharpe").alias("sharpe"), num("volatility").alias("volatility"))


# --- daily accounting ----------------------------------------------------------------------------------------------


@query("daily_value_curve", with_ctes(
    "rets px",
    f"SELECT d AS date, {q_sig('r')} AS r, round(sum(ln(1 + r)) OVER (ORDER BY d), 6) AS log_equity FROM "
    "(SELECT d, coalesce(pr.r, 0) - coalesce(c.cost, 0) AS r FROM days LEFT JOIN pr ON pr.date = d LEFT JOIN c ON c.date = d WHERE isodow(d) < 6)",
    **CSQL,
    iv="SELECT as_of, next_as_of FROM rebal",
    pos="SELECT w.ticker, w.weight, d AS date FROM w JOIN iv USING (as_of) JOIN days ON d > as_of AND d <= coalesce(next_as_of, DATE '2001-12-31') AND isodow(d) < 6",
    pr="SELECT p.date, sum(p.weight * x.r) AS r FROM pos p JOIN rets x ON x.ticker = p.ticker AND x.date = p.date GROUP BY 1",
    c="SELECT CAST(as_of + CASE WHEN isodow(as_of) = 5 THEN 3 ELSE 1 END AS DATE) AS date, turnover * 0.001 AS cost FROM turn"))
def daily_value_curve(spark: SparkSession, root: str) -> DataFrame:
    w = durable(momentum_weights(spark, root))
    paired = construction.paired(w, monthly(spark))
    c = accounting.daily_value(w, rets(spark, root), monthly(spark), costs.flat(paired), START, END)
    return c.select("date", sig("r").alias("r"), num("log_equity").alias("log_equity"))


@query("portfolio_daily_returns", with_ctes(
    "rets px", f"SELECT p.date, {q_sig('sum(coalesce(p.weight * x.r, 0))')} AS r FROM pos p LEFT JOIN rets x ON x.ticker = p.ticker AND x.date = p.date GROUP BY 1",
    **WSQL,
    pos="SELECT w.ticker, w.weight, d AS date FROM w JOIN rebal USING (as_of) JOIN days ON d > as_of AND d <= coalesce(next_as_of, DATE '2001-12-31') AND isodow(d) < 6"))
def portfolio_daily_returns(spark: SparkSession, root: str) -> DataFrame:
    pos = accounting.daily_positions(momentum_weights(spark, root), monthly(spark), END)
    return accounting.portfolio_returns(pos, rets(spark, root)).select("date", sig("r").alias("r"))


EXPERIMENT_COLS = {
    "total_return": "arg_max(eq, as_of) - 1",
    "cagr": "pow(arg_max(eq, as_of), 12.0 / count(*)) - 1",
    "sharpe": "coalesce(avg(r) / NULLIF(stddev_samp(r), 0) * sqrt(12), 0)",
    "sortino": "avg(r) * 12 / (stddev_samp(r) FILTER (r < 0) * sqrt(12))",
    "max_drawdown": "min(dd)",
    "volatility": "stddev_samp(r) * sqrt(12)",
    "win_rate": "avg(CASE WHEN r > 0 THEN 100.0 ELSE 0.0 END)",
    "total_costs": "(SELECT sum(cost) FROM curve)",
    "active_return": "product(1 + r) FILTER (b IS NOT NULL) - product(1 + b)",
    "information_ratio": "avg(r - b) * 12 / (stddev_samp(r - b) * sqrt(12))",
    "tracking_error": "stddev_samp(r - b) * sqrt(12)",
}


@query("experiment_metrics", with_ctes(
    "px", "SELECT (SELECT count(*) FROM curve) AS num_rebalances, " + ", ".join(f"{q_sig(x, 7)} AS {k}" for k, x in EXPERIMENT_COLS.items())
    + " FROM (SELECT *, eq / max(eq) OVER (ORDER BY as_of) - 1 AS dd FROM (SELECT *, product(1 + r) OVER (ORDER BY as_of) AS eq FROM ("
    "SELECT c.as_of, returns AS r, bench / lag(bench) OVER (ORDER BY c.as_of) - 1 AS b FROM curve c JOIN bx USING (as_of)) WHERE r IS NOT NULL))", **CYC))
def experiment_metrics(spark: SparkSession, root: str) -> DataFrame:
    """The whole bundle of an experiment: curve metrics, active metrics on the same dates, rebalances and costs."""
    curve = accounting.periodic_value(momentum_weights(spark, root), monthly(spark))
    bench = cycle_rows(spark, root).select(F.col("end_date").alias("date"), F.col("bench_return").alias("r"))
    j = accounting.experiment_bundle(curve, bench, 12.0)
    return j.select("num_rebalances", *[sig(c, 7).alias(c) for c in EXPERIMENT_COLS])

"""Registered queries: parameter grid, walk-forward, optimizer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwise.functions.dates import schedule_days, union_days
from panelwise.functions.exprs import change, num, sig
from panelwise.functions.joins import CONFIGS, bounded
from panelwise.operators import accounting, grid as G, metrics as M, regimes as R, walkforward as WF
from panelwise.operators.returns import benchmark_prices
from panelwise.operators.schedule_defaults import END, START
from panelwise.plans.catalog.metrics_q import priced
from panelwise.plans.catalog.portfolio_q import CSQL, monthly
from panelwise.plans.catalog.regimes_q import LABEL_SQL, labels, regimes_of
from panelwise.plans.catalog.signals_q import BENCH, SAFE, SAFE_SQL, momentum_weights
from panelwise.plans.optimizer import grid_curves
from panelwise.plans.registry import query
from panelwise.plans.sqlkit import sig as q_sig, with_ctes
from panelwise.sources.panel import bars_from_orders, members_from_orders
from panelwise.sources.storage import durable

# Nested universes of the panel: the first 8 and 16 brands, and all of them.
UNIVERSES = {"tier2": 8, "tier3": 16, "tier4": None}
# A universe of which the panel has no ticker: its configurations cannot be evaluated.
UNLISTED = "tier0"
FIRST, LAST = "1995-01-02", END


def universe_rows(spark: SparkSession, root: str) -> DataFrame:
    no = F.regexp_extract("ticker", r"(\d+)$", 1).cast("int")
    tiers = F.array(*[F.struct(F.lit(i).alias("universe_no"), F.lit(n).cast("int").alias("size")) for i, n in enumerate(UNIVERSES.values())])
    m = members_from_orders(spark, root).select("ticker", no.alias("no"), F.inline(tiers))
    return m.filter(F.col("size").isNull() | (F.col("no") <= F.col("size"))).select("universe_no", "ticker")


def curves(spark: SparkSession, root: str, schedules: list[str] | None = None, alphas: list[str] | None = None) -> DataFrame:
    names = schedules or list(G.GRIDS)
    return grid_curves(
        bars_from_orders(spark, root), members_from_orders(spark, root), universe_rows(spark, root),
        {s: schedule_days(START, END, s) for s in names}, G.param_sets(names, alphas), BENCH, list(SAFE),
    )


def configs(spark: SparkSession, schedules: list[str] | None = None, alphas: list[str] | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    return G.config_table(spark, G.param_sets(schedules, alphas), [*UNIVERSES, *more])


def evaluate(spark: SparkSession, root: str, curve: DataFrame, config: DataFrame) -> DataFrame:
    """Walk-forward results of the configurations, annualised by the periods of each one's schedule."""
    spans = WF.windows(FIRST, LAST)
    rows = WF.slice_returns(curve, spans).join(bounded(config.select("strategy_id", "periods_per_year"), CONFIGS), "strategy_id")
    bench = WF.benchmark_by_window(benchmark_prices(bars_from_orders(spark, root), BENCH), spans)
    return WF.aggregate(WF.window_results(WF.slice_metrics(rows, "periods_per_year"), bench), config)


# --- the whole grid: seven models, both schedules, three universes, three sizes -------------------------------------


def _sets_sql() -> str:
    """The parameter sets as rows: look-back, short look-back, days read, history test and what the models add."""
    rows = []
    for p in G.param_sets():
        q = p.params
        rows.append(
            f"({p.param_id}, '{p.schedule}', '{p.alpha}', '{p.label}', {p.lookback}, {q.get('short_lookback_days', 0)}, "
            f"{max(p.lookback, q.get('ma_period', 0), 252 if p.alpha == 'value_momentum' else 0) + 50}, {q['min_periods']}, "
            f"CAST({q.get('vol_floor', 0)} AS DOUBLE), CAST({q.get('risk_free_rate', 0)} AS DOUBLE) * {p.lookback} / 252, "
            f"CAST({q.get('momentum_weight', 0.5)} AS DOUBLE), {q.get('ma_period', 0)}, CAST({G.PERIODS[p.schedule]} AS DOUBLE), {p.warmup_days})")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(pid, sch, alpha, label, ll, sl, rd, mp, floor_, hurdle, mw, ma, ppy, wd)"


def _windows_sql() -> str:
    rows = [f"({s.window_id}, DATE '{s.train_start}', DATE '{s.train_end}', DATE '{s.test_start}', DATE '{s.test_end}')" for s in WF.windows(FIRST, LAST)]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(wid, a, b, c, d)"


# Closes are found by their age and statistics by the days read, so the check shares no plan with the running frames.
GRID_SQL = dict(
    ps=_sets_sql(), ws=_windows_sql(),
    cal="SELECT 'monthly' AS sch, as_of, prev_as_of, next_as_of FROM rebal UNION ALL SELECT 'weekly', as_of, prev_as_of, next_as_of FROM rebal_w",
    dts="SELECT DISTINCT as_of FROM cal",
    wn="SELECT m.ticker, r.as_of, b.close, b.date, b.r, r.as_of - b.date AS back, row_number() OVER (PARTITION BY m.ticker, r.as_of ORDER BY b.date DESC) AS k "
    "FROM members m CROSS JOIN dts r JOIN rets b ON b.ticker = m.ticker AND b.date < r.as_of AND b.date >= r.as_of - 302",
    rds="SELECT DISTINCT rd FROM ps",
    cn="SELECT ticker, as_of, rd, count(*) AS n FROM wn JOIN rds ON back <= rd GROUP BY 1, 2, 3",
    stt="SELECT cn.ticker, cn.as_of, cn.rd, any_value(n) AS n, count(w.r) FILTER (w.k < least(n, cn.rd - 50)) AS nv, stddev_samp(w.r) FILTER (w.k < least(n, cn.rd - 50)) AS sd, "
    "regr_count(w.r, b.r) FILTER (w.k < n) AS nb, regr_intercept(w.r, b.r) FILTER (w.k < n) AS ic "
    "FROM cn JOIN wn w ON w.ticker = cn.ticker AND w.as_of = cn.as_of AND w.k <= cn.n LEFT JOIN bench b ON b.date = w.date GROUP BY 1, 2, 3",
    en="SELECT ps.*, t.ticker, t.as_of, t.n, t.nv, t.sd, t.nb, t.ic, CASE WHEN t.n >= mp AND t.n >= 2 THEN l.close END AS pl, f.close AS pf, g.close AS pg, v.close AS pv "
    "FROM ps JOIN cal c ON c.sch = ps.sch JOIN stt t ON t.as_of = c.as_of AND t.rd = ps.rd "
    "JOIN wn l ON l.ticker = t.ticker AND l.as_of = t.as_of AND l.k = 1 JOIN wn f ON f.ticker = t.ticker AND f.as_of = t.as_of AND f.k = least(t.n, ps.ll) "
    "LEFT JOIN wn g ON g.ticker = t.ticker AND g.as_of = t.as_of AND g.k = least(t.n, ps.sl) LEFT JOIN wn v ON v.ticker = t.ticker AND v.as_of = t.as_of AND v.k = least(t.n, 252)",
    sc="SELECT pid, ticker, as_of, CASE alpha WHEN 'momentum_acceleration' THEN (pl / pg - 1) - (pl / pf - 1) "
    "WHEN 'vol_adjusted_momentum' THEN CASE WHEN nv >= 10 THEN (pl / pf - 1) / greatest(sd * sqrt(252), floor_) END "
    "WHEN 'residual_momentum' THEN CASE WHEN ticker <> 'Brand#1' AND nb >= mp THEN ic * nb END ELSE pl / pf - 1 END AS s, pl / pv - 1 AS v FROM en",
    tf="SELECT ma, as_of, CASE WHEN count(*) = any_value(ma) THEN arg_max(close, date) > avg(close) ELSE TRUE END AS bull FROM (SELECT DISTINCT ma FROM ps WHERE ma > 0) JOIN "
    "(SELECT r.as_of, b.close, b.date, row_number() OVER (PARTITION BY r.as_of ORDER BY b.date DESC) AS k FROM dts r JOIN bars b ON b.ticker = 'Brand#1' AND b.date < r.as_of) ON k <= ma GROUP BY 1, 2",
    uv="SELECT ticker, CAST(substr(ticker, 7) AS INTEGER) AS no FROM members",
    un="SELECT t.un, t.uname, u.ticker FROM uv u JOIN (VALUES (0, 'tier2', 8), (1, 'tier3', 16), (2, 'tier4', NULL)) t(un, uname, sz) ON t.sz IS NULL OR u.no <= t.sz",
    raw=f"SELECT p.pid, p.sch, p.alpha, p.mw / (p.mw + 0.5) AS mw, un.un, un.ticker, c.as_of, s.s, s.v, coalesce(tf.bull, TRUE) AS bull, CASE WHEN un.ticker IN {SAFE_SQL} THEN 1.0 ELSE 0.0 END AS safe, "
    f"coalesce(s.s > p.hurdle, FALSE) AND un.ticker NOT IN {SAFE_SQL} AS pass FROM ps p JOIN cal c ON c.sch = p.sch CROSS JOIN un "
    "LEFT JOIN sc s ON s.pid = p.pid AND s.ticker = un.ticker AND s.as_of = c.as_of LEFT JOIN tf ON tf.ma = p.ma AND tf.as_of = c.as_of",
    zs="SELECT *, bool_or(pass) OVER g AS on_, CASE WHEN s IS NOT NULL THEN coalesce((s - avg(s) OVER g) / NULLIF(stddev_samp(s) OVER g, 0), 0) END AS z1, "
    "CASE WHEN v IS NOT NULL THEN coalesce((avg(v) OVER g - v) / NULLIF(stddev_samp(v) OVER g, 0), 0) END AS z2 FROM raw WINDOW g AS (PARTITION BY pid, un, as_of)",
    fs="SELECT pid, sch, un, ticker, as_of, CASE alpha WHEN 'trend_filtered_momentum' THEN CASE WHEN bull THEN s ELSE safe END "
    "WHEN 'dual_momentum' THEN CASE WHEN NOT on_ THEN safe WHEN pass THEN s ELSE 0.0 END WHEN 'value_momentum' THEN mw * z1 + (1 - mw) * z2 ELSE s END AS score FROM zs",
    rk="SELECT *, row_number() OVER (PARTITION BY pid, un, as_of ORDER BY score DESC NULLS LAST, ticker) AS k FROM fs",
    fan="SELECT rk.*, t.tn, pid * 1000 + un * 100 + tn AS sid FROM rk JOIN (VALUES (3), (5), (7)) t(tn) ON rk.k <= t.tn",
    w="SELECT sid, sch, as_of, ticker, 1.0 / tn AS weight FROM fan WHERE score IS NOT NULL UNION ALL "
    "SELECT sid, sch, as_of, '$CASH$', (tn - count(score)) / CAST(tn AS DOUBLE) FROM fan GROUP BY sid, sch, as_of, tn HAVING count(score) < tn",
    aw="SELECT w.*, c.next_as_of FROM w JOIN cal c ON c.sch = w.sch AND c.as_of = w.as_of",
    pv="SELECT sid, next_as_of AS as_of, ticker, weight FROM aw WHERE next_as_of IS NOT NULL UNION ALL "
    "SELECT DISTINCT sid, as_of, '$CASH$', CAST(1.0 AS DOUBLE) FROM aw WHERE as_of = (SELECT min(as_of) FROM cal WHERE cal.sch = aw.sch)",
    tn="SELECT coalesce(a.sid, p.sid) AS sid, coalesce(a.as_of, p.as_of) AS as_of, 0.5 * sum(abs(coalesce(a.weight, 0) - coalesce(p.weight, 0))) AS turnover "
    "FROM aw a FULL JOIN pv p ON a.sid = p.sid AND a.as_of = p.as_of AND a.ticker = p.ticker GROUP BY 1, 2",
    pxa="SELECT m.ticker, c.sch, c.as_of, b.close AS price FROM members m CROSS JOIN cal c ASOF LEFT JOIN bars b ON m.ticker = b.ticker AND c.as_of > b.date",
    pxn="SELECT *, lead(price) OVER (PARTITION BY sch, ticker ORDER BY as_of) / price AS growth FROM pxa",
    gr="SELECT sid, a.next_as_of AS as_of, sum(a.weight * CASE WHEN a.ticker = '$CASH$' THEN 1 ELSE p.growth END) AS gross FROM aw a LEFT JOIN pxn p ON a.sch = p.sch AND a.as_of = p.as_of AND a.ticker = p.ticker GROUP BY 1, 2",
    rt="SELECT t.sid, t.as_of, ps.sch, ps.ppy, g.gross * (1 - t.turnover * 0.001) - 1 AS r, lag(t.as_of) OVER (PARTITION BY t.sid ORDER BY t.as_of) AS pa "
    "FROM tn t JOIN ps ON ps.pid = t.sid // 1000 LEFT JOIN gr g ON t.sid = g.sid AND t.as_of = g.as_of",
    sl="SELECT sid, wid, ph, as_of, r, ppy FROM (SELECT *, unnest([CASE WHEN as_of <= b THEN 'train' END, CASE WHEN as_of >= c THEN 'test' END]) AS ph FROM rt JOIN ws ON pa >= a AND as_of <= d WHERE r IS NOT NULL) WHERE ph IS NOT NULL",
    sm="SELECT sid, wid, ph, count(*) AS n, product(1 + r) - 1 AS tr, any_value(ppy) AS ppy, stddev_samp(r) * sqrt(any_value(ppy)) AS vol FROM sl GROUP BY 1, 2, 3",
    sm2="SELECT *, CASE WHEN n >= 2 AND vol > 0 THEN (pow(1 + tr, ppy / n) - 1) / vol ELSE 0 END AS sh FROM sm",
    bw="SELECT wid, arg_max(close, date) / arg_min(close, date) - 1 AS br FROM bars JOIN ws ON date >= c AND date < d WHERE ticker = 'Brand#1' GROUP BY 1",
    wr="SELECT sid, wid, max(tr) FILTER (ph = 'train') AS ir, max(sh) FILTER (ph = 'train') AS ish, max(tr) FILTER (ph = 'test') AS orr, max(sh) FILTER (ph = 'test') AS osh, any_value(br) AS br FROM sm2 JOIN bw USING (wid) GROUP BY 1, 2",
    agg="SELECT sid, count(*) AS num_windows, avg(osh) AS oos_sharpe_mean, avg(orr) AS oos_return_mean, avg(orr - br) AS act, avg(CASE WHEN orr > br THEN 1.0 ELSE 0.0 END) AS wr, avg(ish) AS is_sharpe_mean FROM wr GROUP BY 1",
    nm="SELECT DISTINCT p.pid * 1000 + u.un * 100 + t.tn AS sid, p.sch, p.alpha, p.label || '_top' || t.tn || '_' || u.uname || '_' || p.sch AS config_name FROM ps p CROSS JOIN (SELECT DISTINCT un, uname FROM un) u CROSS JOIN (VALUES (3), (5), (7)) t(tn)",
)
GRID_INPUTS = "rets bench members rebal rebal_w"
RANKED_SQL = f"row_number() OVER (ORDER BY {q_sig('sc', 10)} DESC, sid)"


@query("grid_walk_forward", with_ctes(
    GRID_INPUTS, f"SELECT config_name, num_windows, {q_sig('oos_sharpe_mean', 7)} AS oos_sharpe_mean, {q_sig('oos_return_mean', 7)} AS oos_return_mean, {q_sig('act', 7)} AS oos_active_return_mean, round(wr, 6) AS oos_win_rate, "
    f"{q_sig('is_sharpe_mean', 7)} AS is_sharpe_mean, {q_sig('4.0 * act + 0.3 * oos_sharpe_mean + 0.3 * wr', 7)} AS composite_score FROM agg JOIN nm USING (sid)", **GRID_SQL))
def grid_walk_forward(spark: SparkSession, root: str) -> DataFrame:
    """All 1,314 configurations of seven models, both schedules, three universes and three sizes, walk-forward evaluated."""
    a = evaluate(spark, root, curves(spark, root), configs(spark))
    return a.select("config_name", "num_windows", num("oos_win_rate").alias("oos_win_rate"), *[
        sig(c, 7).alias(c) for c in ("oos_sharpe_mean", "oos_return_mean", "oos_active_return_mean", "is_sharpe_mean", "composite_score")])


@query("grid_winners", with_ctes(
    GRID_INPUTS, f"SELECT config_name, {q_sig('sc', 7)} AS composite_score, {RANKED_SQL} AS \"rank\" FROM (SELECT *, 4.0 * act + 0.3 * oos_sharpe_mean + 0.3 * wr AS sc FROM agg JOIN nm USING (sid)) WHERE act > 0", **GRID_SQL))
def grid_winners(spark: SparkSession, root: str) -> DataFrame:
    """Configurations whose out-of-sample active return is positive, best first."""
    w = WF.rank(evaluate(spark, root, curves(spark, root), configs(spark)).filter(F.col("oos_active_return_mean") > 0))
    return w.select("config_name", sig("composite_score", 7).alias("composite_score"), F.col("rank").cast("long").alias("rank"))


@query("grid_config_counts", with_ctes(
    "members", "SELECT sch AS schedule, alpha, count(*) AS n FROM ps CROSS JOIN (SELECT DISTINCT un FROM un) CROSS JOIN (VALUES (3), (5), (7)) t(tn) GROUP BY 1, 2",
    **{k: GRID_SQL[k] for k in ("ps", "uv", "un")}))
def grid_config_counts(spark: SparkSession, root: str) -> DataFrame:
    """Configurations per schedule and model over the universes that have members in the panel."""
    live = universe_rows(spark, root).select("universe_no").distinct()
    return G.config_counts(configs(spark).join(live, "universe_no", "left_semi"))


def optimizer_results(spark: SparkSession, root: str) -> DataFrame:
    return WF.rank(evaluate(spark, root, curves(spark, root), configs(spark)))


@query("optimizer_full_grid", with_ctes(
    GRID_INPUTS, f"SELECT CAST({RANKED_SQL} AS INTEGER) AS \"rank\", config_name, num_windows, {q_sig('oos_sharpe_mean', 7)} AS oos_sharpe_mean, {q_sig('oos_return_mean', 7)} AS oos_return_mean, "
    f"{q_sig('act', 7)} AS oos_active_return_mean, round(wr, 6) AS oos_win_rate, {q_sig('sc', 7)} AS composite_score, act > 0 AS is_winner FROM (SELECT *, 4.0 * act + 0.3 * oos_sharpe_mean + 0.3 * wr AS sc FROM agg JOIN nm USING (sid))", **GRID_SQL))
def optimizer_full_grid(spark: SparkSession, root: str) -> DataFrame:
    """All 1,314 configurations, evaluated and ranked in one plan."""
    r = optimizer_results(spark, root)
    return r.select("rank", "config_name", "num_windows", num("oos_win_rate").alias("oos_win_rate"), "is_winner", *[
        sig(c, 7).alias(c) for c in ("oos_sharpe_mean", "oos_return_mean", "oos_active_return_mean", "composite_score")])


# --- one strategy, window by window --------------------------------------------------------------------------------


def momentum_curve(spark: SparkSession, root: str) -> DataFrame:
    return accounting.periodic_value(momentum_weights(spark, root), monthly(spark))


ONE = dict(
    CSQL, ws=_windows_sql(),
    rt="SELECT as_of, returns AS r, lag(as_of) OVER (ORDER BY as_of) AS pa FROM curve",
    sl="SELECT wid, ph, as_of, r FROM (SELECT *, unnest([CASE WHEN as_of <= b THEN 'train' END, CASE WHEN as_of >= c THEN 'test' END]) AS ph FROM rt JOIN ws ON pa >= a AND as_of <= d WHERE r IS NOT NULL) WHERE ph IS NOT NULL",
    cm="SELECT *, product(1 + r) OVER (PARTITION BY wid, ph ORDER BY as_of) AS cum FROM sl",
    cd="SELECT *, cum / max(cum) OVER (PARTITION BY wid, ph ORDER BY as_of) - 1 AS dd FROM cm",
    sm="SELECT wid, ph, count(*) AS n, arg_max(cum, as_of) - 1 AS tr, stddev_samp(r) * sqrt(252) AS vol, min(dd) AS dd FROM cd GROUP BY 1, 2",
    sm2="SELECT *, CASE WHEN vol > 0 THEN (pow(1 + tr, 252.0 / n) - 1) / vol ELSE 0 END AS sh FROM sm",
    bw="SELECT wid, arg_max(close, date) / arg_min(close, date) - 1 AS br FROM bars JOIN ws ON date >= c AND date < d WHERE ticker = 'Brand#1' GROUP BY 1",
)


@query("walk_forward_window_table", with_ctes(
    "px", f"SELECT wid AS window_id, {q_sig('max(tr) FILTER (ph = {t})')} AS is_return, {q_sig('max(sh) FILTER (ph = {t})', 7)} AS is_sharpe, {q_sig('max(tr) FILTER (ph = {o})')} AS oos_return, "
    f"{q_sig('max(sh) FILTER (ph = {o})', 7)} AS oos_sharpe, {q_sig('max(vol) FILTER (ph = {o})')} AS oos_volatility, round(max(dd) FILTER (ph = {{o}}), 6) AS oos_max_drawdown, {q_sig('any_value(br)')} AS bench_return "
    "FROM sm2 JOIN bw USING (wid) GROUP BY 1".replace("{t}", "'train'").replace("{o}", "'test'"), **ONE).replace("{t}", "'train'").replace("{o}", "'test'"))
def walk_forward_window_table(spark: SparkSession, root: str) -> DataFrame:
    spans = WF.windows(FIRST, LAST)
    m = WF.slice_metrics(WF.slice_returns(momentum_curve(spark, root), spans))
    w = WF.window_results(m, WF.benchmark_by_window(benchmark_prices(bars_from_orders(spark, root), BENCH), spans))
    return w.select(F.col("window_id").cast("long").alias("window_id"), sig("is_return").alias("is_return"), sig("is_sharpe", 7).alias("is_sharpe"),
                    sig("oos_return").alias("oos_return"), sig("oos_sharpe", 7).alias("oos_sharpe"), sig("oos_volatility").alias("oos_volatility"),
                    num("oos_max_drawdown").alias("oos_max_drawdown"), sig("bench_return").alias("bench_return"))


def fresh_runs(spark: SparkSession, root: str) -> DataFrame:
    """Train and test of every window as separate runs that start in cash: (strategy_id, as_of, nav, ...)."""
    spans = WF.windows(FIRST, LAST, train_years=2)
    days = schedule_days(START, END, "monthly")
    runs = F.array(*[
        F.struct(F.lit(s.window_id * 2 + i).alias("run"), F.lit(a).alias("run_from"), F.lit(b).alias("run_end"))
        for s in spans for i, (a, b) in enumerate([(s.train_start, s.train_end), (s.test_start, s.test_end)])
    ])
    w = momentum_weights(spark, root).select("as_of", "ticker", "weight", "price", "growth", F.inline(F.filter(
        runs, lambda r: F.col("as_of").between(r["run_from"], r["run_end"]))))
    start = F.array_min(F.filter(days, lambda d: d >= F.col("run_from")))
    w = w.withColumns({"strategy_id": F.col("run").cast("string"), "run_start": start})
    return accounting.periodic_value(w, monthly(spark))


def _runs_sql() -> str:
    rows = []
    for s in WF.windows(FIRST, LAST, train_years=2):
        rows += [f"({s.window_id}, 'is', DATE '{s.train_start}', DATE '{s.train_end}')", f"({s.window_id}, 'oos', DATE '{s.test_start}', DATE '{s.test_end}')"]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(wid, ph, a, b)"


FRESH = dict(
    CSQL, rs=_runs_sql(),
    c0="SELECT wid, ph, c.as_of, gross, turnover, row_number() OVER (PARTITION BY wid, ph ORDER BY c.as_of) AS k FROM curve0 c JOIN rs ON c.as_of BETWEEN a AND b",
    ft="SELECT w.as_of, 1 - coalesce(sum(weight) FILTER (ticker = '$CASH$'), 0) AS t0 FROM w GROUP BY 1",
    c1="SELECT c0.*, CASE WHEN k = 1 THEN 1 - t0 * 0.001 ELSE gross * (1 - turnover * 0.001) END AS f, CASE WHEN k > 1 THEN gross * (1 - turnover * 0.001) - 1 END AS r FROM c0 JOIN ft USING (as_of)",
    c2="SELECT *, product(f) OVER (PARTITION BY wid, ph ORDER BY as_of) AS nav FROM c1",
    c3="SELECT *, nav / max(nav) OVER (PARTITION BY wid, ph ORDER BY as_of) - 1 AS dd FROM c2",
    m0="SELECT wid, ph, arg_max(nav, as_of) - 1 AS tr, coalesce(avg(r) / NULLIF(stddev_samp(r), 0) * sqrt(12), 0) AS sh, min(dd) AS dd FROM c3 GROUP BY 1, 2",
    m1="SELECT wid, max(tr) FILTER (ph = 'is') AS ir, max(tr) FILTER (ph = 'oos') AS orr, max(sh) FILTER (ph = 'is') AS ish, max(sh) FILTER (ph = 'oos') AS osh, max(dd) FILTER (ph = 'is') AS idd, max(dd) FILTER (ph = 'oos') AS odd FROM m0 GROUP BY 1",
)


def fresh_results(spark: SparkSession, root: str) -> DataFrame:
    s = accounting.run_summary(fresh_runs(spark, root)).withColumn("run", F.col("strategy_id").cast("int"))
    phase = F.when(F.col("run") % 2 == 0, "is").otherwise("oos")
    s = s.withColumns({"window_id": F.floor(F.col("run") / 2).cast("int"), "phase": phase})

    def pick(p: str, c: str):
        return F.max(F.when(F.col("phase") == p, F.col(c)))

    return s.groupBy("window_id").agg(*[
        pick(p, c).alias(f"{p}_{n}") for p in ("is", "oos") for c, n in (("total_return", "return"), ("sharpe_ratio", "sharpe"), ("max_drawdown", "drawdown"))
    ]).withColumn("strategy_id", F.lit("momentum"))


@query("walk_forward_fresh_windows", with_ctes(
    "px", f"SELECT wid AS window_id, {q_sig('ir')} AS is_return, {q_sig('orr')} AS oos_return, round(ish, 6) AS is_sharpe, round(osh, 6) AS oos_sharpe, round(idd, 6) AS is_drawdown, round(odd, 6) AS oos_drawdown FROM m1", **FRESH))
def walk_forward_fresh_windows(spark: SparkSession, root: str) -> DataFrame:
    f = fresh_results(spark, root)
    return f.select(F.col("window_id").cast("long").alias("window_id"), sig("is_return").alias("is_return"), sig("oos_return").alias("oos_return"),
                    *[num(c).alias(c) for c in ("is_sharpe", "oos_sharpe", "is_drawdown", "oos_drawdown")])


STAB = {
    "is_sharpe_mean": "avg(ish)", "is_sharpe_std": "stddev_samp(ish)", "is_sharpe_median": "quantile_cont(ish, 0.5)", "is_sharpe_cv": "abs(stddev_samp(ish) / NULLIF(avg(ish), 0))",
    "oos_sharpe_mean": "avg(osh)", "oos_sharpe_std": "stddev_samp(osh)", "oos_sharpe_median": "quantile_cont(osh, 0.5)", "oos_sharpe_cv": "abs(stddev_samp(osh) / NULLIF(avg(osh), 0))",
    "is_return_mean": "avg(ir)", "oos_return_mean": "avg(orr)", "is_drawdown_mean": "avg(idd)", "oos_drawdown_mean": "avg(odd)", "sharpe_degradation": "avg(ish - osh)",
    "sharpe_degradation_std": "stddev_samp(ish - osh)", "return_degradation": "avg(ir - orr)", "pct_oos_positive": "avg(CASE WHEN orr > 0 THEN 1.0 ELSE 0.0 END)",
    "pct_oos_beats_is": "avg(CASE WHEN osh > ish THEN 1.0 ELSE 0.0 END)", "oos_sharpe_positive_pct": "avg(CASE WHEN osh > 0 THEN 1.0 ELSE 0.0 END)",
}


@query("walk_forward_stability", with_ctes(
    "px", "SELECT count(*) AS num_windows, " + ", ".join(f"{q_sig(v, 7)} AS {k}" for k, v in STAB.items()) + " FROM m1", **FRESH))
def walk_forward_stability(spark: SparkSession, root: str) -> DataFrame:
    s = WF.stability(fresh_results(spark, root))
    return s.select("num_windows", *[sig(c, 7).alias(c) for c in STAB])


# --- multi-period --------------------------------------------------------------------------------------------------

PERIOD_YEARS = [3, 5, 10]


def benchmark_at(spark: SparkSession, root: str, schedule: str) -> DataFrame:
    """Benchmark return between decision dates, from the same last-known closes as the strategies."""
    p = priced(spark, root, schedule).filter(F.col("ticker") == BENCH)
    from pyspark.sql import Window

    w = Window.partitionBy("ticker").orderBy("as_of")
    return p.select(F.col("as_of").alias("date"), change("price", F.lag("price").over(w)).alias("r"))


def multi_period(spark: SparkSession, root: str) -> DataFrame:
    """Each configuration over the last 3, 5 and 10 years; failed periods stay as rows."""
    from pyspark.sql import Window

    config = configs(spark, more=(UNLISTED,))
    # Both schedules read the curves, which are small whatever the panel: one row per configuration and date.
    curve = durable(curves(spark, root))
    by = Window.partitionBy("strategy_id").orderBy("as_of")
    r = curve.select("strategy_id", F.col("as_of").alias("date"), F.col("returns").alias("r"), F.lag("as_of").over(by).alias("prev"))
    r = r.join(bounded(config.select("strategy_id", "schedule", "warmup_days"), CONFIGS), "strategy_id")
    years = F.array(*[F.lit(y) for y in PERIOD_YEARS])
    begin = F.date_sub(F.lit(LAST).cast("date"), F.col("years") * 365 + F.col("warmup_days"))
    sliced = r.select("*", F.explode(years).alias("years")).filter(F.col("prev") >= begin)
    a = reduce(DataFrame.unionByName, [
        M.active(sliced.filter(F.col("schedule") == s), benchmark_at(spark, root, s), float(ppy), keys=("strategy_id", "years"))
        for s, ppy in G.PERIODS.items()])
    grid = config.select("strategy_id", "config_name", F.explode(years).alias("years"))
    j = grid.join(a, ["strategy_id", "years"], "left")
    ok = F.col("n").isNotNull()
    low = F.lit(float("-inf"))
    return j.select(
        "strategy_id", "config_name", "years", ok.alias("evaluation_success"),
        F.coalesce("strategy_total_return", low).alias("strategy_return"), F.coalesce("benchmark_total_return", F.lit(0.0)).alias("bench_return"),
        F.coalesce("active_return", low).alias("active_return"), F.coalesce("information_ratio", low).alias("information_ratio"),
        F.coalesce("tracking_error", F.lit(float("inf"))).alias("tracking_error"), F.coalesce("strategy_max_dd", F.lit(-1.0)).alias("max_drawdown"),
        F.coalesce("strategy_sharpe", low).alias("sharpe_ratio"), F.coalesce("n", F.lit(0)).alias("num_periods"),
    )


MP_SQL = dict(
    GRID_SQL,
    bx="SELECT sch, as_of, price / lag(price) OVER (PARTITION BY sch ORDER BY as_of) - 1 AS b FROM pxa WHERE ticker = 'Brand#1'",
    mp="SELECT rt.sid, y.y AS years, rt.as_of, rt.r, bx.b, ps.ppy FROM rt JOIN ps ON ps.pid = rt.sid // 1000 CROSS JOIN (VALUES (3), (5), (10)) y(y) JOIN bx ON bx.sch = rt.sch AND bx.as_of = rt.as_of "
    f"WHERE rt.r IS NOT NULL AND bx.b IS NOT NULL AND rt.pa >= DATE '{LAST}' - (y.y * 365 + wd)",
    ms="SELECT sid, years, count(*) AS n, product(1 + r) - product(1 + b) AS act, avg(r - b) * any_value(ppy) / (stddev_samp(r - b) * sqrt(any_value(ppy))) AS ir, product(1 + r) - 1 AS tr, avg(r) / NULLIF(stddev_samp(r), 0) * sqrt(any_value(ppy)) AS sh FROM mp GROUP BY 1, 2",
    nmx=f"SELECT sid, config_name FROM nm UNION ALL SELECT p.pid * 1000 + 300 + t.tn, p.label || '_top' || t.tn || '_{UNLISTED}_' || p.sch FROM ps p CROSS JOIN (VALUES (3), (5), (7)) t(tn)",
    me="SELECT nmx.sid, config_name, y.y AS years, n, tr, act, ir, sh FROM nmx CROSS JOIN (VALUES (3), (5), (10)) y(y) LEFT JOIN ms ON ms.sid = nmx.sid AND ms.years = y.y",
)
NEVER = "CAST('-infinity' AS DOUBLE)"


def _finite(c: str, value: Column) -> Column:
    """The value rounded, and minus infinity, which has no digits, as it is."""
    return F.when(F.col(c) == float("-inf"), F.col(c)).otherwise(value).alias(c)


@query("multi_period_evaluation", with_ctes(
    GRID_INPUTS, f"SELECT config_name, CAST(years AS BIGINT) AS years, n IS NOT NULL AS evaluation_success, coalesce({q_sig('tr', 7)}, {NEVER}) AS strategy_return, coalesce({q_sig('act', 7)}, {NEVER}) AS active_return, "
    f"coalesce(round(ir, 6), {NEVER}) AS information_ratio, CASE WHEN n IS NULL THEN {NEVER} ELSE round(coalesce(sh, 0), 6) END AS sharpe_ratio, coalesce(n, 0) AS num_periods FROM me", **MP_SQL))
def multi_period_evaluation(spark: SparkSession, root: str) -> DataFrame:
    """Every configuration and period; those of a universe without tickers failed."""
    m = multi_period(spark, root)
    return m.select("config_name", F.col("years").cast("long").alias("years"), "evaluation_success", "num_periods",
                    *[_finite(c, sig(c, 7)) for c in ("strategy_return", "active_return")], *[_finite(c, num(c)) for c in ("information_ratio", "sharpe_ratio")])


@query("multi_period_composite", with_ctes(
    GRID_INPUTS, f"SELECT config_name, beats AS beats_all_periods, coalesce(round(m - 0.5 * sp + CASE WHEN beats THEN 0.5 ELSE 0 END, 6), {NEVER}) AS composite_score FROM "
    "(SELECT config_name, bool_and(n IS NOT NULL AND act > 0 AND ir > 0) AS beats, avg(ir) AS m, stddev_pop(ir) AS sp FROM me GROUP BY 1)", **MP_SQL))
def multi_period_composite(spark: SparkSession, root: str) -> DataFrame:
    m = multi_period(spark, root)
    c = WF.period_composite(m).join(bounded(configs(spark, more=(UNLISTED,)).select("strategy_id", "config_name"), CONFIGS), "strategy_id")
    return c.select("config_name", "beats_all_periods", _finite("composite_score", num("composite_score")))


def grid_returns(spark: SparkSession, root: str) -> DataFrame:
    c = curves(spark, root)
    return c.select("strategy_id", F.col("as_of").alias("date"), F.col("returns").alias("r"))


@query("trailing_window_scores", with_ctes(
    GRID_INPUTS, f"SELECT config_name, count(*) AS n, CASE WHEN count(*) < 20 THEN {NEVER} ELSE round(coalesce(avg(r) / NULLIF(stddev_samp(r), 0) * sqrt(any_value(ppy)), 0), 6) END AS trailing_score "
    "FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY as_of DESC) AS k FROM rt WHERE r IS NOT NULL) JOIN nm USING (sid) WHERE k <= 252 GROUP BY 1", **GRID_SQL))
def trailing_window_scores(spark: SparkSession, root: str) -> DataFrame:
    named = bounded(configs(spark).select("strategy_id", "config_name", "periods_per_year"), CONFIGS)
    t = WF.trailing_score(grid_returns(spark, root).join(named, "strategy_id"), 252, "periods_per_year")
    return t.join(named, "strategy_id").select("config_name", "n", _finite("trailing_score", num("trailing_score")))


REG_SQL = dict(
    GRID_SQL, **LABEL_SQL,
    rl="SELECT r.as_of, l.regime FROM dts r ASOF LEFT JOIN lab l ON r.as_of >= l.date",
    j="SELECT rt.sid, rt.as_of, rt.r, rl.regime FROM rt JOIN rl ON rl.as_of = rt.as_of WHERE rt.r IS NOT NULL AND rl.regime IS NOT NULL",
    st0="SELECT sid, regime, product(1 + r) - 1 AS tr, stddev_samp(r) * sqrt(252) AS vol, count(*) AS nd FROM j GROUP BY 1, 2",
    st="SELECT *, CASE WHEN vol > 0 THEN (pow(1 + tr, 252.0 / nd) - 1) / vol ELSE 0 END AS sh FROM st0 WHERE nd >= 5",
    dist="SELECT regime, count(*) / sum(count(*)) OVER () AS share FROM lab GROUP BY 1",
)


def regimes_on(spark: SparkSession, root: str) -> DataFrame:
    """The label in force at each decision date of either schedule."""
    days = union_days({s: schedule_days(START, END, s) for s in G.GRIDS})
    return regimes_of(spark, root, days).filter(F.col("regime").isNotNull()).select(F.col("as_of").alias("date"), "regime")


@query("regime_weighted_scores", with_ctes(
    f"{GRID_INPUTS} macro_w", f"SELECT config_name, coalesce(score, {NEVER}) AS regime_score FROM nm LEFT JOIN (SELECT sid, {q_sig('sum(share * sh) / sum(share)', 7)} AS score FROM st JOIN dist USING (regime) GROUP BY 1) USING (sid)", **REG_SQL))
def regime_weighted_scores(spark: SparkSession, root: str) -> DataFrame:
    stats = R.strategy_by_regime(grid_returns(spark, root), regimes_on(spark, root))
    named = configs(spark).select("strategy_id", "config_name")
    s = WF.regime_weighted_score(stats, R.distribution(labels(spark, root)), named).join(bounded(named, CONFIGS), "strategy_id")
    return s.select("config_name", _finite("regime_score", sig("regime_score", 7)))


@query("finalist_regime_mapping", with_ctes(
    f"{GRID_INPUTS} macro_w", f"SELECT regime, config_name AS strategy, {q_sig('sh', 7)} AS score, nd AS num_days FROM (SELECT st.*, row_number() OVER (PARTITION BY regime ORDER BY sh DESC, st.sid) AS k FROM st JOIN fin USING (sid) WHERE nd >= 20) JOIN nm USING (sid) WHERE k = 1",
    **REG_SQL, fin=f"SELECT sid FROM (SELECT sid, row_number() OVER (ORDER BY {q_sig('4.0 * act + 0.3 * oos_sharpe_mean + 0.3 * wr', 10)} DESC, sid) AS k FROM agg WHERE act > 0) WHERE k <= 6"))
def finalist_regime_mapping(spark: SparkSession, root: str) -> DataFrame:
    """The six best configurations' returns by regime, and the best of them in each regime of at least 20 rows."""
    config = configs(spark)
    curve = durable(curves(spark, root))
    best = WF.rank(evaluate(spark, root, curve, config).filter(F.col("oos_active_return_mean") > 0))
    finalists = bounded(best.orderBy("rank").limit(6).select("strategy_id"), 6)
    r = curve.select("strategy_id", F.col("as_of").alias("date"), F.col("returns").alias("r")).join(finalists, "strategy_id", "left_semi")
    m = R.best_by_regime(R.strategy_by_regime(r, regimes_on(spark, root)))
    j = m.join(bounded(config.select(F.col("strategy_id").alias("strategy"), "config_name"), CONFIGS), "strategy")
    return j.select("regime", F.col("config_name").alias("strategy"), sig("score", 7).alias("score"), "num_days")

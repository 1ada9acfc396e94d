"""Registered queries: stored panel and macro files, the book of portfolio states, the log of optimizer runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelwise import CASH
from panelwise.functions.dates import schedule_days
from panelwise.functions.exprs import num, sig
from panelwise.operators import accounting, asof, regimes as R
from panelwise.operators.schedule_defaults import END, START
from panelwise.plans.catalog import grid_q
from panelwise.plans.catalog.data_q import BAR_SQL, bar_cols, run_folder
from panelwise.plans.catalog.portfolio_q import CSQL, monthly, with_peak
from panelwise.plans.catalog.signals_q import momentum_weights
from panelwise.plans.registry import query
from panelwise.plans.sqlkit import sig as q_sig, with_ctes
from panelwise.sources import book, ingest, results
from panelwise.sources.panel import MACRO_FROM_PRIORITY, bars_from_orders, macro_from_orders, read_macro, read_snapshot, write_macro

# --- stored panel and macro files ----------------------------------------------------------------------------------

_SNAPSHOTS: dict[tuple[str, str], str] = {}


def snapshot(spark: SparkSession, root: str) -> str:
    """Path of the panel of ``root``, written once an application."""
    key = (spark.sparkContext.applicationId, root)
    if key not in _SNAPSHOTS:
        _SNAPSHOTS[key] = ingest.write_snapshot(bars_from_orders(spark, root), run_folder(spark), "1")
    return _SNAPSHOTS[key]


@query("snapshot_load", with_ctes("bars", f"SELECT date, ticker, {BAR_SQL} FROM bars"))
def snapshot_load(spark: SparkSession, root: str) -> DataFrame:
    return read_snapshot(spark, snapshot(spark, root)).select("date", "ticker", *bar_cols())


@query("snapshot_point_in_time_read", with_ctes(
    "bars", f"SELECT date, ticker, {BAR_SQL} FROM bars WHERE date < DATE '2000-06-30' AND date >= DATE '2000-06-30' - 302"))
def snapshot_point_in_time_read(spark: SparkSession, root: str) -> DataFrame:
    """The strict read, on the stored panel: two of its years are opened."""
    bars = read_snapshot(spark, snapshot(spark, root), "1999-09-02", "2000-06-29")
    return asof.read_prices(bars, "2000-06-30", 302).select("date", "ticker", *bar_cols())


@query("snapshot_close_read", with_ctes(
    "bars", f"SELECT date, ticker, {q_sig('close', 13)} AS close FROM bars WHERE date < DATE '2000-06-30' AND ticker IN ('Brand#1', 'Brand#12')"))
def snapshot_close_read(spark: SparkSession, root: str) -> DataFrame:
    bars = read_snapshot(spark, snapshot(spark, root), last="2000-06-29").filter(F.col("ticker").isin("Brand#1", "Brand#12"))
    return asof.read_prices(bars, "2000-06-30").select("date", "ticker", sig("close", 13).alias("close"))


MACRO = ["VIX", "T10Y2Y", *MACRO_FROM_PRIORITY, "CPI", "UNRATE"]


def macro_files(spark: SparkSession, root: str) -> str:
    path = run_folder(spark)
    write_macro(macro_from_orders(spark, root), path)
    return path


@query("macro_files_combined", with_ctes("macro_w", f"SELECT date, {', '.join(f'{q_sig(c, 11)} AS {c}' for c in MACRO)} FROM macro_w"))
def macro_files_combined(spark: SparkSession, root: str) -> DataFrame:
    """All stored series side by side."""
    w = R.macro_wide(read_macro(spark, macro_files(spark, root)), MACRO)
    return w.select("date", *[sig(c, 11).alias(c) for c in MACRO])


@query("macro_files_read", with_ctes("macro", f"SELECT indicator, date, {q_sig('value', 11)} AS value FROM macro WHERE indicator IN ('VIX', 'CPI') AND date <= DATE '2000-06-30'"))
def macro_files_read(spark: SparkSession, root: str) -> DataFrame:
    m = read_macro(spark, macro_files(spark, root), ["VIX", "CPI"]).filter(F.col("date") <= "2000-06-30")
    return m.select("indicator", "date", sig("value", 11).alias("value"))


# --- portfolio states ----------------------------------------------------------------------------------------------

# Portfolios of the queries: the whole momentum portfolio and one of half its size.
SHARES = {"momentum": 1.0, "momentum_half": 0.5}
DAY, NEXT = "2000-12-29", "2001-01-31"


def portfolio_rows(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(positions, curve, prices) of both portfolios at every month end. Cost is the price when a ticker was last entered."""
    w = momentum_weights(spark, root)
    c = with_peak(accounting.periodic_value(w, monthly(spark))).select("strategy_id", "as_of", "nav", "peak_nav")
    c = c.select("as_of", F.inline(F.array(*[F.struct(
        F.lit(n).alias("portfolio"), (F.col("nav") * s).alias("nav"), (F.col("peak_nav") * s).alias("peak_nav")) for n, s in SHARES.items()])))
    cash = F.col("ticker") == CASH
    seq = monthly(spark).select("as_of", "seq")
    p = w.select("as_of", "ticker", "weight", "price").join(c, "as_of").join(seq, "as_of")
    by = Window.partitionBy("portfolio", "ticker").orderBy("as_of")
    run = Window.partitionBy("portfolio", "ticker", "run").orderBy("as_of")
    p = p.withColumn("run", F.col("seq") - F.row_number().over(by)).withColumn("cost", F.when(~cash, F.first("price").over(run)))
    p = p.withColumn("shares", F.when(~cash, F.col("weight") * F.col("nav") / F.col("price")))
    high = R.macro_snapshot(macro_from_orders(spark, root), schedule_days(START, END, "monthly")).select(
        "as_of", F.when(F.col("is_high_vol"), "HIGH_VOL").otherwise("NORMAL").alias("regime"))
    dd = (F.col("peak_nav") - F.col("nav")) / F.col("peak_nav")
    level = F.when(dd >= 0.3, "EXIT").when(dd >= 0.2, "HARD").when(dd >= 0.1, "SOFT").otherwise("NONE")
    curve = c.join(high, "as_of", "left").withColumn("drawdown_level", level)
    return p.select("portfolio", "as_of", "ticker", "shares", "weight", "cost"), curve, w.select("as_of", "ticker", "price")


def stored_book(spark: SparkSession, root: str) -> str:
    """Version 1 holds all states; version 2 liquidates the half portfolio from 2001 on."""
    path = run_folder(spark)
    p, curve, _ = portfolio_rows(spark, root)
    s = book.states(p, curve)
    book.append(s, path, 1)
    late = book.read(spark, path, first="2001-01-01").filter(F.col("portfolio") == "momentum_half")
    none = F.create_map().cast("map<string,double>")
    book.append(late.withColumns({"nav": F.lit(0.0), "holdings": none, "weights": none, "cost_basis": none}), path, 2)
    return path


BOOK_SQL = dict(
    CSQL,
    pf="SELECT * FROM (VALUES ('momentum', CAST(1.0 AS DOUBLE)), ('momentum_half', CAST(0.5 AS DOUBLE))) t(portfolio, f)",
    st0="SELECT portfolio, as_of, nav * f AS nav, max(nav * f) OVER (PARTITION BY portfolio ORDER BY as_of) AS peak_nav FROM curve CROSS JOIN pf",
    st="SELECT portfolio, as_of, CASE WHEN portfolio = 'momentum_half' AND as_of >= DATE '2001-01-01' THEN 0.0 ELSE nav END AS nav, peak_nav, "
    "CASE WHEN coalesce(VIX > 25, FALSE) THEN 'HIGH_VOL' ELSE 'NORMAL' END AS regime, CASE WHEN dd >= 0.3 THEN 'EXIT' WHEN dd >= 0.2 THEN 'HARD' WHEN dd >= 0.1 THEN 'SOFT' ELSE 'NONE' END AS drawdown_level "
    "FROM (SELECT *, (peak_nav - nav) / peak_nav AS dd FROM st0) LEFT JOIN macro_at USING (as_of)",
    ps0="SELECT s.portfolio, w.as_of, w.ticker, w.weight, px.price, CASE WHEN w.ticker <> '$CASH$' THEN w.weight * s.nav / px.price END AS shares, "
    "r.seq - row_number() OVER (PARTITION BY s.portfolio, w.ticker ORDER BY w.as_of) AS run FROM w JOIN st0 s USING (as_of) JOIN rebal r USING (as_of) "
    "LEFT JOIN px ON px.ticker = w.ticker AND px.as_of = w.as_of",
    pos="SELECT portfolio, as_of, ticker, weight, shares, CASE WHEN ticker <> '$CASH$' THEN first_value(price) OVER (PARTITION BY portfolio, ticker, run ORDER BY as_of) END AS cost_basis, price "
    "FROM ps0 QUALIFY NOT (portfolio = 'momentum_half' AND as_of >= DATE '2001-01-01')",
)
STATE_COLS = f"portfolio, as_of, {q_sig('nav')} AS nav, {q_sig('peak_nav')} AS peak_nav, regime, drawdown_level"
POS_COLS = f"portfolio, as_of, ticker, round(weight, 6) AS weight, {q_sig('shares')} AS shares, {q_sig('cost_basis', 11)} AS cost_basis"


def state_cols() -> list:
    return ["portfolio", "as_of", sig("nav").alias("nav"), sig("peak_nav").alias("peak_nav"), "regime", "drawdown_level"]


def position_cols() -> list:
    return ["portfolio", "as_of", "ticker", num("weight").alias("weight"), sig("shares").alias("shares"), sig("cost_basis", 11).alias("cost_basis")]


@query("portfolio_book_upsert", with_ctes("px macro_at", f"SELECT {STATE_COLS} FROM st", **BOOK_SQL))
def portfolio_book_upsert(spark: SparkSession, root: str) -> DataFrame:
    return book.read(spark, stored_book(spark, root)).select(*state_cols())


@query("portfolio_book_latest", with_ctes("px macro_at", f"SELECT {STATE_COLS}, CAST(n AS INTEGER) AS n_positions FROM (SELECT *, "
       "(SELECT count(*) FROM pos WHERE pos.portfolio = st.portfolio AND pos.as_of = st.as_of) AS n FROM st) QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY as_of DESC) = 1", **BOOK_SQL))
def portfolio_book_latest(spark: SparkSession, root: str) -> DataFrame:
    return book.latest(book.read(spark, stored_book(spark, root))).select(*state_cols(), F.size("weights").alias("n_positions"))


@query("portfolio_book_history", with_ctes("px macro_at", f"SELECT {STATE_COLS}, round(greatest(0.0, (peak_nav - nav) / peak_nav), 6) AS drawdown FROM st WHERE as_of BETWEEN DATE '{DAY}' - 365 AND DATE '{DAY}'", **BOOK_SQL))
def portfolio_book_history(spark: SparkSession, root: str) -> DataFrame:
    """States of the year up to a day, with the regime and drawdown level then known."""
    h = book.drawdown(book.read(spark, stored_book(spark, root), "1999-12-30", DAY))
    return h.select(*state_cols(), num("drawdown").alias("drawdown"))


@query("portfolio_book_positions", with_ctes("px macro_at", f"SELECT {POS_COLS} FROM pos", **BOOK_SQL))
def portfolio_book_positions(spark: SparkSession, root: str) -> DataFrame:
    return book.positions(book.read(spark, stored_book(spark, root))).select(*position_cols())


@query("portfolio_book_as_of", with_ctes("px macro_at", f"SELECT {POS_COLS} FROM pos WHERE as_of = DATE '{DAY}'", **BOOK_SQL))
def portfolio_book_as_of(spark: SparkSession, root: str) -> DataFrame:
    """Positions as of a day between two month ends."""
    return book.positions(book.at(spark, stored_book(spark, root), "2001-01-15")).select(*position_cols())


@query("portfolio_book_drift", with_ctes(
    "px macro_at", f"SELECT portfolio, ticker, round(coalesce(c.weight, 0), 6) AS current_weight, round(coalesce(t.weight, 0), 6) AS target_weight, round(coalesce(t.weight, 0) - coalesce(c.weight, 0), 6) AS drift "
    f"FROM (SELECT * FROM pos WHERE as_of = DATE '{DAY}') c FULL JOIN (SELECT portfolio, ticker, weight FROM w CROSS JOIN pf WHERE as_of = DATE '{NEXT}') t USING (portfolio, ticker) "
    "WHERE abs(coalesce(t.weight, 0) - coalesce(c.weight, 0)) >= 0.02", **BOOK_SQL))
def portfolio_book_drift(spark: SparkSession, root: str) -> DataFrame:
    """What stored positions lack against the next month's targets."""
    w = momentum_weights(spark, root).filter(F.col("as_of") == NEXT)
    targets = w.select(F.explode(F.array(*[F.lit(n) for n in SHARES])).alias("portfolio"), "ticker", "weight")
    d = book.drift(book.at(spark, stored_book(spark, root), DAY), targets)
    return d.select("portfolio", "ticker", *[num(c).alias(c) for c in ("current_weight", "target_weight", "drift")])


@query("portfolio_book_unrealized", with_ctes(
    "px macro_at", f"SELECT portfolio, as_of, {q_sig('sum(shares * cost_basis)')} AS cost, {q_sig('sum(shares * price)')} AS value, round(sum(shares * price) / NULLIF(sum(shares * cost_basis), 0) - 1, 6) AS gain "
    "FROM pos WHERE shares IS NOT NULL GROUP BY ALL", **BOOK_SQL))
def portfolio_book_unrealized(spark: SparkSession, root: str) -> DataFrame:
    _, _, prices = portfolio_rows(spark, root)
    u = book.unrealized(book.read(spark, stored_book(spark, root)), prices.filter(F.col("ticker") != CASH))
    return u.select("portfolio", "as_of", sig("cost").alias("cost"), sig("value").alias("value"), num("gain").alias("gain"))


@query("portfolio_book_json", with_ctes("px macro_at", f"SELECT {POS_COLS}, regime FROM pos JOIN (SELECT portfolio, as_of, regime FROM st) USING (portfolio, as_of)", **BOOK_SQL))
def portfolio_book_json(spark: SparkSession, root: str) -> DataFrame:
    """States to JSON text and back."""
    back = book.from_json(book.to_json(book.read(spark, stored_book(spark, root))))
    return book.positions(back).join(back.select("portfolio", "as_of", "regime"), ["portfolio", "as_of"]).select(*position_cols(), "regime")


# --- log of optimizer runs -----------------------------------------------------------------------------------------

RUNS = {"base": "momentum", "accelerated": "momentum_acceleration"}


def run_log(spark: SparkSession, root: str) -> str:
    """Two runs of the optimizer, a model each; the first was written once before with the scores of nothing."""
    path = run_folder(spark)
    for run, alpha in RUNS.items():
        configs = grid_q.configs(spark, ["monthly"], [alpha])
        done = grid_q.evaluate(spark, root, grid_q.curves(spark, root, ["monthly"], [alpha]), configs)
        out = results.outcomes(configs.select("strategy_id", "config_name"), done)
        if run == "base":
            results.append({"all": out.withColumn("composite_score", F.lit(None).cast("double")).withColumn("status", F.lit(results.FAILED))}, path, run, 1)
        version = 2 if run == "base" else 1
        results.append({"all": out}, path, run, version)
        kept = results.read(spark, path, "all", [run]).drop("run_id", "version")
        results.append({"winners": results.winners(kept), "history": results.summary(kept),
                        "mapping": results.best(kept).withColumn("regime", F.lit("ANY"))},
                       path, run, version)
    return path


LOG_SQL = grid_q.GRID_SQL | dict(
    rs="SELECT nm.sid, config_name, CASE alpha WHEN 'momentum' THEN 'base' ELSE 'accelerated' END AS run_id, act, 4.0 * act + 0.3 * oos_sharpe_mean + 0.3 * wr AS sc "
    "FROM nm LEFT JOIN agg USING (sid) WHERE sch = 'monthly' AND alpha IN ('momentum', 'momentum_acceleration')")


@query("optimizer_result_log", with_ctes(
    grid_q.GRID_INPUTS, f"SELECT run_id, CAST(CASE run_id WHEN 'base' THEN 2 ELSE 1 END AS BIGINT) AS version, config_name, CASE WHEN sc IS NULL THEN 'failed' ELSE 'ok' END AS status, {q_sig('sc', 7)} AS composite_score, coalesce(act > 0, FALSE) AS won FROM rs", **LOG_SQL))
def optimizer_result_log(spark: SparkSession, root: str) -> DataFrame:
    """All configurations of both runs in their newest versions, marked where the table of winners has them."""
    path = run_log(spark, root)
    won = results.read(spark, path, "winners").select("run_id", "config_name", F.lit(True).alias("won"))
    a = results.read(spark, path, "all").join(won, ["run_id", "config_name"], "left")
    return a.select("run_id", "version", "config_name", "status", sig("composite_score", 7).alias("composite_score"), F.coalesce("won", F.lit(False)).alias("won"))


@query("optimizer_run_history", with_ctes(
    grid_q.GRID_INPUTS, f"SELECT run_id, count(*) AS n_configs, count(*) FILTER (WHERE sc IS NULL) AS n_failed, count(*) FILTER (WHERE act > 0) AS n_winners, {q_sig('max(sc)', 7)} AS best_score, arg_max(config_name, sc) AS config_name FROM rs GROUP BY 1", **LOG_SQL))
def optimizer_run_history(spark: SparkSession, root: str) -> DataFrame:
    """Counts of each run, failed configurations among them, beside the configuration its mapping chose."""
    path = run_log(spark, root)
    return results.read(spark, path, "history").join(results.read(spark, path, "mapping").select("run_id", "config_name"), "run_id").select(
        "run_id", "n_configs", "n_failed", "n_winners", sig("best_score", 7).alias("best_score"), "config_name")

"""Registered queries: reads, ingestion, universes, validation, quality, monitoring."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwise.functions.dates import schedule_days
from panelwise.functions.exprs import literal_rows, num, sig
from panelwise.operators import accounting, asof, monitoring as MON, quality as Q, regimes as R, universe as U
from panelwise.operators.returns import daily_returns
from panelwise.operators.schedule_defaults import END, START
from panelwise.plans.catalog.metrics_q import curves
from panelwise.plans.catalog.portfolio_q import CSQL, monthly, with_peak
from panelwise.plans.catalog.regimes_q import ALERT_SQL
from panelwise.plans.catalog.signals_q import momentum_weights, month_marks
from panelwise.plans.registry import SQL, query
from panelwise.plans.sqlkit import bnum, sig as q_sig, with_ctes
from panelwise.sources import ingest, state
from panelwise.sources.panel import (
    FIELDS, bars_from_orders, closes_from_orders, macro_from_orders, members_from_orders, reference_from_orders, table, wide_to_long,
)
from panelwise.sources.storage import shared_folder

BAR_SQL = ", ".join(f"{q_sig(f, 13)} AS {f}" for f in FIELDS)


def bar_cols() -> list:
    return [sig(f, 13).alias(f) for f in FIELDS]


# --- reads ---------------------------------------------------------------------------------------------------------


@query("daily_bars", with_ctes("bars", f"SELECT date, ticker, {BAR_SQL} FROM bars"))
def daily_bars(spark: SparkSession, root: str) -> DataFrame:
    return bars_from_orders(spark, root).select("date", "ticker", *bar_cols())


@query("point_in_time_read", with_ctes(
    "bars", f"SELECT date, ticker, {BAR_SQL} FROM bars WHERE date < DATE '2000-06-30' AND date >= DATE '2000-06-30' - 302"))
def point_in_time_read(spark: SparkSession, root: str) -> DataFrame:
    return asof.read_prices(bars_from_orders(spark, root), "2000-06-30", 302).select("date", "ticker", *bar_cols())


@query("close_prices_read", with_ctes("bars", f"SELECT date, ticker, {q_sig('close', 13)} AS close FROM bars WHERE date < DATE '2000-06-30'"))
def close_prices_read(spark: SparkSession, root: str) -> DataFrame:
    return asof.read_prices(closes_from_orders(spark, root), "2000-06-30").select("date", "ticker", sig("close", 13).alias("close"))


@query("ohlcv_range_read", with_ctes("bars", f"SELECT date, ticker, {BAR_SQL} FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"))
def ohlcv_range_read(spark: SparkSession, root: str) -> DataFrame:
    return asof.read_range(bars_from_orders(spark, root), "1997-01-01", "1997-12-31").select("date", "ticker", *bar_cols())


@query("panel_bounds", with_ctes("bars", "SELECT min(date) AS first_date, max(date) AS last_date, count(DISTINCT ticker) AS n_tickers, count(*) AS n_rows FROM bars"))
def panel_bounds(spark: SparkSession, root: str) -> DataFrame:
    return bars_from_orders(spark, root).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("ticker").alias("n_tickers"), F.count("*").alias("n_rows")
    )


@query("available_tickers", with_ctes("bars", "SELECT DISTINCT ticker FROM bars"))
def available_tickers(spark: SparkSession, root: str) -> DataFrame:
    return bars_from_orders(spark, root).select("ticker").distinct()


def requested(spark: SparkSession, root: str) -> DataFrame:
    return members_from_orders(spark, root).unionByName(literal_rows(spark, ["ticker"], [("Brand#98",), ("Brand#99",)]))


REQ = "SELECT ticker FROM members UNION ALL SELECT 'Brand#98' UNION ALL SELECT 'Brand#99'"


@query("ticker_availability", with_ctes(
    "bars members", "SELECT q.ticker, b.ticker IS NOT NULL AS available FROM q LEFT JOIN (SELECT DISTINCT ticker FROM bars WHERE date < DATE '2000-06-30') b USING (ticker)", q=REQ))
def ticker_availability(spark: SparkSession, root: str) -> DataFrame:
    return asof.availability(requested(spark, root), bars_from_orders(spark, root), "2000-06-30")


@query("unknown_tickers", with_ctes("bars members", "SELECT ticker FROM q WHERE ticker NOT IN (SELECT ticker FROM bars)", q=REQ))
def unknown_tickers(spark: SparkSession, root: str) -> DataFrame:
    return asof.unknown_tickers(requested(spark, root), bars_from_orders(spark, root))


@query("as_of_prices", with_ctes("px", f"SELECT ticker, as_of, seen AS seen_date, {q_sig('price', 13)} AS close FROM px"))
def as_of_prices(spark: SparkSession, root: str) -> DataFrame:
    p = asof.as_of(bars_from_orders(spark, root), month_marks(spark, root), ["ticker"], ["close"])
    return p.select("ticker", "as_of", "seen_date", sig("close", 13).alias("close"))


@query("panel_row_prices", with_ctes(
    "bars members rebal", f"SELECT m.ticker, r.as_of, r.panel_date, {q_sig('b.close', 13)} AS close FROM members m CROSS JOIN pr r LEFT JOIN bars b ON b.ticker = m.ticker AND b.date = r.panel_date",
    pr="SELECT as_of, (SELECT max(date) FROM bars WHERE date < as_of) AS panel_date FROM rebal"))
def panel_row_prices(spark: SparkSession, root: str) -> DataFrame:
    """Prices of the panel's last row before each decision date, missing where a ticker has no bar in it."""
    p = asof.panel_row(bars_from_orders(spark, root), month_marks(spark, root), ["close"])
    return p.select("ticker", "as_of", "panel_date", sig("close", 13).alias("close"))


@query("forward_filled_volume", with_ctes(
    "bars", "SELECT date, ticker, last_value(volume IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS volume FROM dm",
    dm="SELECT date, ticker, CASE WHEN day(date) % 3 = 0 THEN NULL WHEN volume <= 10 THEN 0.0 ELSE volume END AS volume FROM bars"))
def forward_filled_volume(spark: SparkSession, root: str) -> DataFrame:
    """Volumes with their holes filled from the row before."""
    return asof.forward_fill(damaged(spark, root), ["ticker"], "volume").select("date", "ticker", "volume")


@query("forward_filled_macro", with_ctes(
    "bars macro_w", "SELECT t.date, m.VIX AS vix FROM (SELECT DISTINCT date FROM bars) t ASOF LEFT JOIN (SELECT date AS md, VIX FROM macro_w) m ON t.date >= m.md"))
def forward_filled_macro(spark: SparkSession, root: str) -> DataFrame:
    """Index value carried onto the trading days of the panel."""
    days = bars_from_orders(spark, root).select("date").distinct().select(F.lit("VIX").alias("indicator"), F.col("date").alias("as_of"))
    vix = macro_from_orders(spark, root).filter(F.col("indicator") == "VIX")
    return asof.as_of(vix, days, ["indicator"], ["value"], inclusive=True).select(F.col("as_of").alias("date"), F.col("value").alias("vix"))


@query("instrument_master", with_ctes(
    "bars", f"SELECT ticker, min(date) AS first_date, max(date) AS last_date, {q_sig('sum(close * volume)')} AS aum FROM bars GROUP BY 1"))
def instrument_master(spark: SparkSession, root: str) -> DataFrame:
    m = U.instrument_master(bars_from_orders(spark, root))
    return m.select("ticker", "first_date", "last_date", sig("aum").alias("aum"))


# --- ingestion -----------------------------------------------------------------------------------------------------


def raw_quotes(spark: SparkSession, root: str) -> DataFrame:
    """Every shipped line as a text quote: thousands separators, unusable volumes, unusable dates."""
    li = table(spark, root, "lineitem").join(
        table(spark, root, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    u = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100.0) / 100.0
    sep = F.format_number(u, 2)
    day = F.when(F.col("l_returnflag") == "R", "n/a").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    vol = F.when(F.col("l_linenumber") == 7, "-").otherwise(F.col("l_quantity").cast("int").cast("string"))
    return li.select(
        F.col("p_brand").alias("ticker"), day.alias("Date"), sep.alias("Open"), sep.alias("High"), sep.alias("Low"), sep.alias("Close"),
        vol.alias("Volume"), "l_orderkey", "l_linenumber", u.alias("tie"),
    )


@query("normalized_bars",
       "SELECT ticker, date, b.c AS close, CASE WHEN b.b <> 7 THEN b.q END AS volume FROM (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, "
       "max({'a': l_orderkey, 'b': l_linenumber, 'c': floor(l_extendedprice / l_quantity * 100.0::DOUBLE) / 100.0::DOUBLE, 'q': l_quantity}) AS b "
       "FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' GROUP BY 1, 2)")
def normalized_bars(spark: SparkSession, root: str) -> DataFrame:
    b = ingest.normalize_bars(raw_quotes(spark, root), ["l_orderkey", "l_linenumber", "tie"])
    return b.select("ticker", "date", "close", "volume")


def _upsert_sides(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    b = bars_from_orders(spark, root).select("ticker", "date", "close")
    old = b.filter(F.col("date") < "2000-01-01")
    new = b.filter(F.col("date") >= "1999-07-01").withColumn("close", F.col("close") * 2.0)
    return old, new


@query("bars_upsert", with_ctes(
    "bars", f"SELECT ticker, date, {q_sig('close * CASE WHEN date >= {d} THEN 2.0 ELSE 1.0 END', 13).replace('{d}', 'DATE ' + chr(39) + '1999-07-01' + chr(39))} AS close FROM bars"))
def bars_upsert(spark: SparkSession, root: str) -> DataFrame:
    old, new = _upsert_sides(spark, root)
    return ingest.upsert(old, new, ["ticker", "date"]).select("ticker", "date", sig("close", 13).alias("close"))


@query("incremental_new_rows", with_ctes(
    "bars", f"SELECT b.ticker, b.date, {q_sig('b.close * 2.0', 13)} AS close FROM bars b LEFT JOIN (SELECT ticker, max(date) AS last FROM bars WHERE date < DATE '2000-01-01' GROUP BY 1) l "
    "USING (ticker) WHERE b.date >= DATE '1999-07-01' AND (l.last IS NULL OR b.date > l.last)"))
def incremental_new_rows(spark: SparkSession, root: str) -> DataFrame:
    old, new = _upsert_sides(spark, root)
    return ingest.new_rows(old, new).select("ticker", "date", sig("close", 13).alias("close"))


@query("wide_panel_to_long", with_ctes("bars", f"SELECT date, ticker, {BAR_SQL} FROM bars"))
def wide_panel_to_long(spark: SparkSession, root: str) -> DataFrame:
    """Wide layout (one column per ticker and field) and back."""
    b = bars_from_orders(spark, root)
    # A wide table has a column for each ticker, so its width is that of the dimension.
    tickers = sorted(r[0] for r in table(spark, root, "part").select("p_brand").distinct().collect())
    wide = b.groupBy("date").agg(
        *[F.max(F.when(F.col("ticker") == t, F.col(f))).alias(f"{t}|{f.capitalize()}") for t in tickers for f in FIELDS]
    )
    return wide_to_long(wide).select("date", "ticker", *bar_cols())


@query("clean_ticker_list",
       "SELECT ticker, min(pos) AS position FROM (SELECT upper(trim(CASE WHEN c_nationkey % 5 = 0 THEN ' none ' ELSE ' ' || lower(c_mktsegment) || '-' || c_nationkey || ' ' END)) AS ticker, c_custkey AS pos FROM customer) "
       "WHERE ticker NOT IN ('NAN', 'NONE', '') GROUP BY 1")
def clean_ticker_list(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "customer")
    raw = F.when(F.col("c_nationkey") % 5 == 0, " none ").otherwise(
        F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("-"), F.col("c_nationkey").cast("string"), F.lit(" ")))
    return ingest.clean_ticker_list(c.select(raw.alias("t"), F.col("c_custkey").alias("position")), "t", "position")


PROVIDERS = ["Vanguard Group", "State Street", "  Invesco PowerShares", "Acme Funds", "", "van eck", "Global X", "iShares by X"]


def instrument_lists(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    s, c = table(spark, root, "supplier"), table(spark, root, "customer")
    provider = F.element_at(F.array(*[F.lit(p) for p in PROVIDERS]), F.col("s_nationkey") % len(PROVIDERS) + 1)
    primary = s.select(
        F.concat(F.lit(" t"), (F.col("s_suppkey") % 70).cast("string")).alias("ticker"), F.col("s_name").alias("name"), provider.alias("provider"),
        F.concat(F.col("s_acctbal").cast("decimal(18,2)").cast("string"), F.lit("%")).alias("expense_ratio_pct"), F.col("s_suppkey").alias("position"),
    )
    secondary = c.select(
        F.concat(F.lit("T "), (F.col("c_custkey") % 90 + 30).cast("string")).alias("ticker"),
        F.when(F.col("c_nationkey") % 3 == 0, "nan").otherwise(F.concat(F.lit("iShares "), F.col("c_name"))).alias("name"),
        F.lit("iShares").alias("provider"), F.when(F.col("c_nationkey") % 2 == 0, F.lit("")).otherwise(F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("expense_ratio_pct"),
        F.col("c_mktsegment").alias("region"), F.col("c_custkey").alias("position"),
    )
    # Headers as published lists have them.
    shown = {"ticker": "Ticker ", "name": "Name", "expense_ratio_pct": "Expense Ratio (Pct)", "provider": " Provider"}
    return primary.withColumnsRenamed(shown), secondary.withColumnsRenamed(shown)


@query("instrument_list_harmonize", (
    "WITH a AS (SELECT ticker, arg_min(struct_pack(name := name, provider := provider, er := er), pos) AS r FROM (SELECT 'T' || (s_suppkey % 70) AS ticker, s_name AS name, "
    f"NULLIF([{', '.join(chr(39) + p + chr(39) for p in PROVIDERS)}][s_nationkey % 8 + 1], '') AS provider, CAST(CAST(s_acctbal AS DECIMAL(18, 2)) AS DOUBLE) AS er, s_suppkey AS pos FROM supplier) GROUP BY 1), "
    "b AS (SELECT ticker, arg_min(struct_pack(name := name, er := er, region := region), pos) AS r FROM (SELECT 'T' || (c_custkey % 90 + 30) AS ticker, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE 'iShares ' || c_name END AS name, "
    "CASE WHEN c_nationkey % 2 = 0 THEN NULL ELSE CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS DOUBLE) END AS er, c_mktsegment AS region, c_custkey AS pos FROM customer) GROUP BY 1), "
    "m AS (SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(b.r.name, a.r.name) AS name, CASE WHEN b.ticker IS NOT NULL THEN 'iShares' ELSE a.r.provider END AS provider, "
    "coalesce(b.r.er, a.r.er) AS expense_ratio_pct, b.r.region AS region, CASE WHEN a.ticker IS NOT NULL AND b.ticker IS NOT NULL THEN 'both' WHEN b.ticker IS NOT NULL THEN 'secondary' ELSE 'primary' END AS source "
    "FROM a FULL JOIN b ON a.ticker = b.ticker) "
    "SELECT *, CASE WHEN lower(provider) LIKE '%ishares%' OR lower(name) LIKE 'ishares %' THEN 'iShares' WHEN lower(provider) LIKE '%vanguard%' THEN 'Vanguard' WHEN lower(provider) LIKE '%state street%' THEN 'SPDR' "
    "WHEN lower(provider) LIKE '%invesco%' THEN 'Invesco' WHEN lower(provider) LIKE '%van eck%' THEN 'VanEck' WHEN lower(provider) LIKE '%global x%' THEN 'Global X' ELSE trim(provider) END AS issuer_family FROM m"))
def instrument_list_harmonize(spark: SparkSession, root: str) -> DataFrame:
    h = ingest.harmonize(*instrument_lists(spark, root))
    return h.select("ticker", "name", "provider", "expense_ratio_pct", "region", "source", "issuer_family")


@query("snapshot_manifest", with_ctes(
    "bars", "SELECT 'panel' AS snapshot_name, 'all' AS universe, count(*) AS num_rows, count(DISTINCT ticker) AS num_tickers, count(DISTINCT date) AS num_dates, min(date) AS start_date, max(date) AS end_date, "
    "count(DISTINCT ticker) AS total_tickers, count(DISTINCT ticker) AS valid_tickers, CAST(0 AS BIGINT) AS failed_tickers, CAST(sum(CAST(flat AS INT) + CAST(abs(rr) > 0.5 AS INT)) AS BIGINT) AS total_anomalies, "
    "'open,high,low,close,volume' AS price_fields FROM (SELECT *, open = high AND open = low AND open = close AS flat, coalesce(close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1, 0) AS rr FROM bars)"))
def snapshot_manifest(spark: SparkSession, root: str) -> DataFrame:
    b = bars_from_orders(spark, root)
    return ingest.manifest(b, "panel", "all", Q.ingest_screen(b))


def run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


@query("feature_store_round_trip", SQL["basic_features"].replace("LEFT JOIN rb x", "LEFT JOIN rb x"))
def feature_store_round_trip(spark: SparkSession, root: str) -> DataFrame:
    from panelwise.plans.catalog.signals_q import basic_features

    path = run_folder(spark)
    state.write_features(basic_features(spark, root), path, "panel", "basic")
    return state.read_features(spark, path, "panel", "basic").select("ticker", "as_of", "momentum", "vol")


@query("strategy_artifacts_round_trip", SQL["momentum_backtest"])
def strategy_artifacts_round_trip(spark: SparkSession, root: str) -> DataFrame:
    from panelwise.plans.catalog.signals_q import momentum_backtest

    path = run_folder(spark)
    state.write_artifacts({"nav": momentum_backtest(spark, root)}, path)
    return state.read_artifacts(spark, path, "nav", ["momentum"])


def states(spark: SparkSession, root: str) -> DataFrame:
    curve = with_peak(accounting.periodic_value(momentum_weights(spark, root), monthly(spark)))
    return curve.select(F.col("strategy_id").alias("portfolio"), "as_of", "nav", "peak_nav")


STATE = f"SELECT 'momentum' AS portfolio, as_of, {q_sig('nav')} AS nav, {q_sig('pk')} AS peak_nav FROM (SELECT *, max(nav) OVER (ORDER BY as_of) AS pk FROM curve)"


def _state_cols() -> list:
    return ["portfolio", "as_of", sig("nav").alias("nav"), sig("peak_nav").alias("peak_nav")]


@query("portfolio_state_latest", with_ctes("px", f"SELECT * FROM ({STATE}) ORDER BY as_of DESC LIMIT 1", **CSQL))
def portfolio_state_latest(spark: SparkSession, root: str) -> DataFrame:
    return state.latest_state(states(spark, root)).select(*_state_cols())


@query("portfolio_state_history", with_ctes("px", f"SELECT * FROM ({STATE}) WHERE as_of >= DATE '2000-12-29' - 365 AND as_of <= DATE '2000-12-29'", **CSQL))
def portfolio_state_history(spark: SparkSession, root: str) -> DataFrame:
    return state.state_history(states(spark, root), "2000-12-29", 365).select(*_state_cols())


@query("portfolio_state_upsert", with_ctes(
    "px", f"SELECT portfolio, as_of, CASE WHEN as_of >= DATE '2001-01-01' THEN 0.0 ELSE nav END AS nav, peak_nav FROM ({STATE})", **CSQL))
def portfolio_state_upsert(spark: SparkSession, root: str) -> DataFrame:
    s = states(spark, root)
    fix = s.filter(F.col("as_of") >= "2001-01-01").withColumn("nav", F.lit(0.0))
    return state.save_state(s, fix).select(*_state_cols())


# --- universes and reference ---------------------------------------------------------------------------------------


@query("ticker_reference", with_ctes("reference", "SELECT * FROM reference"))
def ticker_reference(spark: SparkSession, root: str) -> DataFrame:
    return reference_from_orders(spark, root)


@query("sector_list", with_ctes("reference", "SELECT sector, count(*) AS n_tickers FROM reference GROUP BY 1"))
def sector_list(spark: SparkSession, root: str) -> DataFrame:
    return U.sectors(reference_from_orders(spark, root))


@query("tickers_by_sector", with_ctes("reference", "SELECT ticker FROM reference WHERE sector = 'STANDARD'"))
def tickers_by_sector(spark: SparkSession, root: str) -> DataFrame:
    return U.tickers_by_sector(reference_from_orders(spark, root), "STANDARD")


@query("exchange_reference", "SELECT upper(n_name) AS exchange, n_name AS name, '09:30-16:00' AS trading_hours, 'US/Eastern' AS timezone, CAST(2 AS BIGINT) AS settlement_days FROM nation")
def exchange_reference(spark: SparkSession, root: str) -> DataFrame:
    e = U.exchanges(table(spark, root, "nation").select(F.col("n_name").alias("exchange"), F.col("n_name").alias("name")))
    return e.withColumn("settlement_days", F.col("settlement_days").cast("long"))


def universe_table(spark: SparkSession, root: str) -> DataFrame:
    """Graduated universe: a brand joins on its first bar; a static one holds all brands."""
    first = U.instrument_master(bars_from_orders(spark, root)).select(F.lit("graduated").alias("name"), "ticker", F.col("first_date").alias("added_date"))
    static = members_from_orders(spark, root).select(F.lit("all").alias("name"), "ticker", F.lit(None).cast("date").alias("added_date"))
    return first.unionByName(static)


@query("universe_static", with_ctes("members", "SELECT upper(ticker) AS ticker FROM members"))
def universe_static(spark: SparkSession, root: str) -> DataFrame:
    return U.members(universe_table(spark, root), "ALL")


@query("universe_as_of", with_ctes("bars", "SELECT upper(ticker) AS ticker FROM bars GROUP BY ticker HAVING min(date) <= DATE '1995-01-03'"))
def universe_as_of(spark: SparkSession, root: str) -> DataFrame:
    return U.members(universe_table(spark, root), "graduated", "1995-01-03")


@query("universe_metadata", with_ctes("bars members", "SELECT 'graduated' AS name, count(DISTINCT ticker) AS size, 'graduated' AS type FROM bars UNION ALL SELECT 'all', count(*), 'static_list' FROM members"))
def universe_metadata(spark: SparkSession, root: str) -> DataFrame:
    return U.metadata(universe_table(spark, root))


@query("universe_point_in_time", with_ctes(
    "bars members rebal", "SELECT m.ticker, r.as_of FROM members m CROSS JOIN rebal r JOIN (SELECT ticker, min(date) AS d FROM bars GROUP BY 1) f ON f.ticker = m.ticker AND f.d <= r.as_of"))
def universe_point_in_time(spark: SparkSession, root: str) -> DataFrame:
    u = universe_table(spark, root).filter(F.col("name") == "graduated")
    return U.members_at(u, month_marks(spark, root)).select("ticker", "as_of")


@query("eligible_tickers", with_ctes(
    "bars members", "SELECT m.ticker FROM members m JOIN (SELECT ticker, min(date) AS d, sum(close * volume) AS aum FROM bars GROUP BY 1) i USING (ticker) "
    "WHERE DATE '1996-01-01' - d >= 252 AND aum >= 60000000"))
def eligible_tickers(spark: SparkSession, root: str) -> DataFrame:
    return U.eligible(members_from_orders(spark, root), U.instrument_master(bars_from_orders(spark, root)), "1996-01-01", 252, 60_000_000.0)


@query("valid_ticker_intersection", with_ctes("bars members", "SELECT ticker FROM q WHERE ticker IN (SELECT ticker FROM bars)", q=REQ))
def valid_ticker_intersection(spark: SparkSession, root: str) -> DataFrame:
    return requested(spark, root).join(bars_from_orders(spark, root).select("ticker"), "ticker", "left_semi")


# --- validation and quality ----------------------------------------------------------------------------------------


def damaged(spark: SparkSession, root: str) -> DataFrame:
    """Bars with faults derived from the data: shifted prices below zero, swapped ranges, holes in volume."""
    b = bars_from_orders(spark, root)
    hole = F.pmod(F.dayofmonth("date"), F.lit(3)) == 0
    return b.withColumns({
        "close": F.when(F.month("date") == 3, F.col("close") - 2000.0).otherwise(F.col("close")),
        "high": F.when(F.month("date") == 5, F.col("low")).otherwise(F.col("high")),
        "volume": F.when(hole, F.lit(None).cast("double")).when(F.col("volume") <= 10, 0.0).otherwise(F.col("volume")),
    })


DAM = (
    "SELECT ticker, date, open, CASE WHEN month(date) = 5 THEN low ELSE high END AS high, low, CASE WHEN month(date) = 3 THEN close - 2000 ELSE close END AS close, "
    "CASE WHEN day(date) % 3 = 0 THEN NULL WHEN volume <= 10 THEN 0.0 ELSE volume END AS volume FROM bars"
)


@query("bar_validation", with_ctes(
    "bars", "SELECT ticker, n_rows, negative_prices, bad_high, bad_low, round(mp, 6) AS missing_pct, CASE WHEN negative_prices + bad_high + bad_low > 0 THEN 'INVALID' WHEN mp > 0.05 THEN 'MISSING' ELSE 'OK' END AS status FROM "
    "(SELECT ticker, count(*) AS n_rows, count(*) FILTER (open < 0 OR high < 0 OR low < 0 OR close < 0) AS negative_prices, count(*) FILTER (high < low OR high < open OR high < close) AS bad_high, "
    "count(*) FILTER (low > open OR low > close) AS bad_low, count(*) FILTER (volume IS NULL) / (count(*) * 5) AS mp FROM dm GROUP BY 1)", dm=DAM))
def bar_validation(spark: SparkSession, root: str) -> DataFrame:
    v = Q.validate(damaged(spark, root))
    return v.select("ticker", "n_rows", "negative_prices", "bad_high", "bad_low", num("missing_pct").alias("missing_pct"), "status")


@query("bar_anomaly_counts", with_ctes(
    "bars", "SELECT ticker, count(*) FILTER (open = high AND open = low AND open = close) AS suspicious_days, count(*) FILTER (abs(r) > 0.5) AS extreme_changes, count(*) FILTER (volume = 0) AS zero_volume FROM "
    "(SELECT *, close / NULLIF(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r FROM dm) GROUP BY 1", dm=DAM))
def bar_anomaly_counts(spark: SparkSession, root: str) -> DataFrame:
    return Q.anomaly_counts(damaged(spark, root))


@query("ingest_screen", with_ctes(
    "bars", "SELECT ticker, TRUE AS kept, CASE WHEN count(*) FILTER (open < 0 OR high < 0 OR low < 0 OR close < 0 OR high < low OR high < open OR high < close OR low > open OR low > close) > 0 THEN 'INVALID' ELSE 'MISSING' END AS status, "
    "count(*) FILTER (open = high AND open = low AND open = close) + count(*) FILTER (abs(r) > 0.5) + count(*) FILTER (volume = 0) AS anomalies FROM "
    "(SELECT *, close / NULLIF(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r FROM dm) GROUP BY 1", dm=DAM))
def ingest_screen(spark: SparkSession, root: str) -> DataFrame:
    return Q.ingest_screen(damaged(spark, root))


@query("date_coverage", with_ctes(
    "bars", "SELECT ticker, CAST(abs(min(date) - DATE '1995-01-02') AS BIGINT) AS start_diff, CAST(abs(max(date) - DATE '2001-10-30') AS BIGINT) AS end_diff, "
    "abs(min(date) - DATE '1995-01-02') <= 5 AND abs(max(date) - DATE '2001-10-30') <= 5 AS covered FROM bars GROUP BY 1"))
def date_coverage(spark: SparkSession, root: str) -> DataFrame:
    c = Q.date_coverage(bars_from_orders(spark, root), "1995-01-02", "2001-10-30")
    return c.select("ticker", F.col("start_diff").cast("long").alias("start_diff"), F.col("end_diff").cast("long").alias("end_diff"), "covered")


MISS = dict(
    dm=DAM, nd="SELECT count(DISTINCT date) AS n FROM dm",
    ms="SELECT ticker, 100.0 * ((any_value(n) - count(*)) * 5 + count(*) FILTER (volume IS NULL)) / (any_value(n) * 5) AS nan_pct, any_value(n) AS total_rows, "
    "any_value(n) - count(*) + count(*) FILTER (volume IS NULL) AS missing_rows FROM dm CROSS JOIN nd GROUP BY 1",
)


@query("missing_summary", with_ctes("bars", "SELECT ticker, round(nan_pct, 6) AS nan_pct, total_rows, missing_rows FROM ms", **MISS))
def missing_summary(spark: SparkSession, root: str) -> DataFrame:
    m = Q.missing_summary(damaged(spark, root))
    return m.select("ticker", num("nan_pct").alias("nan_pct"), "total_rows", "missing_rows")


@query("missingness_over_limit", with_ctes("bars", "SELECT ticker, round(nan_pct, 6) AS nan_pct FROM ms WHERE nan_pct > 43", **MISS))
def missingness_over_limit(spark: SparkSession, root: str) -> DataFrame:
    return Q.over_missing(damaged(spark, root), 0.43).select("ticker", num("nan_pct").alias("nan_pct"))


@query("winsorized_returns", with_ctes(
    "rets", f"SELECT r.date, r.ticker, {q_sig('least(greatest(r.r, q.lo), q.hi)')} AS r FROM rets r JOIN (SELECT ticker, quantile_cont(r, 0.01) AS lo, quantile_cont(r, 0.99) AS hi FROM rets GROUP BY 1) q USING (ticker) WHERE r.r IS NOT NULL"))
def winsorized_returns(spark: SparkSession, root: str) -> DataFrame:
    r = daily_returns(bars_from_orders(spark, root)).filter(F.col("r").isNotNull())
    return Q.winsorize(r, 0.01, 0.99).select("date", "ticker", sig("r").alias("r"))


@query("price_spikes", with_ctes("rets", f"SELECT date, ticker, {q_sig('r')} AS value FROM rets WHERE abs(r) > 0.15"))
def price_spikes(spark: SparkSession, root: str) -> DataFrame:
    return Q.spikes(bars_from_orders(spark, root), 0.15).select("date", "ticker", sig("value").alias("value"))


@query("recent_price_spikes", with_ctes(
    "rets", f"SELECT date, ticker, {q_sig('r')} AS value, {q_sig('pc', 13)} AS price_before, {q_sig('close', 13)} AS price_after FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS pc, "
    "row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM rets) WHERE k < 252 AND abs(r) > 0.1"))
def recent_price_spikes(spark: SparkSession, root: str) -> DataFrame:
    s = Q.spikes(bars_from_orders(spark, root), 0.10, 252)
    return s.select("date", "ticker", sig("value").alias("value"), sig("price_before", 13).alias("price_before"), sig("price_after", 13).alias("price_after"))


@query("dataset_quality_score", with_ctes(
    "bars", "SELECT round(avg_missing_pct, 6) AS avg_missing_pct, spike_count, missing_penalty, spike_penalty, greatest(0, 100 - missing_penalty - spike_penalty) AS total, "
    "CASE WHEN 100 - missing_penalty - spike_penalty >= 90 THEN 'A' WHEN 100 - missing_penalty - spike_penalty >= 75 THEN 'B' WHEN 100 - missing_penalty - spike_penalty >= 60 THEN 'C' ELSE 'D' END AS grade FROM "
    "(SELECT m.a AS avg_missing_pct, s.n AS spike_count, CAST(least(30, floor(m.a * 10)) AS BIGINT) AS missing_penalty, CAST(least(20, s.n * 5) AS BIGINT) AS spike_penalty FROM (SELECT avg(nan_pct) AS a FROM ms) m, "
    "(SELECT count(*) AS n FROM (SELECT close / NULLIF(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r FROM dm) WHERE abs(r) > 0.15) s)", **MISS))
def dataset_quality_score(spark: SparkSession, root: str) -> DataFrame:
    s = Q.quality_score(damaged(spark, root))
    return s.select(num("avg_missing_pct").alias("avg_missing_pct"), "spike_count", "missing_penalty", "spike_penalty", "total", "grade")


CHECK_DAY = "2001-11-06"
STALE = f"SELECT q.ticker, l.d AS last_date, coalesce({bnum(f'(DATE {chr(39)}{CHECK_DAY}{chr(39)} + 1)')} - {bnum('l.d')} - 1, 999) AS days_stale FROM q LEFT JOIN (SELECT ticker, max(date) AS d FROM bars GROUP BY 1) l USING (ticker)"


def check_day():
    return F.lit(CHECK_DAY).cast("date")


@query("price_staleness", with_ctes("bars members", "SELECT ticker, last_date, CAST(days_stale AS BIGINT) AS days_stale, days_stale > 3 AS is_stale FROM st", q=REQ, st=STALE))
def price_staleness(spark: SparkSession, root: str) -> DataFrame:
    s = Q.staleness(bars_from_orders(spark, root), requested(spark, root), check_day())
    return s.select("ticker", "last_date", F.col("days_stale").cast("long").alias("days_stale"), "is_stale")


GAP = (
    f"SELECT ticker, date, pd, {bnum('(date + 1)')} - {bnum('pd')} - 1 AS gap FROM (SELECT ticker, date, lag(date) OVER (PARTITION BY ticker ORDER BY date) AS pd FROM bars) WHERE pd IS NOT NULL"
)


@query("price_gaps", with_ctes("bars", "SELECT ticker, CAST(max(gap) AS BIGINT) AS max_gap_days, count(*) AS gap_count, min(pd) AS first_gap, max(pd) AS last_gap FROM gp WHERE gap > 5 GROUP BY 1", gp=GAP))
def price_gaps(spark: SparkSession, root: str) -> DataFrame:
    g = Q.gaps(bars_from_orders(spark, root))
    return g.select("ticker", F.col("max_gap_days").cast("long").alias("max_gap_days"), "gap_count",
                    F.array_min("gap_dates").alias("first_gap"), F.array_max("gap_dates").alias("last_gap"))


@query("zero_volume_days", with_ctes("bars", "SELECT ticker, date FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM dm) WHERE k <= 20 AND volume = 0", dm=DAM))
def zero_volume_days(spark: SparkSession, root: str) -> DataFrame:
    return Q.zero_volume(damaged(spark, root)).select("ticker", "date")


@query("invalid_prices", with_ctes("bars", f"SELECT ticker, date, CASE WHEN close < 0 THEN 'NEGATIVE_PRICE' ELSE 'ZERO_PRICE' END AS check_name, {q_sig('close', 13)} AS value FROM dm WHERE close <= 0", dm=DAM))
def invalid_prices(spark: SparkSession, root: str) -> DataFrame:
    b = Q.bad_prices(damaged(spark, root))
    return b.select("ticker", "date", F.col("check").alias("check_name"), sig("value", 13).alias("value"))


ISSUES = dict(
    q=REQ, dm=DAM,
    stl="SELECT q.ticker, coalesce((SELECT max(date) FROM dm d WHERE d.ticker = q.ticker), NULL) AS d FROM q",
    iss=f"SELECT ticker, 'STALE' AS c, CAST(coalesce({bnum(f'(DATE {chr(39)}{CHECK_DAY}{chr(39)} + 1)')} - {bnum('d')} - 1, 999) AS DOUBLE) AS v FROM stl WHERE coalesce({bnum(f'(DATE {chr(39)}{CHECK_DAY}{chr(39)} + 1)')} - {bnum('d')} - 1, 999) > 3 "
    f"UNION ALL SELECT ticker, 'GAP', CAST(max(gap) AS DOUBLE) FROM (SELECT ticker, {bnum('(date + 1)')} - {bnum('pd')} - 1 AS gap FROM (SELECT ticker, date, lag(date) OVER (PARTITION BY ticker ORDER BY date) AS pd FROM dm) WHERE pd IS NOT NULL) WHERE gap > 5 GROUP BY 1 "
    "UNION ALL SELECT ticker, 'PRICE_SPIKE', r FROM (SELECT ticker, close / NULLIF(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM dm) WHERE k < 252 AND abs(r) > 0.1 "
    "UNION ALL SELECT ticker, 'ZERO_VOLUME', 0.0 FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM dm) WHERE k <= 20 AND volume = 0 "
    "UNION ALL SELECT ticker, CASE WHEN close < 0 THEN 'NEGATIVE_PRICE' ELSE 'ZERO_PRICE' END, close FROM dm WHERE close <= 0",
)


def found_issues(spark: SparkSession, root: str) -> DataFrame:
    return Q.issues(damaged(spark, root), requested(spark, root), check_day())


@query("quality_issues", with_ctes("bars members", f"SELECT ticker, c AS check_name, CASE WHEN c = 'PRICE_SPIKE' THEN {q_sig('v')} ELSE {q_sig('v', 13)} END AS value FROM iss", **ISSUES))
def quality_issues(spark: SparkSession, root: str) -> DataFrame:
    return found_issues(spark, root).select("ticker", F.col("check").alias("check_name"),
                                            F.when(F.col("check") == "PRICE_SPIKE", sig("value")).otherwise(sig("value", 13)).alias("value"))


@query("quality_status", with_ctes(
    "bars members", "SELECT *, CASE WHEN stale_count > 5 THEN 'CRITICAL' WHEN stale_count + gap_count + anomaly_count > 0 THEN 'WARNING' ELSE 'OK' END AS overall_status FROM "
    "(SELECT count(*) FILTER (c = 'STALE') AS stale_count, count(*) FILTER (c = 'GAP') AS gap_count, count(*) FILTER (c NOT IN ('STALE', 'GAP')) AS anomaly_count FROM iss)", **ISSUES))
def quality_status(spark: SparkSession, root: str) -> DataFrame:
    return Q.overall_status(found_issues(spark, root))


QA = ("SELECT CASE WHEN k = 'STALE' AND count(*) > 5 THEN 'CRITICAL' ELSE 'WARNING' END AS level, 'DATA_QUALITY' AS category, k AS check_name, count(*) AS n FROM "
      "(SELECT CASE WHEN c IN ('STALE', 'GAP') THEN c ELSE 'ANOMALY' END AS k FROM iss) GROUP BY k")


@query("quality_alerts", with_ctes("bars members", QA, **ISSUES))
def quality_alerts(spark: SparkSession, root: str) -> DataFrame:
    return Q.alerts(found_issues(spark, root)).withColumnRenamed("check", "check_name")


@query("quality_summary", with_ctes(
    "bars members", "SELECT count(*) AS tickers_requested, count(n) AS tickers_found, count(*) - count(n) AS tickers_missing, max(t) AS trading_days, CAST(sum(CASE WHEN n IS NOT NULL THEN t END) AS BIGINT) AS total_values, "
    "CAST(sum(t - n) AS BIGINT) AS nan_count, count(*) FILTER (t > n) AS tickers_with_nan, round(100.0 * sum(t - n) / sum(CASE WHEN n IS NOT NULL THEN t END), 6) AS nan_percentage FROM q LEFT JOIN "
    "(SELECT ticker, count(*) AS n FROM bars GROUP BY 1) USING (ticker) CROSS JOIN (SELECT count(DISTINCT date) AS t FROM bars)", q=REQ))
def quality_summary(spark: SparkSession, root: str) -> DataFrame:
    s = Q.summary(bars_from_orders(spark, root), requested(spark, root))
    return s.drop("start", "end").withColumn("nan_percentage", num("nan_percentage"))


# --- monitoring ----------------------------------------------------------------------------------------------------


def event_values(spark: SparkSession, root: str) -> DataFrame:
    """Daily value of each user's portfolio: the day's summed event value."""
    e = table(spark, root, "events")
    return e.groupBy(F.col("user_id").alias("portfolio"), F.col("ts").cast("date").alias("date")).agg(F.sum("value").alias("nav"))


EV = dict(
    ev="SELECT user_id AS portfolio, CAST(ts AS DATE) AS date, sum(value) AS nav FROM events GROUP BY 1, 2",
    vp="SELECT *, CASE WHEN pk > 0 THEN greatest(0, (pk - nav) / pk) ELSE 0 END AS dd FROM (SELECT *, max(nav) OVER (PARTITION BY portfolio ORDER BY date) AS pk FROM ev)",
)
EDGE = dict(
    EV,
    th="SELECT * FROM (VALUES (0.05, 'INFO', '5% Drawdown'), (0.10, 'WARNING', '10% Drawdown'), (0.20, 'WARNING', '20% Drawdown'), (0.30, 'CRITICAL', '30% Drawdown')) t(lim, lv, nm)",
    fl="SELECT portfolio, date, nm, lv, dd, dd >= lim AS hit, coalesce(lag(dd >= lim) OVER (PARTITION BY portfolio, nm ORDER BY date), FALSE) AS was FROM vp CROSS JOIN th",
    ed="SELECT portfolio, date, nm AS name, CASE WHEN hit THEN lv ELSE 'INFO' END AS level, CASE WHEN hit THEN 'BREACH' ELSE 'RECOVERY' END AS kind, round(dd, 6) AS drawdown FROM fl WHERE hit <> was",
)


@query("value_drawdown_path", with_ctes("", "SELECT portfolio, date, round(nav, 4) AS nav, round(pk, 4) AS peak_nav, round(dd, 6) AS drawdown FROM vp", **EV))
def value_drawdown_path(spark: SparkSession, root: str) -> DataFrame:
    v = MON.value_path(event_values(spark, root))
    return v.select("portfolio", "date", num("nav", 4).alias("nav"), num("peak_nav", 4).alias("peak_nav"), num("drawdown").alias("drawdown"))


@query("drawdown_alerts", with_ctes("", "SELECT * FROM ed", **EDGE))
def drawdown_alerts(spark: SparkSession, root: str) -> DataFrame:
    a = MON.drawdown_alerts(event_values(spark, root))
    return a.select("portfolio", "date", "name", "level", "kind", num("drawdown").alias("drawdown"))


@query("drawdown_status", with_ctes(
    "", "SELECT portfolio, max(date) AS date, round(arg_max(nav, date), 4) AS nav, round(max(nav), 4) AS peak_nav, round(arg_max(dd, date), 6) AS drawdown, "
    "CASE WHEN arg_max(dd, date) >= 0.3 THEN 'CRITICAL' WHEN arg_max(dd, date) >= 0.1 THEN 'WARNING' WHEN arg_max(dd, date) >= 0.05 THEN 'INFO' ELSE 'OK' END AS status FROM vp GROUP BY 1", **EV))
def drawdown_status(spark: SparkSession, root: str) -> DataFrame:
    s = MON.drawdown_status(event_values(spark, root))
    return s.select("portfolio", "date", num("nav", 4).alias("nav"), num("peak_nav", 4).alias("peak_nav"), num("drawdown").alias("drawdown"), "status")


@query("alert_filter", with_ctes(
    "", "SELECT portfolio, date, name, level, kind FROM ed WHERE level = 'CRITICAL' AND date >= DATE '2024-01-10' ORDER BY date DESC, kind, level, name, portfolio LIMIT 50", **EDGE))
def alert_filter(spark: SparkSession, root: str) -> DataFrame:
    a = MON.drawdown_alerts(event_values(spark, root)).select("portfolio", "date", "name", "level", "kind", "category")
    return MON.filter_alerts(a, level="CRITICAL", category="DRAWDOWN", since="2024-01-10", last=50).drop("category")


@query("daily_monitoring_report", with_ctes(
    "bars members macro_w",
    f"SELECT 'quality' AS source, level, count(*) AS n FROM ({QA}) GROUP BY 2 UNION ALL SELECT 'regime', level, count(*) FROM al GROUP BY 2 UNION ALL SELECT 'value', level, count(*) FROM ed GROUP BY 2",
    **ISSUES, **ALERT_SQL, **EDGE))
def daily_monitoring_report(spark: SparkSession, root: str) -> DataFrame:
    return MON.daily_report(
        Q.alerts(found_issues(spark, root)), R.regime_alerts(R.daily_macro_regime(macro_from_orders(spark, root))),
        MON.drawdown_alerts(event_values(spark, root)),
    )

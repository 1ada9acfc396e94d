"""Market regimes: macro classification, trend/volatility labels with hysteresis, regime statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwise.functions.exprs import C, _c, change, literal_rows, ratio
from panelwise.functions.joins import DAYS, bounded
from panelwise.operators import asof

# Names under which a macro series may be asked for -> series id.
MACRO_ALIASES = {
    "VIX": "VIX",
    "TREASURY_3M": "DGS3MO",
    "TREASURY_2Y": "DGS2",
    "TREASURY_10Y": "DGS10",
    "FED_FUNDS": "FED_FUNDS",
    "YIELD_CURVE_10Y2Y": "T10Y2Y",
    "YIELD_CURVE_10Y3M": "T10Y3M",
    "HIGH_YIELD_SPREAD": "HY_SPREAD",
    "INVESTMENT_GRADE_SPREAD": "IG_SPREAD",
    "CPI": "CPI",
    "UNEMPLOYMENT": "UNRATE",
    "INDUSTRIAL_PRODUCTION": "INDPRO",
    "SP500": "SP500",
    "TREASURY_SPREAD_10Y2Y": "T10Y2Y",
}

# Snapshot field -> series id.
SNAPSHOT = {
    "vix": "VIX",
    "yield_curve_10y2y": "T10Y2Y",
    "treasury_10y": "DGS10",
    "treasury_2y": "DGS2",
    "fed_funds": "FED_FUNDS",
    "hy_spread": "HY_SPREAD",
    "ig_spread": "IG_SPREAD",
    "cpi": "CPI",
    "unemployment": "UNRATE",
}

# Severity order of the macro regimes.
SEVERITY = {"RISK_ON": 0, "ELEVATED_VOL": 1, "HIGH_VOL": 2, "RECESSION_WARNING": 3, "UNKNOWN": -1}


def series_id(name: str) -> str:
    return MACRO_ALIASES.get(name, name)


def macro_read(macro: DataFrame, indicator: str, as_of: str, lookback_days: int | None = None) -> DataFrame:
    """Values of one series up to and including ``as_of``."""
    at = F.lit(as_of).cast("date")
    out = macro.filter((F.col("indicator") == series_id(indicator)) & (F.col("date") <= at))
    return out if lookback_days is None else out.filter(F.col("date") >= F.date_sub(at, lookback_days))


def macro_range(macro: DataFrame, indicator: str, start: str, end: str) -> DataFrame:
    return asof.read_range(macro.filter(F.col("indicator") == series_id(indicator)), start, end)


def macro_wide(macro: DataFrame, indicators: Sequence[str]) -> DataFrame:
    """One column per series; the names are given, so no extra pass finds them."""
    return macro.groupBy("date").agg(
        *[F.max(F.when(F.col("indicator") == i, F.col("value"))).alias(i) for i in indicators]
    )


def macro_as_of(macro: DataFrame, days: Column, names: Mapping[str, str]) -> DataFrame:
    """(as_of, one column per name): latest value on or before each date."""
    keys = literal_rows(macro.sparkSession, ["indicator"], [(v,) for v in sorted(set(names.values()))])
    seen = asof.as_of(
        macro.filter(F.col("indicator").isin(sorted(set(names.values())))),
        asof.markers(keys, days), ["indicator"], ["value"], inclusive=True,
    )
    return seen.groupBy("as_of").agg(
        *[F.max(F.when(F.col("indicator") == v, F.col("value"))).alias(k) for k, v in names.items()]
    )


def macro_snapshot(macro: DataFrame, days: Column) -> DataFrame:
    """The nine snapshot values plus the two flags of each decision date."""
    return macro_as_of(macro, days, SNAPSHOT).withColumns({
        "is_high_vol": F.coalesce(F.col("vix") > 25.0, F.lit(False)),
        "is_inverted": F.coalesce(F.col("yield_curve_10y2y") < 0.0, F.lit(False)),
    })


def macro_regime(vix: C, spread: C, variant: str = "alpha", elevated: float = 20.0, high: float = 30.0) -> Column:
    """Macro regime. Variants differ in what a missing value means and in the recession test.

    alpha: both needed, inverted curve first. loader: as alpha. monitor: either suffices.
    accessor: recession needs high volatility and a spread below -0.5; plain inversion is elevated.
    """
    v, s = _c(vix), _c(spread)
    by_vol = F.when(v > high, "HIGH_VOL").when(v > elevated, "ELEVATED_VOL").otherwise("RISK_ON")
    missing = v.isNull() | s.isNull()
    if variant in ("alpha", "loader"):
        return F.when(missing, "UNKNOWN").when(s < 0, "RECESSION_WARNING").otherwise(by_vol)
    if variant == "monitor":
        return F.when(s < 0, "RECESSION_WARNING").when(v.isNull(), "UNKNOWN").otherwise(by_vol)
    if variant == "accessor":
        return (
            F.when(missing, "UNKNOWN")
            .when((v > high) & (s < -0.5), "RECESSION_WARNING")
            .when(v > high, "HIGH_VOL")
            .when((v > elevated) | (s < 0), "ELEVATED_VOL")
            .otherwise("RISK_ON")
        )
    raise ValueError(f"unknown variant {variant}")


def trend_indicators(benchmark: DataFrame, vix: DataFrame, window: int = 200) -> DataFrame:
    """(date, price, ma, vix): mean over ``window`` rows (NULL until full) and the carried-forward index.

    Both series have one row per day: this is a single small partition by nature, bounded by the calendar.
    """
    days = benchmark.select("date", "price", F.lit(None).cast("double").alias("vix"))
    points = vix.select("date", F.lit(None).cast("double").alias("price"), F.col("value").alias("vix"))
    both = days.unionByName(points).groupBy("date").agg(F.max("price").alias("price"), F.max("vix").alias("vix"))
    one = Window.partitionBy(F.lit(0)).orderBy("date")
    filled = both.withColumn(
        "vix", F.last("vix", ignorenulls=True).over(one.rowsBetween(Window.unboundedPreceding, 0))
    ).filter(F.col("price").isNotNull())
    frame = one.rowsBetween(-(window - 1), 0)
    return filled.withColumn("ma", F.when(F.count("price").over(frame) == window, F.avg("price").over(frame)))


def hysteresis_labels(
    ind: DataFrame, keys: Sequence[str] = (), band: float = 0.02, vix_high: float = 25.0, vix_low: float = 20.0
) -> DataFrame:
    """Trend and volatility state per row: a crossing sets it, the band between keeps the previous one.

    The state equals the last crossing seen, so a running ``last(ignore nulls)`` is exact. Before any crossing
    the first row decides: price >= mean is up, volatility is low. Rows without a mean or index are skipped.
    """
    rows = ind.filter(F.col("ma").isNotNull() & F.col("vix").isNotNull())
    by = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    up, down = F.lit("uptrend"), F.lit("downtrend")
    cross = F.when(F.col("price") < F.col("ma") * (1 - band), down).when(F.col("price") > F.col("ma") * (1 + band), up)
    start = F.when(F.first(F.col("price") >= F.col("ma")).over(by), up).otherwise(down)
    level = F.when(F.col("vix") > vix_high, F.lit("high_vol")).when(F.col("vix") < vix_low, F.lit("low_vol"))
    out = rows.withColumns({
        "trend": F.coalesce(F.last(cross, ignorenulls=True).over(by), start),
        "vol": F.coalesce(F.last(level, ignorenulls=True).over(by), F.lit("low_vol")),
    })
    out = out.withColumn("regime", F.concat_ws("_", "trend", "vol"))
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date")
    prev = F.lag("regime").over(order)
    return out.withColumn("regime_changed", prev.isNull() | (prev != F.col("regime")))


def distribution(labels: DataFrame, column: str = "regime") -> DataFrame:
    """Count and share of each regime; the total is a one-row aggregate over the few regime rows."""
    n = labels.groupBy(column).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(bounded(total, 1)).select(column, "n", ratio("n", "total").alias("share"))


def strategy_by_regime(returns: DataFrame, labels: DataFrame, min_rows: int = 5) -> DataFrame:
    """Return statistics per (strategy, regime); labels have one row per day, hence the broadcast."""
    j = returns.filter(F.col("r").isNotNull()).join(bounded(labels.groupBy("date").agg(F.first("regime").alias("regime")), DAYS), "date")
    by = Window.partitionBy("strategy_id", "regime").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = j.withColumn("cum", F.product(1.0 + F.col("r")).over(by))
    grown = grown.withColumn("dd", change(F.col("cum"), F.max("cum").over(by)))
    per = grown.groupBy("strategy_id", "regime").agg(
        (F.max_by("cum", "date") - 1.0).alias("total_return"),
        (F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("volatility"),
        F.min("dd").alias("max_drawdown"),
        F.count("*").alias("num_days"),
    )
    all_days = F.sum("num_days").over(Window.partitionBy("strategy_id"))
    out = per.withColumns({
        "pct_of_period": ratio("num_days", all_days),
        "annualized_return": F.pow(1.0 + F.col("total_return"), 252.0 / F.col("num_days")) - 1.0,
    })
    sharpe = F.when(F.col("volatility") > 0, F.col("annualized_return") / F.col("volatility")).otherwise(0.0)
    return out.withColumn("sharpe_ratio", sharpe).filter(F.col("num_days") >= min_rows)


def best_by_regime(stats: DataFrame, metric: str = "sharpe_ratio", min_days: int = 20) -> DataFrame:
    """Strategy with the largest metric in each regime; ties go to the smaller name."""
    ok = stats.filter((F.col("num_days") >= min_days) & F.col(metric).isNotNull())
    w = Window.partitionBy("regime").orderBy(F.col(metric).desc(), "strategy_id")
    return ok.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select(
        "regime", F.col("strategy_id").alias("strategy"), F.col(metric).alias("score"), "total_return", "num_days"
    )


def map_strategy(regimes: DataFrame, mapping: Mapping[str, str], fallback: str) -> DataFrame:
    """Regime -> strategy with a fallback; the mapping is configuration, so it is a literal map column."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return regimes.withColumn("strategy", F.coalesce(F.try_element_at(m, F.col("regime")), F.lit(fallback)))


def yearly_share(labels: DataFrame, regimes: Sequence[str]) -> DataFrame:
    """Percent of each year's days spent in each regime, one column per regime."""
    total = F.count("*")
    return labels.groupBy(F.year("date").alias("year")).agg(
        *[(100.0 * F.count_if(F.col("regime") == r) / total).alias(r) for r in regimes]
    )


def returns_by_regime(labels: DataFrame) -> DataFrame:
    """Benchmark return statistics of the days spent in each regime."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    r = labels.withColumn("r", change("price", F.lag("price").over(w)))
    year = F.lit(252.0)
    return r.groupBy("regime").agg(
        F.avg("r").alias("mean_daily"), F.stddev_samp("r").alias("std_daily"), F.count("r").alias("n"),
        (F.product(1.0 + F.col("r")) - 1.0).alias("total_return"),
        ratio(F.avg("r") * year, F.stddev_samp("r") * F.sqrt(year)).alias("sharpe"),
    )


def current_summary(labels: DataFrame) -> DataFrame:
    """Latest label with the price's distance from its mean in percent; one row."""
    last = labels.agg(F.max_by(F.struct("date", "regime", "trend", "vol", "price", "ma", "vix"), "date").alias("s"))
    return last.filter(F.col("s").isNotNull()).select("s.*").withColumn("price_vs_ma_pct", change("price", "ma") * 100.0)


def history_stats(history: DataFrame, lookback_rows: int = 252) -> DataFrame:
    """Counts and shares of the last ``lookback_rows`` daily regimes; daily rows are bounded by the calendar."""
    recent = history.orderBy(F.col("date").desc()).limit(lookback_rows)
    return distribution(recent)


def severity(regime: C) -> Column:
    m = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return F.coalesce(F.try_element_at(m, _c(regime)), F.lit(0))


def regime_alerts(daily: DataFrame) -> DataFrame:
    """(date, regime, vix, spread) -> one alert row per change, with its level."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    d = daily.withColumn("previous_regime", F.lag("regime").over(w)).filter(
        F.col("previous_regime").isNotNull() & (F.col("previous_regime") != F.col("regime"))
    )
    worse = severity("regime") > severity("previous_regime")
    level = (
        F.when(worse & F.col("regime").isin("HIGH_VOL", "RECESSION_WARNING"), "CRITICAL")
        .when(worse & (F.col("regime") == "ELEVATED_VOL"), "WARNING")
        .otherwise("INFO")
    )
    return d.withColumns({"level": level, "category": F.lit("REGIME")})


def daily_macro_regime(macro: DataFrame, variant: str = "monitor") -> DataFrame:
    """(date, vix, spread, regime) on every macro date, both series carried forward."""
    wide = macro_wide(macro.filter(F.col("indicator").isin("VIX", "T10Y2Y")), ["VIX", "T10Y2Y"])
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = wide.select(
        "date", F.last("VIX", ignorenulls=True).over(w).alias("vix"), F.last("T10Y2Y", ignorenulls=True).over(w).alias("spread")
    )
    return d.withColumn("regime", macro_regime("vix", "spread", variant))

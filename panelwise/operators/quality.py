"""Data validation and quality checks on bars. Every check returns rows; nothing raises on bad data.

Checks that need the previous bar share the one shuffle by ticker of ``with_previous``; the rest are grouped
aggregates with map-side combination.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwise.functions.dates import bdays_spanned
from panelwise.functions.exprs import change, ratio
from panelwise.functions.joins import bounded

FIELDS = ["open", "high", "low", "close", "volume"]
PRICES = FIELDS[:4]


def with_previous(bars: DataFrame) -> DataFrame:
    """Priced bars with the close and date of the bar before and the age counted from the newest."""
    w = Window.partitionBy("ticker").orderBy("date")
    return bars.filter(F.col("close").isNotNull()).withColumns({
        "prev_close": F.lag("close").over(w), "prev_date": F.lag("date").over(w),
        "age": F.count("*").over(Window.partitionBy("ticker")) - F.row_number().over(w) + 1,
    }).withColumn("r", change("close", "prev_close"))


def trading_days(bars: DataFrame) -> DataFrame:
    return bars.select("date").distinct()


def _violations() -> dict[str, Column]:
    o, h, lo, c = (F.col(x) for x in PRICES)
    missing = sum((F.col(f).isNull().cast("int") for f in FIELDS), F.lit(0))
    return {
        "n_rows": F.count("*"),
        "negative_prices": F.count_if((o < 0) | (h < 0) | (lo < 0) | (c < 0)),
        "bad_high": F.count_if((h < lo) | (h < o) | (h < c)),
        "bad_low": F.count_if((lo > o) | (lo > c)),
        "missing_pct": F.sum(missing) / (F.count("*") * len(FIELDS)),
    }


def _status(max_missing: float) -> Column:
    bad = F.col("negative_prices") + F.col("bad_high") + F.col("bad_low") > 0
    return F.when(bad, "INVALID").when(F.col("missing_pct") > max_missing, "MISSING").otherwise("OK")


def validate(bars: DataFrame, max_missing: float = 0.05) -> DataFrame:
    """Violation counts and a status per ticker."""
    out = bars.groupBy("ticker").agg(*[v.alias(k) for k, v in _violations().items()])
    return out.withColumn("status", _status(max_missing))


def _with_change(bars: DataFrame) -> DataFrame:
    return bars.withColumn("_r", change("close", F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))))


def _anomalies(max_daily_change: float) -> dict[str, Column]:
    flat = (F.col("open") == F.col("high")) & (F.col("open") == F.col("low")) & (F.col("open") == F.col("close"))
    return {
        "suspicious_days": F.count_if(flat), "extreme_changes": F.count_if(F.abs("_r") > max_daily_change),
        "zero_volume": F.count_if(F.col("volume") == 0),
    }


def anomaly_counts(bars: DataFrame, max_daily_change: float = 0.5) -> DataFrame:
    """Flat bars, extreme close-to-close moves and zero-volume days per ticker."""
    return _with_change(bars).groupBy("ticker").agg(*[v.alias(k) for k, v in _anomalies(max_daily_change).items()])


def ingest_screen(bars: DataFrame) -> DataFrame:
    """One row per ticker: kept or dropped (no value at all), validity and the anomaly total, from one pass by ticker."""
    some = F.coalesce(*[F.col(f) for f in FIELDS]).isNotNull()
    counts = {**_violations(), **_anomalies(0.5), "usable_rows": F.count_if(some)}
    j = _with_change(bars).groupBy("ticker").agg(*[v.alias(k) for k, v in counts.items()])
    total = F.col("suspicious_days") + F.col("extreme_changes") + F.col("zero_volume")
    return j.select("ticker", (F.col("usable_rows") > 0).alias("kept"), _status(0.05).alias("status"), total.alias("anomalies"))


def date_coverage(bars: DataFrame, start: str, end: str, tolerance_days: int = 5) -> DataFrame:
    lo, hi = F.min("date"), F.max("date")
    out = bars.groupBy("ticker").agg(lo.alias("first_date"), hi.alias("last_date"))
    d1 = F.abs(F.datediff("first_date", F.lit(start).cast("date")))
    d2 = F.abs(F.datediff("last_date", F.lit(end).cast("date")))
    return out.withColumns({"start_diff": d1, "end_diff": d2, "covered": (d1 <= tolerance_days) & (d2 <= tolerance_days)})


def missing_summary(bars: DataFrame) -> DataFrame:
    """Missing share of the (day, ticker) grid over the five fields, per ticker.

    An absent row misses all five. The grid is never built: absent rows are the number of trading days
    (one-row aggregate) less the rows present.
    """
    n_days = bars.agg(F.count_distinct("date").alias("total_rows"))
    nulls = sum((F.col(f).isNull().cast("int") for f in FIELDS), F.lit(0))
    any_null = nulls > 0
    per = bars.groupBy("ticker").agg(
        F.count("*").alias("_n"), F.sum(nulls).alias("_nulls"), F.count_if(any_null).alias("_partial")
    )
    j = per.join(bounded(n_days, 1))
    absent = F.col("total_rows") - F.col("_n")
    return j.select(
        "ticker",
        (100.0 * (absent * len(FIELDS) + F.col("_nulls")) / (F.col("total_rows") * len(FIELDS))).alias("nan_pct"),
        "total_rows", (absent + F.col("_partial")).alias("missing_rows"),
    )


def over_missing(bars: DataFrame, max_missing: float = 0.05) -> DataFrame:
    return missing_summary(bars).filter(F.col("nan_pct") > 100.0 * max_missing)


def winsorize(returns: DataFrame, lower: float = 0.001, upper: float = 0.999) -> DataFrame:
    """Clip each ticker's returns at its own quantiles; quantiles and clip share the partitioning by ticker."""
    w = Window.partitionBy("ticker")
    q = F.percentile("r", F.array(F.lit(lower), F.lit(upper))).over(w)
    r = returns.withColumn("_q", q)
    return r.withColumn("r", F.when(F.col("r").isNotNull(), F.least(F.greatest("r", F.col("_q")[0]), F.col("_q")[1]))).drop("_q")


def spikes(bars: DataFrame, threshold: float, last_rows: int | None = None) -> DataFrame:
    """Moves beyond the threshold; with ``last_rows`` only among the newest rows, whose oldest has no return."""
    p = with_previous(bars)
    if last_rows:
        p = p.filter(F.col("age") < last_rows)
    return p.filter(F.abs("r") > threshold).select(
        "ticker", "date", F.lit("PRICE_SPIKE").alias("check"), F.col("r").alias("value"), F.col("prev_close").alias("price_before"),
        F.col("close").alias("price_after"),
    )


def quality_score(bars: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Dataset score 0-100 and grade: up to 30 points off for missing cells, up to 20 for price spikes."""
    miss = missing_summary(bars).agg(F.avg("nan_pct").alias("avg_missing_pct"))
    n = with_previous(bars).agg(F.count_if(F.abs("r") > threshold).alias("spike_count"))
    s = miss.join(bounded(n, 1))
    s = s.withColumns({
        "missing_penalty": F.least(F.lit(30), F.floor(F.col("avg_missing_pct") * 10)).cast("long"),
        "spike_penalty": F.least(F.lit(20), F.col("spike_count") * 5).cast("long"),
    })
    s = s.withColumn("total", F.greatest(F.lit(0), 100 - F.col("missing_penalty") - F.col("spike_penalty")).cast("long"))
    grade = F.when(F.col("total") >= 90, "A").when(F.col("total") >= 75, "B").when(F.col("total") >= 60, "C").otherwise("D")
    return s.withColumn("grade", grade)


def staleness(bars: DataFrame, members: DataFrame, as_of: Column, threshold: int = 3) -> DataFrame:
    """Business days since each member's last price; 999 when it never had one."""
    last = bars.filter(F.col("close").isNotNull()).groupBy("ticker").agg(F.max("date").alias("last_date"))
    j = members.join(last, "ticker", "left").withColumn("days_stale", F.coalesce(bdays_spanned("last_date", as_of), F.lit(999)))
    return j.withColumn("is_stale", F.col("days_stale") > threshold)


def gaps(bars: DataFrame, threshold: int = 5) -> DataFrame:
    """Longest gap, their number and the dates before them, per ticker; a ticker's gaps are bounded by its rows."""
    g = with_previous(bars).withColumn("gap", bdays_spanned("prev_date", "date")).filter(F.col("gap") > threshold)
    return g.groupBy("ticker").agg(
        F.max("gap").alias("max_gap_days"), F.count("*").alias("gap_count"), F.array_sort(F.collect_list("prev_date")).alias("gap_dates")
    )


def zero_volume(bars: DataFrame, last_rows: int = 20) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    recent = bars.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= last_rows)
    return recent.filter(F.col("volume") == 0).select("ticker", "date", F.lit("ZERO_VOLUME").alias("check"), F.lit(0.0).alias("value"))


def bad_prices(bars: DataFrame) -> DataFrame:
    kind = F.when(F.col("close") < 0, "NEGATIVE_PRICE").otherwise("ZERO_PRICE")
    return bars.filter(F.col("close") <= 0).select("ticker", "date", kind.alias("check"), F.col("close").alias("value"))


def issues(bars: DataFrame, members: DataFrame, as_of: Column) -> DataFrame:
    """All checks as (ticker, check, value), one row per finding, from one shuffle by ticker.

    Members join as rows without a date, so a ticker that never had a price is seen too. Per-row findings come out
    where they occur; per-ticker findings come out once, at the member's own row.
    """
    rows = bars.select("ticker", "date", "close", "volume").unionByName(members.select("ticker"), allowMissingColumns=True)
    whole = Window.partitionBy("ticker")
    w = whole.orderBy("date")
    over = "over (partition by ticker order by date)"
    n_seen = F.count("close").over(w.rowsBetween(Window.unboundedPreceding, 0))
    r = rows.withColumns({
        "prev_close": F.expr(f"lag(close) ignore nulls {over}"),
        "prev_date": F.expr(f"lag(case when close is not null then date end) ignore nulls {over}"),
        "age": F.count("close").over(whole) - n_seen + 1,
        "bar_age": F.count("date").over(whole) - F.count("date").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1,
        "last_date": F.max(F.when(F.col("close").isNotNull(), F.col("date"))).over(whole),
    })
    is_member, priced = F.col("date").isNull(), F.col("close").isNotNull()
    gap = F.when(priced, bdays_spanned("prev_date", "date"))
    r = r.withColumns({"move": F.when(priced, change("close", "prev_close")), "max_gap": F.max(gap).over(whole)})
    stale = F.coalesce(bdays_spanned("last_date", as_of), F.lit(999))

    def finding(name, value: Column, when: Column) -> Column:
        kind = F.lit(name) if isinstance(name, str) else name
        return F.when(when, F.struct(kind.alias("check"), value.cast("double").alias("value")))

    found = F.array_compact(F.array(
        finding("STALE", stale, is_member & (stale > 3)),
        finding("GAP", F.col("max_gap"), is_member & (F.col("max_gap") > 5)),
        finding("PRICE_SPIKE", F.col("move"), (F.col("age") < 252) & (F.abs("move") > 0.10)),
        finding("ZERO_VOLUME", F.lit(0.0), (F.col("bar_age") <= 20) & (F.col("volume") == 0)),
        finding(F.when(F.col("close") < 0, "NEGATIVE_PRICE").otherwise("ZERO_PRICE"), F.col("close"), F.col("close") <= 0),
    ))
    return r.select("ticker", F.inline(found))


def overall_status(found: DataFrame) -> DataFrame:
    """One row: counts by kind and OK / WARNING / CRITICAL (more than five stale tickers)."""
    kinds = F.col("check")
    s = found.agg(
        F.count_if(kinds == "STALE").alias("stale_count"), F.count_if(kinds == "GAP").alias("gap_count"),
        F.count_if(~kinds.isin("STALE", "GAP")).alias("anomaly_count"),
    )
    status = (
        F.when(F.col("stale_count") > 5, "CRITICAL")
        .when(F.col("stale_count") + F.col("gap_count") + F.col("anomaly_count") > 0, "WARNING")
        .otherwise("OK")
    )
    return s.withColumn("overall_status", status)


def alerts(found: DataFrame) -> DataFrame:
    """(level, category, check, n): one alert per group of findings."""
    group = F.when(F.col("check").isin("STALE", "GAP"), F.col("check")).otherwise("ANOMALY")
    a = found.groupBy(group.alias("check")).agg(F.count("*").alias("n"))
    level = F.when((F.col("check") == "STALE") & (F.col("n") > 5), "CRITICAL").otherwise("WARNING")
    return a.select(level.alias("level"), F.lit("DATA_QUALITY").alias("category"), "check", "n")


def summary(bars: DataFrame, members: DataFrame) -> DataFrame:
    """Found and missing tickers and the completeness of the close grid; one row."""
    days = bars.agg(F.count_distinct("date").alias("trading_days"), F.min("date").alias("start"), F.max("date").alias("end"))
    per = bars.groupBy("ticker").agg(F.count("close").alias("n"))
    j = members.join(per, "ticker", "left").join(bounded(days, 1))
    found = F.col("n").isNotNull()
    gap = F.when(found, F.col("trading_days") - F.col("n"))
    out = j.agg(
        F.count("*").alias("tickers_requested"), F.count_if(found).alias("tickers_found"), F.count_if(~found).alias("tickers_missing"),
        F.max("trading_days").alias("trading_days"), F.max("start").alias("start"), F.max("end").alias("end"),
        F.sum(F.when(found, F.col("trading_days"))).alias("total_values"), F.sum(gap).alias("nan_count"),
        F.count_if(gap > 0).alias("tickers_with_nan"),
    )
    return out.withColumn("nan_percentage", F.coalesce(100.0 * ratio("nan_count", "total_values"), F.lit(0.0)))

"""Cross-sectional ranking signals over the states of ``asof.observe``.

Each signal is a pair: the spans it needs and a score expression. ``score`` observes the union of the
spans once, so any number of signals and parameter sets share one shuffle of the panel. A score is NULL
when the history is too short.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window, functions as F

from panelwise.functions.exprs import literal, ratio
from panelwise.functions.joins import DAYS, bounded
from panelwise.operators.asof import observe, span_name

BUFFER_DAYS = 50
YEAR = 252


def _span_return(rows: int, days: int, min_periods: int) -> str:
    """p_last / p_first - 1 over the last ``rows`` closes; the history test counts the whole read window."""
    window, first = span_name(None, days), span_name(rows, days)
    return (
        f"case when last.seq - {window}.seq + 1 >= {min_periods} and last.seq - {first}.seq >= 1 "
        f"then try_divide(last.close, {first}.close) - 1 end"
    )


def _span_volatility(rows: int, days: int, min_returns: int) -> str:
    """Sample deviation of the returns inside the span, from running totals."""
    f = span_name(rows, days)
    n, s, ss = f"(last.n_r - {f}.n_r)", f"(last.s_r - {f}.s_r)", f"(last.s_rr - {f}.s_rr)"
    var = f"greatest(try_divide({ss} - {s} * try_divide({s}, {n}), {n} - 1), 0)"
    return f"case when {n} >= {min_returns} then sqrt({var}) end"


@dataclass(frozen=True)
class Signal:
    """A named score. ``spans`` feed ``observe``; ``sql`` is evaluated per (ticker, as_of) on its states.

    Text keeps wide grids cheap to build: one expression per score instead of a tree of calls.
    """

    name: str
    spans: tuple[tuple[int | None, int | None], ...]
    sql: str
    needs_benchmark: bool = False


def in_rows(signal: Signal) -> Signal:
    """The same signal with its lookback counted in rows alone: however many calendar days they span, and all history counts for the
    length test. A signal without a number of rows, such as a regression over a calendar window, has no such form."""
    if not any(rows for rows, _ in signal.spans):
        raise ValueError(f"{signal.name} has no lookback in rows")
    sql = signal.sql
    for rows, days in signal.spans:
        sql = re.sub(rf"\b{span_name(rows, days)}\b", span_name(rows, None), sql)
    return replace(signal, spans=tuple((rows, None) for rows, _ in signal.spans), sql=sql)


def momentum(
    lookback: int = 252, min_periods: int = 200, name: str = "momentum", read_days: int | None = None
) -> Signal:
    """``read_days`` overrides the calendar window, for models that share a longer read."""
    days = read_days or lookback + BUFFER_DAYS
    return Signal(name, ((lookback, days), (None, days)), _span_return(lookback, days, min_periods))


def acceleration(short: int, long: int, min_periods: int, name: str) -> Signal:
    """Short-window return less long-window return, without the parameter checks of the public model."""
    days = long + BUFFER_DAYS
    return Signal(
        name, ((short, days), (long, days), (None, days)),
        f"({_span_return(short, days, min_periods)}) - ({_span_return(long, days, min_periods)})",
    )


def momentum_acceleration(
    short: int = 63, long: int = 252, min_periods: int = 200, name: str = "momentum_acceleration"
) -> Signal:
    if short >= long:
        raise ValueError("short lookback must be below the long one")
    if min_periods < short:
        raise ValueError("min_periods must reach the short lookback")
    if short < 20:
        raise ValueError("short lookback must be at least 20 days")
    return acceleration(short, long, min_periods, name)


def vol_adjusted_momentum(
    lookback: int = 252, min_periods: int = 200, vol_floor: float = 0.01, name: str = "vol_adjusted_momentum"
) -> Signal:
    days = lookback + BUFFER_DAYS
    vol = f"({_span_volatility(lookback, days, 10)}) * sqrt({YEAR})"
    ret = _span_return(lookback, days, min_periods)
    # greatest() skips NULL, so an undefined volatility is tested first.
    sql = f"case when ({vol}) is not null then try_divide({ret}, greatest({vol}, double('{vol_floor!r}'))) end"
    return Signal(name, ((lookback, days), (None, days)), sql)


def residual_momentum(
    lookback: int = 252, min_periods: int = 200, benchmark: str = "SPY", name: str = "residual_momentum"
) -> Signal:
    """Cumulative alpha of the regression on the benchmark: intercept times observations.

    The sum of least-squares residuals with an intercept is zero by construction, so it cannot rank
    anything; the part of the return that the benchmark does not explain is the intercept.
    Returns pair up per ticker and date.
    """
    days = lookback + BUFFER_DAYS
    a = span_name(None, days)
    d = {k: f"(last.{k} - {a}.{k})" for k in ("n_xy", "s_x", "s_y", "s_xx", "s_xy")}
    slope = f"try_divide({d['n_xy']} * {d['s_xy']} - {d['s_x']} * {d['s_y']}, {d['n_xy']} * {d['s_xx']} - {d['s_x']} * {d['s_x']})"
    sql = f"case when ticker <> {literal(benchmark)} and {d['n_xy']} >= {min_periods} then {d['s_y']} - {slope} * {d['s_x']} end"
    return Signal(name, ((None, days),), sql, needs_benchmark=True)


def score(
    bars: DataFrame, marks: DataFrame, signals: Sequence[Signal], benchmark_returns: DataFrame | None = None
) -> DataFrame:
    """One column per signal next to (ticker, as_of, price); a single pass over the panel."""
    use = benchmark_returns if any(s.needs_benchmark for s in signals) else None
    seen = observe(bars, marks, [sp for s in signals for sp in s.spans], use)
    return seen.selectExpr("ticker", "as_of", "last.close as price", *[f"{s.sql} as {s.name}" for s in signals])


def to_scores(wide: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One column per signal -> (model, as_of, ticker, score); an explode, no shuffle."""
    cells = F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).alias("score")) for n in names])
    return wide.select("as_of", "ticker", *keep, F.inline(cells))


def trend_flag(bars: DataFrame, marks: DataFrame, ticker: str, ma_period: int) -> DataFrame:
    """(as_of, bullish): last benchmark close above its mean over ``ma_period`` rows; short history is bullish."""
    seen = observe(bars.filter(F.col("ticker") == ticker), marks.filter(F.col("ticker") == ticker), [(ma_period, None)])
    first, last = F.col(span_name(ma_period, None)), F.col("last")
    full = last["seq"] - first["seq"] + 1 >= ma_period
    mean = (last["s_close"] - first["s_close"] + first["close"]) / F.lit(float(ma_period))
    return seen.select("as_of", F.coalesce(F.when(full, last["close"] > mean), F.lit(True)).alias("bullish"))


def trend_filtered(scores: DataFrame, flags: DataFrame, column: str, defensive: Sequence[str]) -> DataFrame:
    """Momentum while the trend is up; otherwise 1 for the defensive tickers and 0 for the rest.

    ``flags`` has one row per decision date, a bound set by the schedule, hence the broadcast.
    """
    safe = F.when(F.col("ticker").isin(list(defensive)), 1.0).otherwise(0.0)
    return scores.join(bounded(flags.groupBy("as_of").agg(F.bool_or("bullish").alias("bullish")), DAYS), "as_of", "left").withColumn(
        column, F.when(F.coalesce("bullish", F.lit(True)), F.col(column)).otherwise(safe)
    )


def dual_momentum(
    scores: DataFrame, column: str, lookback: int, risk_free: float, safe: Sequence[str],
    keys: Sequence[str] = ("as_of",),
) -> DataFrame:
    """Risky tickers above the hurdle keep their return, the rest get 0; if none passes, safe tickers get 1."""
    is_safe = F.col("ticker").isin(list(safe))
    passes = ~is_safe & (F.col(column) > risk_free * lookback / YEAR)
    # One flag per group by a partial aggregate, joined back; groups by date alone are bounded by the calendar.
    any_pass = scores.groupBy(*keys).agg(F.coalesce(F.bool_or(passes), F.lit(False)).alias("risk_on"))
    out = scores.join(bounded(any_pass, DAYS) if tuple(keys) == ("as_of",) else any_pass, list(keys))
    picked = F.when(F.col("risk_on"), F.when(passes, F.col(column)).otherwise(0.0)).otherwise(
        F.when(is_safe, 1.0).otherwise(0.0)
    )
    return out.withColumns({column: picked, "signal_type": F.when(F.col("risk_on"), "MOMENTUM").otherwise("SAFE")})


def zscore(df: DataFrame, column: str, out: str, keys: Sequence[str] = ("as_of",)) -> DataFrame:
    """(x - mean) / sample deviation per group; 0 when the deviation is 0 or undefined."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_samp(column).over(w)
    z = ratio(F.col(column) - F.avg(column).over(w), sd)
    return df.withColumn(out, F.when(F.col(column).isNotNull(), F.coalesce(z, F.lit(0.0))))


def value_momentum(
    scores: DataFrame, mom: str, val: str, momentum_weight: float = 0.5, value_weight: float = 0.5,
    keys: Sequence[str] = ("as_of",),
) -> DataFrame:
    """Blend of z(momentum) and z(-long return); the components stay as columns."""
    total = momentum_weight + value_weight
    if abs(total - 1.0) > 0.001 and total > 0:
        momentum_weight, value_weight = momentum_weight / total, value_weight / total
    out = zscore(scores, mom, "momentum_z", keys)
    out = zscore(out.withColumn("_neg", -F.col(val)), "_neg", "value_z", keys).drop("_neg")
    return out.withColumn("blended", momentum_weight * F.col("momentum_z") + value_weight * F.col("value_z"))


def business_window_features(
    returns: DataFrame, marks: DataFrame, lookback: int = 126, skip: int = 5, vol_lookback: int = 60
) -> DataFrame:
    """Compounded return over [as_of - skip - lookback, as_of - skip] and deviation over [as_of - vol_lookback, as_of],
    all in business days and inclusive. Same marker plan as ``observe``, on the business-day index."""
    from panelwise.functions.dates import bday_index

    rows = returns.filter(F.col("r").isNotNull()).select(
        "ticker", bday_index("date").alias("key"), "r", F.lit(None).cast("date").alias("as_of")
    )
    s = rows.unionByName(
        marks.select("ticker", bday_index("as_of").alias("key"), "as_of"), allowMissingColumns=True
    )
    by = Window.partitionBy("ticker").orderBy("key")
    lo = Window.unboundedPreceding

    def upto(back: int):
        return by.rangeBetween(lo, -back)

    # log1p keeps long products in range; -100% returns are absent from positive prices.
    s = s.withColumn("g", F.log1p("r"))
    end, start = upto(skip), upto(skip + lookback + 1)
    now, then = upto(0), upto(vol_lookback + 1)

    def diff(fn, a, b):
        return F.coalesce(fn.over(a), F.lit(0.0)) - F.coalesce(fn.over(b), F.lit(0.0))

    n = (F.count("r").over(now) - F.count("r").over(then)).cast("double")
    s1, s2 = diff(F.sum("r"), now, then), diff(F.sum(F.col("r") * F.col("r")), now, then)
    s = s.withColumns({
        "momentum": F.exp(diff(F.sum("g"), end, start)) - 1.0,
        "vol": F.when(n >= 2, F.sqrt(F.greatest(ratio(s2 - s1 * ratio(s1, n), n - 1.0), F.lit(0.0)))),
    })
    return s.filter(F.col("as_of").isNotNull()).select("as_of", "ticker", "momentum", "vol")

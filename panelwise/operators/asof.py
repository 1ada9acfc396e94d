"""Point-in-time reads.

Many decision dates are served by one pass. Decision dates join the price rows as marker rows of the
same ticker (union), and the values "as seen then" come from running window frames. So the panel is
shuffled once by ticker and sorted once, whatever the number of dates and lookbacks; a range join would
copy every bar into each lookback window it falls in. One ticker holds at most one row per
calendar day plus one per decision date, which bounds a window partition.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwise.functions.exprs import C, _c, change
from panelwise.functions.joins import DAYS, bounded


# Number of spans from which a pass over the panel is limited by computation rather than by data.
WIDE = 8


def read_prices(bars: DataFrame, as_of: C, lookback_days: int | None = None) -> DataFrame:
    """Bars strictly before ``as_of``; lookback in calendar days. Literal dates reach the Parquet filter."""
    at = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    out = bars.filter(F.col("date") < at)
    return out if lookback_days is None else out.filter(F.col("date") >= F.date_sub(at, lookback_days))


def read_range(bars: DataFrame, start: str, end: str) -> DataFrame:
    return bars.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def unknown_tickers(requested: DataFrame, bars: DataFrame) -> DataFrame:
    return requested.join(bars.select("ticker").distinct(), "ticker", "left_anti")


def availability(requested: DataFrame, bars: DataFrame, as_of: str) -> DataFrame:
    have = read_prices(bars, as_of).groupBy("ticker").agg(F.max("date").alias("last_date"))
    return requested.join(have, "ticker", "left").select("ticker", F.col("last_date").isNotNull().alias("available"))


def markers(members: DataFrame, days: Column) -> DataFrame:
    """(key columns, as_of): each member at each decision date; an explode of a constant array."""
    return members.select("*", F.explode(days).alias("as_of"))


def as_of(
    series: DataFrame,
    marks: DataFrame,
    keys: list[str],
    columns: list[str],
    inclusive: bool = False,
    date_col: str = "date",
) -> DataFrame:
    """Last row of ``series`` before (or on) each mark, per key. Marks without history keep NULLs."""
    tie = 0 if inclusive else 1
    rows = series.select(
        *keys, F.col(date_col).alias("_d"), F.lit(tie).alias("_tie"),
        F.struct(F.col(date_col).alias("seen_date"), *columns).alias("_v"), F.lit(False).alias("_mark"),
    )
    pts = marks.select(*keys, F.col("as_of").alias("_d"), F.lit(1 - tie).alias("_tie"), F.lit(True).alias("_mark"))
    w = Window.partitionBy(*keys).orderBy("_d", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.unionByName(pts, allowMissingColumns=True)
        .withColumn("_v", F.last("_v", ignorenulls=True).over(w))
        .filter("_mark")
        .select(*keys, F.col("_d").alias("as_of"), "_v.*")
    )


def panel_row(series: DataFrame, marks: DataFrame, columns: list[str], inclusive: bool = False) -> DataFrame:
    """Values in the panel's newest row before (or on) each mark; a ticker without a bar on that date has NULLs.

    The strict form of ``as_of``, which would go back further. The panel's dates are reduced to one row a day before they meet the
    decision dates, and one row a decision date comes back.
    """
    one = F.lit(1).alias("_k")
    days = series.select(one, "date").distinct()
    newest = as_of(days, marks.select(one, "as_of").distinct(), ["_k"], [], inclusive).select("as_of", F.col("seen_date").alias("panel_date"))
    own = as_of(series, marks, ["ticker"], columns, inclusive).join(bounded(newest, DAYS), "as_of")
    there = F.col("seen_date") == F.col("panel_date")
    return own.select("ticker", "as_of", "panel_date", *[F.when(there, F.col(c)).alias(c) for c in columns])


def forward_fill(grid: DataFrame, keys: list[str], value: str, date_col: str = "date") -> DataFrame:
    """Carry the last non-null value forward within the keys."""
    w = Window.partitionBy(*keys).orderBy(date_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.withColumn(value, F.last(value, ignorenulls=True).over(w))


def span_name(rows: int | None, days: int | None) -> str:
    return f"w_{rows or 'all'}_{days or 'all'}"


def observe(
    bars: DataFrame,
    marks: DataFrame,
    spans: Iterable[tuple[int | None, int | None]],
    benchmark_returns: DataFrame | None = None,
) -> DataFrame:
    """State of every ticker as of every mark, at both ends of each lookback span.

    A span ``(rows, days)`` is the last ``rows`` closes among those dated in ``[as_of - days, as_of)``.
    Either part may be None. Each bar carries running totals (closes, returns, squared returns and, with a
    benchmark, cross products), so any window statistic is a difference of two states.

    Returns (ticker, as_of, last, w_<rows>_<days>...) with the states as structs; ``last`` is the newest
    bar before ``as_of`` and a span column is its oldest bar.
    """
    px = bars.filter(F.col("close").isNotNull()).select("ticker", "date", "close")
    if benchmark_returns is not None:
        # At most one row per calendar day, so its size is bounded whatever the panel holds.
        daily = benchmark_returns.groupBy("date").agg(F.first("r").alias("x"))
        px = px.join(bounded(daily, DAYS), "date", "left")
    else:
        px = px.withColumn("x", F.lit(None).cast("double"))
    # Bars get the odd key 2d+1 and marks the even key 2d: a mark sorts before the bar of its own day.
    s = px.withColumn("key", F.unix_date("date") * 2 + 1).unionByName(
        marks.select("ticker", "as_of", (F.unix_date("as_of") * 2).alias("key")), allowMissingColumns=True
    )
    spans = sorted(set(spans), key=str)
    if len(spans) > WIDE:
        # Many frames make the stage CPU-bound, while partition coalescing only looks at bytes.
        s = s.repartition(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ticker")
    by = Window.partitionBy("ticker").orderBy("key")
    over = "over (partition by ticker order by key)"
    run = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("y", change("close", F.expr(f"lag(close) ignore nulls {over}")))

    def total(v: Column) -> Column:
        return F.coalesce(F.sum(v).over(run), F.lit(0.0))

    fields = {
        "seq": F.count("close").over(run),
        "s_close": total(F.col("close")),
        "n_r": F.count("y").over(run),
        "s_r": total(F.col("y")),
        "s_rr": total(F.col("y") * F.col("y")),
    }
    if benchmark_returns is not None:
        both = F.col("x").isNotNull() & F.col("y").isNotNull()
        x, y = F.when(both, F.col("x")), F.when(both, F.col("y"))
        fields |= {
            "n_xy": F.count(x).over(run),
            "s_x": total(x), "s_y": total(y), "s_xx": total(x * x), "s_xy": total(x * y),
        }
    s = s.withColumns(fields)
    state = F.when(F.col("as_of").isNull(), F.struct("date", "close", *fields))
    s = s.select("ticker", "as_of", "key", state.alias("state"))
    s = s.withColumns({
        "last": F.last("state", ignorenulls=True).over(run),
        "oldest": F.first("state", ignorenulls=True).over(run),
        "next": F.expr(f"lead(state) ignore nulls {over}"),
    })
    lags = {f"lag_{n}": F.expr(f"lag(state, {n}) ignore nulls {over}") for n in {r for r, _ in spans if r}}
    starts = {
        f"start_{n}": F.last("next", ignorenulls=True).over(by.rangeBetween(Window.unboundedPreceding, -(2 * n + 1)))
        for n in {d for _, d in spans if d}
    }
    s = s.withColumns({**lags, **starts}).filter(F.col("as_of").isNotNull())
    cols = []
    for rows, days in spans:
        first = F.coalesce(F.col(f"start_{days}"), F.col("oldest")) if days else F.col("oldest")
        if rows:
            back = F.col(f"lag_{rows}")
            first = F.when(back["seq"] > first["seq"], back).otherwise(first)
        # The window is empty when even the newest bar is older than its start.
        newest = F.col("last")["date"]
        live = newest >= F.date_sub("as_of", days) if days else newest.isNotNull()
        cols.append(F.when(live, first).alias(span_name(rows, days)))
    return s.select("ticker", "as_of", "last", *cols)

"""Grid search as one plan: every parameter set, universe and size is a column, not a run.

Scores depend on (model, parameters, date) only. They are computed once for all sets in a single pass over the
panel, whatever their schedules, then fanned out to universes, ranked once for the largest size, and only the few
ranked rows are fanned out to the sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwise import CASH
from panelwise.functions.dates import schedule_tables, union_days
from panelwise.functions.exprs import literal
from panelwise.functions.joins import CONFIGS, DAYS, bounded
from panelwise.operators import accounting, asof, signals as S
from panelwise.operators.grid import TOP_N, ParamSet, param_table, strategy_key
from panelwise.operators.returns import benchmark_returns


def grid_scores(
    bars: DataFrame, members: DataFrame, schedules: dict[str, Column], sets: list[ParamSet], benchmark: str
) -> DataFrame:
    """(param_id, as_of, ticker, price, growth, s, v) for the sets of all schedules.

    The panel is observed once at the union of the dates. A row is then taken once for each schedule that its date
    belongs to, and only that schedule's sets are scored on it.
    """
    marks = asof.markers(members, union_days(schedules))
    owned = [(p, x) for p in sets for x in p.signals(benchmark)]
    bench = benchmark_returns(bars, benchmark) if any(x.needs_benchmark for _, x in owned) else None
    seen = asof.observe(bars, marks, [sp for _, x in owned for sp in x.spans], bench)
    dates = schedule_tables(bars.sparkSession, schedules).select("schedule", "as_of")
    at = seen.join(bounded(dates, DAYS), "as_of")
    wide = at.selectExpr("schedule", "ticker", "as_of", "last.close as price", *[
        f"case when schedule = {literal(p.schedule)} then {x.sql} end as {x.name}" for p, x in owned])
    wide = accounting.forward_growth(wide, keys=("schedule", "ticker"))
    names = {x.name for _, x in owned}

    def cells(schedule: str) -> str:
        return ", ".join(
            f"struct({p.param_id} as param_id, p{p.param_id} as s, "
            f"{f'p{p.param_id}v' if f'p{p.param_id}v' in names else 'double(null)'} as v)"
            for p in sets if p.schedule == schedule)

    cases = " ".join(f"when {literal(k)} then array({cells(k)})" for k in sorted({p.schedule for p in sets}))
    return wide.selectExpr("as_of", "ticker", "price", "growth", f"inline(case schedule {cases} end)")


def grid_weights(
    scores: DataFrame, params: DataFrame, universes: DataFrame, flags: DataFrame | None, safe: list[str], top_n: list[int] = TOP_N
) -> DataFrame:
    """Weights of every configuration: (schedule, strategy_id, as_of, ticker, weight, growth).

    ``universes``: (universe_no, ticker). ``flags``: (ma_period, as_of, bullish). ``params`` and ``flags`` have one row
    per set and per date and period, hence the broadcasts.
    """
    s = scores.join(bounded(params.select("param_id", "schedule", "alpha", "hurdle", "momentum_weight", "ma_period"), CONFIGS), "param_id")
    if flags is None:
        s = s.withColumn("bullish", F.lit(None).cast("boolean"))
    else:
        s = s.join(bounded(flags, 10 * DAYS), ["ma_period", "as_of"], "left")
    s = s.join(universes, "ticker")
    group = Window.partitionBy("param_id", "universe_no", "as_of")
    is_safe = F.col("ticker").isin(safe)
    raw, alpha = F.col("s"), F.col("alpha")
    passes = ~is_safe & (raw > F.col("hurdle"))

    def z(c: Column) -> Column:
        sd = F.stddev_samp(c).over(group)
        return F.when(c.isNotNull(), F.coalesce(F.try_divide(c - F.avg(c).over(group), sd), F.lit(0.0)))

    defensive = F.when(is_safe, 1.0).otherwise(0.0)
    risk_on = F.coalesce(F.bool_or(passes).over(group), F.lit(False))
    score = (
        F.when(alpha == "trend_filtered_momentum", F.when(F.coalesce("bullish", F.lit(True)), raw).otherwise(defensive))
        .when(alpha == "dual_momentum", F.when(risk_on, F.when(passes, raw).otherwise(0.0)).otherwise(defensive))
        .when(alpha == "value_momentum", F.col("momentum_weight") * z(raw) + (1.0 - F.col("momentum_weight")) * z(-F.col("v")))
        .otherwise(raw)
    )
    s = s.withColumn("score", score)
    order = group.orderBy(F.col("score").desc_nulls_last(), "ticker")
    top = s.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(top_n))
    top = top.withColumn("found", F.count("score").over(group)).select(
        "schedule", "param_id", "universe_no", "as_of", "ticker", "growth", "score", "rank", "found",
        F.explode(F.array(*[F.lit(n) for n in top_n])).alias("top_n"),
    ).filter(F.col("rank") <= F.col("top_n"))
    w, free = F.lit(1.0) / F.col("top_n"), F.col("top_n") - F.least("found", "top_n")
    rows = F.array_compact(F.array(
        F.when(F.col("score").isNotNull(), F.struct("ticker", w.alias("weight"), "growth")),
        F.when((F.col("rank") == 1) & (free > 0), F.struct(F.lit(CASH).alias("ticker"), (free * w).alias("weight"), F.lit(None).cast("double").alias("growth"))),
    ))
    return top.select(
        "schedule", strategy_key(F.col("param_id"), F.col("universe_no"), F.col("top_n")).alias("strategy_id"), "as_of", F.inline(rows)
    )


def trend_flags(bars: DataFrame, members: DataFrame, days: Column, benchmark: str, periods: list[int]) -> DataFrame:
    """(ma_period, as_of, bullish) of each period in use; one pass over the benchmark's bars."""
    own = bars.filter(F.col("ticker") == benchmark)
    marks = asof.markers(members, days).filter(F.col("ticker") == benchmark)
    seen = asof.observe(own, marks, [(n, None) for n in periods])
    cells = []
    for n in periods:
        first, last = F.col(asof.span_name(n, None)), F.col("last")
        full = last["seq"] - first["seq"] + 1 >= n
        mean = (last["s_close"] - first["s_close"] + first["close"]) / F.lit(float(n))
        cells.append(F.struct(F.lit(n).alias("ma_period"), F.coalesce(F.when(full, last["close"] > mean), F.lit(True)).alias("bullish")))
    return seen.select("as_of", F.inline(F.array(*cells)))


def grid_curves(
    bars: DataFrame, members: DataFrame, universes: DataFrame, schedules: dict[str, Column], sets: list[ParamSet],
    benchmark: str, safe: list[str], cost_bps: float = 10.0,
) -> DataFrame:
    """Value curves of all configurations. ``schedules``: days of each schedule that the sets name."""
    spark = bars.sparkSession
    scores = grid_scores(bars, members, schedules, sets, benchmark)
    mas = sorted({p.params["ma_period"] for p in sets if "ma_period" in p.params})
    flags = trend_flags(bars, members, union_days(schedules), benchmark, mas) if mas else None
    w = grid_weights(scores, param_table(spark, sets), universes, flags, safe)
    return accounting.periodic_value(w, schedule_tables(spark, schedules), cost_bps)

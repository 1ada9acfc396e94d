"""Scores -> target weights, and turnover between consecutive targets.

``keys`` name the portfolio: usually (strategy_id, as_of). A portfolio holds at most one row per
instrument, so a window partition is bounded by the universe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelwise import CASH
from panelwise.functions.exprs import ratio
from panelwise.functions.joins import DAYS, bounded


def ranked(scores: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Rank by score, best first, ticker as tie-break; unscored rows come last."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col("ticker"))
    return scores.withColumn("rank", F.row_number().over(w))


def top_n_equal_weight(
    scores: DataFrame, n, keys: Sequence[str], score: str = "score", carry: Sequence[str] = ()
) -> DataFrame:
    """1/n to each of the n best; the share of unfilled slots goes to cash, all of it when nothing is scored.

    ``n`` is a number or the name of a column. The rank filter is pushed below the shuffle by the optimizer
    (per-task group limit), so about n rows per task and portfolio move; the cash row comes out
    of the same pass, from the last ranked row kept.
    """
    size = F.col(n) if isinstance(n, str) else F.lit(int(n))
    by = Window.partitionBy(*keys)
    top = ranked(scores, keys, score).filter(F.col("rank") <= size)
    filled = F.count(score).over(by)
    w = F.lit(1.0) / size
    top = top.withColumns({"_filled": filled, "_w": w})
    cash = ((size - F.col("_filled")) * w).alias("weight")
    nulls = [F.lit(None).cast(scores.schema[c].dataType).alias(c) for c in carry]
    held = F.struct(F.col("ticker"), F.col("_w").alias("weight"), F.col("rank"), *carry)
    rest = F.struct(F.lit(CASH).alias("ticker"), cash, F.lit(None).cast("int").alias("rank"), *nulls)
    rows = F.array_compact(F.array(
        F.when(F.col(score).isNotNull(), held),
        F.when((F.col("rank") == 1) & (F.col("_filled") < size), rest),
    ))
    kept = [c for c in top.columns if c not in {"ticker", score, "rank", "_filled", "_w", *carry}]
    return top.select(*kept, F.inline(rows))


def top_x_fully_invested(
    scores: DataFrame, x: int, keys: Sequence[str], min_weight: float = 0.0, max_weight: float = 1.0
) -> DataFrame:
    """1/count to the x best scored, then clip and renormalise."""
    top = ranked(scores.filter(F.col("score").isNotNull()), keys).filter(F.col("rank") <= x)
    w = top.withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy(*keys)))
    return clip_weights(w.drop("rank", "score"), keys, min_weight, max_weight)


def clip_weights(weights: DataFrame, keys: Sequence[str], lo: float, hi: float) -> DataFrame:
    """Bound every weight and rescale to sum 1 when the bounded sum is not 0."""
    bounded = F.greatest(F.least(F.col("weight"), F.lit(float(hi))), F.lit(float(lo)))
    total = F.sum("weight").over(Window.partitionBy(*keys))
    w = weights.withColumn("weight", bounded)
    return w.withColumn("weight", F.coalesce(ratio(F.col("weight"), total), F.col("weight")))


def paired(
    weights: DataFrame, calendar: DataFrame, carry_growth: bool = False, start_in_cash: bool = True
) -> DataFrame:
    """(strategy_id, as_of, ticker, prev_w, next_w[, grown]): each target next to the one before it.

    A target is the new weight at its own date and the previous weight at the next date, so the full outer
    join with the previous portfolio is an explode and one grouped sum. The first target follows cash when
    ``start_in_cash`` (weights must then sum to 1), else an empty portfolio.
    ``calendar`` is (as_of, next_as_of, seq), one row per date, hence the broadcast; with a column ``schedule`` on
    both sides each portfolio follows the dates of its own schedule.
    """
    on = ["schedule", "as_of"] if "schedule" in calendar.columns and "schedule" in weights.columns else ["as_of"]
    cal = bounded(calendar.select(*on, "next_as_of", "seq"), DAYS)
    g = F.col("growth") if carry_growth else F.lit(1.0)
    w = weights.join(cal, on).withColumn("_held", F.col("weight") * F.coalesce(g, F.lit(0.0)))
    zero, first = F.lit(0.0), F.col("seq") == 0
    if "run_start" in weights.columns:
        # Runs over parts of the calendar: each starts at its own date and ends by its own.
        first = F.col("as_of") == F.col("run_start")
        w = w.withColumn("next_as_of", F.when(F.col("next_as_of") <= F.col("run_end"), F.col("next_as_of")))

    def row(at, prev, nxt, grown):
        return F.struct(at.alias("at"), F.col("ticker").alias("t"), prev.alias("prev_w"), nxt.alias("next_w"), grown.alias("grown"))

    rows = F.array(
        row(F.col("as_of"), zero, F.col("weight"), zero),
        row(F.col("next_as_of"), F.col("weight"), zero, F.col("_held")),
        # The portfolio starts in cash: one such row per portfolio, spread over its first-date rows.
        F.when(
            first & F.lit(start_in_cash),
            F.struct(
                F.col("as_of").alias("at"), F.lit(CASH).alias("t"), F.col("weight").alias("prev_w"),
                zero.alias("next_w"), F.col("weight").alias("grown"),
            ),
        ),
    )
    flat = w.select("strategy_id", F.inline(F.array_compact(rows))).filter(F.col("at").isNotNull())
    # Shuffled by portfolio, which is bounded by its positions: the sums by ticker here and by portfolio in
    # the callers then need no further exchange.
    flat = flat.repartition("strategy_id", "at")
    out = flat.groupBy("strategy_id", F.col("at").alias("as_of"), F.col("t").alias("ticker")).agg(
        F.sum("prev_w").alias("prev_w"), F.sum("next_w").alias("next_w"), F.sum("grown").alias("grown")
    )
    return out if carry_growth else out.drop("grown")


def turnover(pairs: DataFrame) -> DataFrame:
    """Half the sum of absolute weight changes per rebalance."""
    return pairs.groupBy("strategy_id", "as_of").agg(
        (0.5 * F.sum(F.abs(F.col("next_w") - F.col("prev_w")))).alias("turnover")
    )

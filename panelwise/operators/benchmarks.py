"""Passive and reference portfolios. Input ``priced``: (ticker, as_of, price[, growth]) at the decision dates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from panelwise import CASH
from panelwise.operators import accounting, construction


def like_strategy(priced: DataFrame, weights: DataFrame) -> DataFrame:
    """Add ``n_selected``: the strategy's mean number of positions, cash aside, rounded half to even and at least 1.

    One row decides it, in the same plan.
    """
    held = weights.groupBy("as_of").agg(F.count_if((F.col("ticker") != CASH) & (F.col("weight") > 0)).alias("n"))
    size = held.agg(F.greatest(F.lit(1), F.bround(F.avg("n"), 0).cast("int")).alias("n_selected"))
    return priced.crossJoin(F.broadcast(size))


def fixed_mix(priced: DataFrame, mix: Mapping[str, float], name: str) -> DataFrame:
    """Constant weights; dates where a member has no price yet are left out."""
    m = F.create_map(*[F.lit(x) for kv in mix.items() for x in kv])
    w = priced.filter(F.col("ticker").isin(list(mix))).withColumn("weight", F.try_element_at(m, F.col("ticker")))
    full = F.count("price").over(Window.partitionBy("as_of")) == len(mix)
    return w.withColumn("_full", full).filter("_full").drop("_full").withColumn("strategy_id", F.lit(name))


def equal_weight(priced: DataFrame, name: str = "bench:equal_weight") -> DataFrame:
    """1 / number of priced instruments."""
    ok = priced.filter(F.col("price") > 0)
    w = F.lit(1.0) / F.count("*").over(Window.partitionBy("as_of"))
    return ok.withColumns({"weight": w, "strategy_id": F.lit(name)})


def random_selection(priced: DataFrame, n: int | str, trials: int, seed: int = 42) -> DataFrame:
    """Weights of ``trials`` portfolios of ``n`` random instruments, a number or a column's name, drawn by a seeded hash.

    The draw depends only on (seed, trial, date, ticker), so a retried task draws the same names.
    """
    ok = priced.filter(F.col("price") > 0).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    draw = F.md5(F.concat_ws("|", F.lit(seed), "trial", "as_of", "ticker"))
    w = Window.partitionBy("trial", "as_of").orderBy(draw, "ticker")
    size = F.col(n) if isinstance(n, str) else F.lit(n)
    picked = ok.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= size).drop("_k")
    return picked.withColumns({"weight": F.lit(1.0) / size, "strategy_id": F.concat(F.lit("random:"), F.col("trial"))})


def random_summary(curves: DataFrame, name: str = "bench:random") -> DataFrame:
    """Mean and deviation of the trial curves per date."""
    return curves.groupBy("as_of").agg(F.avg("nav").alias("nav"), F.stddev_samp("nav").alias("std")).withColumn(
        "strategy_id", F.lit(name)
    )


def perfect_foresight(priced: DataFrame, n: int, name: str = "bench:foresight") -> DataFrame:
    """The n best by growth to the next date; all cash when fewer than n are known."""
    w = Window.partitionBy("as_of")
    known = priced.withColumn("_n", F.count("growth").over(w))
    s = known.withColumns({
        "strategy_id": F.lit(name), "score": F.when(F.col("_n") >= n, F.col("growth")),
    }).drop("_n")
    return construction.top_n_equal_weight(s, n, ["strategy_id", "as_of"], carry=("price", "growth"))


def foresight_like(priced: DataFrame, name: str = "bench:foresight") -> DataFrame:
    """``perfect_foresight`` for sizes in rows: the best ``n_selected`` by growth, all cash when fewer are known."""
    day = Window.partitionBy("as_of")
    order = day.orderBy(F.col("growth").desc_nulls_last(), "ticker")
    s = priced.withColumns({"_k": F.row_number().over(order), "_n": F.count("growth").over(day)})
    enough = F.col("_n") >= F.col("n_selected")
    kept = s.filter((enough & (F.col("_k") <= F.col("n_selected"))) | (~enough & (F.col("_k") == 1)))
    return kept.select(
        F.lit(name).alias("strategy_id"), "as_of", F.when(enough, F.col("ticker")).otherwise(CASH).alias("ticker"),
        F.when(enough, 1.0 / F.col("n_selected")).otherwise(1.0).alias("weight"), F.when(enough, F.col("growth")).alias("growth"))


def hold(priced: DataFrame, ticker: str, name: str) -> DataFrame:
    p = priced.filter(F.col("ticker") == ticker).withColumn("strategy_id", F.lit(name))
    return accounting.buy_and_hold(p).select("strategy_id", "as_of", "nav", "returns", "cost")


def value(weights: DataFrame, calendar: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Cost-free value curve."""
    c = accounting.periodic_value(weights, calendar, cost_bps=0.0, capital=capital)
    return c.select("strategy_id", "as_of", "nav", "returns", "cost")

"""Statistics of every pair of series (correlation, covariance, tests) as a blocked matrix product.

Series are hashed into blocks. A row is copied once per block, not once per partner, and each task gets
one pair of blocks for one stretch of time: at most (series per block) x (days per chunk) cells on either
side. It multiplies the two dense matrices and emits partial moments, which a grouped sum completes. The
output is every pair by definition; the shuffle stays at rows x blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelwise.functions.exprs import ratio

# Series in a block: two blocks and a year of days are some 4 MB of doubles.
BLOCK_SERIES = 1000
MOMENTS = ["n", "s_i", "s_j", "q_i", "q_j", "p"]


def pair_moments(
    rows: DataFrame, series: str, value: str, keys: Sequence[str] = (), weight: str | None = None, block_series: int = BLOCK_SERIES,
    include_self: bool = False, by_year: bool = True, pairs: DataFrame | None = None, counted: DataFrame | None = None,
) -> DataFrame:
    """(keys, i, j, n, s_i, s_j, q_i, q_j, p), i < j (or i <= j), over dates where both have a value.

    With a weight column every sum is weighted, n included. The number of blocks follows from the number of series,
    counted in the same plan, so that a block holds about ``block_series`` of them. ``by_year`` bounds the days of a
    task; rows that are already cut to short windows can do without. ``pairs`` (i, j), i before j, keeps only these. ``counted``
    stands in for ``rows`` where the series are counted, if ``rows`` repeats each of them for many windows.
    """
    keys = list(keys)
    # One row: at least two blocks, so that few series still give several tasks.
    size = (rows if counted is None else counted).filter(F.col(value).isNotNull()).agg(
        F.greatest(F.lit(2), F.ceil(F.approx_count_distinct(series) / F.lit(float(block_series)))).cast("int").alias("n_blocks"))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = rows.filter(F.col(value).isNotNull()).select(
        *keys, F.col(series).alias("s"), F.unix_date("date").alias("d"), (F.year("date") if by_year else F.lit(0)).alias("chunk"),
        F.col(value).cast("double").alias("v"), w.alias("w"),
    ).crossJoin(F.broadcast(size)).withColumn("b", F.pmod(F.xxhash64("s"), F.col("n_blocks")).cast("int"))
    # Block b meets every block k; the pair is stored once as (low, high).
    spread = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).withColumns(
        {"bi": F.least("b", "k"), "bj": F.greatest("b", "k")}
    ).drop("k", "n_blocks")
    fields = rows.select(*keys).schema.fields if keys else []
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["i string", "j string"] + [f"{m} double" for m in MOMENTS]
    )

    def side(pdf: pd.DataFrame, block_id: int, days: np.ndarray):
        part = pdf[pdf["b"] == block_id]
        names, col = np.unique(part["s"].to_numpy(), return_inverse=True)
        row = np.searchsorted(days, part["d"].to_numpy())
        x = np.zeros((len(days), len(names)))
        m = np.zeros_like(x)
        x[row, col] = part["v"].to_numpy()
        m[row, col] = 1.0
        return names, x, m

    def multiply(key, pdf: pd.DataFrame) -> pd.DataFrame:
        lead, bi, bj = key[: len(keys)], key[len(keys)], key[len(keys) + 1]
        days, first = np.unique(pdf["d"].to_numpy(), return_index=True)
        wt = pdf["w"].to_numpy()[first][:, None]
        a, x, mx = side(pdf, bi, days)
        b, y, my = (a, x, mx) if bi == bj else side(pdf, bj, days)
        mats = [(mx * wt).T @ my, (x * wt).T @ my, (mx * wt).T @ y, (x * x * wt).T @ my, (mx * wt).T @ (y * y), (x * wt).T @ y]
        i, j = np.nonzero(mats[0] > 0)
        out = pd.DataFrame({"i": a[i], "j": b[j], **{name: mat[i, j] for name, mat in zip(MOMENTS, mats)}})
        if bi == bj:
            out = out[out["i"] <= out["j"]] if include_self else out[out["i"] < out["j"]]
        else:
            swap = (out["i"] > out["j"]).to_numpy()
            flipped = out[swap].rename(columns={"i": "j", "j": "i", "s_i": "s_j", "s_j": "s_i", "q_i": "q_j", "q_j": "q_i"})
            out = pd.concat([out[~swap], flipped[out.columns]])
        for f, v in zip(fields, lead):
            out.insert(0, f.name, v)
        return out[[*keys, "i", "j", *MOMENTS]]

    parts = spread.groupBy(*keys, "bi", "bj", "chunk").applyInPandas(multiply, schema)
    if pairs is not None:
        parts = parts.join(pairs.select("i", "j").distinct(), ["i", "j"], "left_semi")
    return parts.groupBy(*keys, "i", "j").agg(*[F.sum(m).alias(m) for m in MOMENTS])


def _cross(a: str, x: str, y: str):
    return F.col(a) - ratio(F.col(x) * F.col(y), "n")


def correlation(moments: DataFrame) -> DataFrame:
    """Add ``corr``; NULL when a side has no variance or fewer than two common dates."""
    vi, vj = _cross("q_i", "s_i", "s_i"), _cross("q_j", "s_j", "s_j")
    ok = (F.col("n") >= 2) & (vi > 0) & (vj > 0)
    return moments.withColumn("corr", F.when(ok, ratio(_cross("p", "s_i", "s_j"), F.sqrt(vi * vj))))


def ewma_covariance(
    returns: DataFrame, days, halflife: float = 60.0, lookback: int = 252, block_series: int = BLOCK_SERIES
) -> DataFrame:
    """(as_of, i, j, cov) over the last ``lookback`` business days up to each decision date, both ends included.

    A missing return counts 0; the weight of a day depends on its age among the days that have any return.
    """
    from panelwise.functions.dates import bday_index, schedule_table

    spark = returns.sparkSession
    r = returns.filter(F.col("r").isNotNull())
    # Decision dates per day: each date looks back a fixed span, so a day falls in at most `lookback` of them.
    cal = schedule_table(spark, days).select("as_of", F.explode(
        F.sequence(F.date_sub("as_of", lookback * 2), F.col("as_of"))).alias("date"))
    cal = cal.filter(bday_index("date") >= bday_index("as_of") - lookback)
    live = r.select("date").distinct().join(cal, "date")
    from pyspark.sql import Window

    age = F.row_number().over(Window.partitionBy("as_of").orderBy(F.col("date").desc())) - 1
    lam = 0.5 ** (1.0 / halflife)
    raw = live.withColumn("raw", F.pow(F.lit(lam), age))
    w = raw.withColumn("w", ratio("raw", F.sum("raw").over(Window.partitionBy("as_of")))).select("as_of", "date", "w")
    x = r.join(w, "date").select("as_of", "date", "ticker", "r", "w")
    mean = x.groupBy("as_of", "ticker").agg(F.sum(F.col("w") * F.col("r")).alias("mu"))
    p = pair_moments(x, "ticker", "r", ["as_of"], "w", block_series, include_self=True, by_year=False, counted=r)
    mi = mean.select("as_of", F.col("ticker").alias("i"), F.col("mu").alias("mu_i"))
    mj = mean.select("as_of", F.col("ticker").alias("j"), F.col("mu").alias("mu_j"))
    return p.join(mi, ["as_of", "i"]).join(mj, ["as_of", "j"]).select(
        "as_of", "i", "j", (F.col("p") - F.col("mu_i") * F.col("mu_j")).alias("cov")
    )

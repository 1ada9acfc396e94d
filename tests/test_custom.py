"""Registered callables: schema check, windows of the pandas form."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwise.operators import custom

D = dt.date


def test_results_are_held_to_the_schema(spark):
    custom.register("check", "t_short")(lambda bars: bars.select("ticker", "date"))
    custom.register("check", "t_type")(lambda bars: bars.select("ticker", F.lit("x").alias("date"), F.lit("y").alias("issue")))
    custom.register("check", "t_more")(lambda bars: bars.select("*", F.lit("y").alias("issue")))
    bars = spark.createDataFrame([("a", D(2020, 1, 2), 1.0)], "ticker string, date date, close double")
    with pytest.raises(TypeError, match="issue string, found none"):
        custom.apply("check", "t_short", bars)
    with pytest.raises(TypeError, match="date date, found string"):
        custom.apply("check", "t_type", bars)
    assert custom.apply("check", "t_more", bars).columns == ["ticker", "date", "issue"]


def test_names_are_unique_and_known(spark):
    custom.register("cost", "t_once")(lambda p: p)
    with pytest.raises(ValueError):
        custom.register("cost", "t_once")(lambda p: p)
    with pytest.raises(ValueError):
        custom.register("report", "t_once")
    with pytest.raises(KeyError):
        custom.apply("signal", "t_nobody")


def test_per_window_sees_the_past_only(spark):
    rows = spark.createDataFrame(
        [("a", D(2020, 1, d), float(d)) for d in (3, 1, 10, 2)] + [("b", D(2020, 1, 1), None), ("c", D(2020, 1, 1), 1.0)], "ticker string, date date, v double")
    marks = spark.createDataFrame(
        [("a", D(2020, 1, 1)), ("a", D(2020, 1, 3)), ("a", D(2020, 1, 10)), ("b", D(2020, 1, 5)), ("d", D(2020, 1, 5))], "ticker string, as_of date")
    out = custom.per_window(rows, marks, 8, lambda w: w["v"].sum(min_count=1) * 100 + len(w))
    got = {(r.ticker, r.as_of.day): r.score for r in out.collect()}
    assert got == {("a", 1): None, ("a", 3): 302.0, ("a", 10): 502.0, ("b", 5): None, ("d", 5): None}


def test_per_window_of_nothing(spark):
    rows = spark.createDataFrame([], "ticker string, date date, v double")
    marks = spark.createDataFrame([], "ticker string, as_of date")
    assert custom.per_window(rows, marks, 8, len).count() == 0

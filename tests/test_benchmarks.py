"""Benchmarks that take their size from a strategy."""

import datetime as dt

import pytest

from panelwise import CASH
from panelwise.operators import benchmarks as B

A, Z = dt.date(2020, 1, 31), dt.date(2020, 2, 28)


@pytest.fixture
def priced(spark):
    rows = [(t, A, 10.0, g) for t, g in (("a", 1.1), ("b", 1.3), ("c", 1.3), ("d", 0.9), ("e", None))]
    return spark.createDataFrame(rows + [("a", Z, 11.0, 1.0)], "ticker string, as_of date, price double, growth double")


@pytest.mark.parametrize("held,size", [([(A, "a"), (A, "b"), (Z, "a"), (Z, CASH)], 2), ([(A, CASH)], 1), ([(A, x) for x in "abc"] + [(Z, "a")], 2)])
def test_size_is_the_mean_number_of_positions(spark, priced, held, size):
    """1.5 rounds to the even 2, a strategy in cash counts as 1."""
    w = spark.createDataFrame([(d, t, 0.5) for d, t in held], "as_of date, ticker string, weight double")
    assert {r.n_selected for r in B.like_strategy(priced, w).collect()} == {size}


def test_foresight_and_draws_of_that_size(spark, priced):
    w = spark.createDataFrame([(A, "a", 0.5), (A, "b", 0.5)], "as_of date, ticker string, weight double")
    like = B.like_strategy(priced, w)
    got = {(r.as_of, r.ticker): (r.weight, r.growth) for r in B.foresight_like(like).collect()}
    assert got == {(A, "b"): (0.5, 1.3), (A, "c"): (0.5, 1.3), (Z, CASH): (1.0, None)}
    drawn = B.random_selection(like, "n_selected", 3).groupBy("trial", "as_of").count().collect()
    assert {(r.trial, r.as_of): r["count"] for r in drawn} == {(t, d): n for t in range(3) for d, n in ((A, 2), (Z, 1))}
    same = {(r.trial, r.as_of, r.ticker) for r in B.random_selection(priced, 2, 3).collect()}
    assert same == {(r.trial, r.as_of, r.ticker) for r in B.random_selection(like, "n_selected", 3).collect()}

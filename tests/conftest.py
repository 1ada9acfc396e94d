import os
import sys

import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def frame(spark, pdf, schema=None):
    return spark.createDataFrame(pdf, schema=schema)


BARS = "date date, ticker string, open double, high double, low double, close double, volume double"


def bars(spark, closes: dict, start="2023-01-01", freq="D"):
    """closes: ticker -> list of prices on consecutive days."""
    rows = []
    for t, px in closes.items():
        for d, p in zip(pd.date_range(start, periods=len(px), freq=freq), px):
            if p is not None:
                rows.append((d.date(), t, float(p), float(p) + 0.5, float(p) - 0.5, float(p), 1e6))
    return spark.createDataFrame(rows, BARS)


@pytest.fixture(scope="session")
def ramp(spark):
    """Close 100 + i on day i of 2023, three tickers: any visible price tells its date."""
    return bars(spark, {t: [100 + i for i in range(300)] for t in ("A", "B", "C")}).cache()


def days_array(*days):
    from pyspark.sql import functions as F

    return F.array(*[F.lit(d).cast("date") for d in days])


def members(spark, *tickers):
    return spark.createDataFrame([(t,) for t in tickers], "ticker string")

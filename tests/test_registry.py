import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from panelwise.plans import catalog

# Queries that plain SQL cannot restate; each is checked against brute force in the other tests.
NO_SQL: set[str] = set()


def test_every_query_has_its_check():
    q, s = entry.queries(), entry.oracle_sql()
    q = {k: v for k, v in q.items() if k in catalog.QUERIES}
    s = {k: v for k, v in s.items() if k in catalog.QUERIES}
    assert set(s) <= set(q) and set(q) - set(s) == NO_SQL
    assert len(q) > 150


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 1 and "sharpe_ratio" in df.columns


@pytest.mark.parametrize("name", ["momentum_scores", "momentum_backtest", "production_run", "regime_label_history", "quality_issues", "cycle_summary"])
def test_sample_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "events", "customer", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(map(str, (tuple(r[c] for c in names) for r in df.collect())))
    assert got == sorted(map(str, rel.fetchall()))

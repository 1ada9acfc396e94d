"""SQL text of the check queries: shared common table expressions, picked by name with their inputs."""

from __future__ import annotations

from panelwise.operators.schedule_defaults import END, START
from panelwise.sources.panel import MACRO_FROM_PRIORITY


def bnum(d: str) -> str:
    k = f"date_diff('day', DATE '1970-01-05', {d})"
    return f"(CAST(floor({k} / 7.0) AS BIGINT) * 5 + least({k} % 7, 5))"


def sig(x: str, digits: int = 8) -> str:
    return f"CAST(printf('%.{digits - 1}e', {x}) AS DOUBLE)"


def div(a: str, b: str) -> str:
    return f"(({a}) / NULLIF({b}, 0))"


_DAYS = f"SELECT CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY)) AS DATE) AS d"
_BME = "d = last_day(d) - CAST(greatest(isodow(last_day(d)) - 5, 0) AS INTEGER)"


def _calendar(pred: str) -> str:
    return (
        "SELECT d AS as_of, row_number() OVER (ORDER BY d) - 1 AS seq, lag(d) OVER (ORDER BY d) AS prev_as_of, "
        f"lead(d) OVER (ORDER BY d) AS next_as_of FROM days WHERE {pred}"
    )


# name -> (needs, text)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "days": ((), _DAYS),
    "rebal": (("days",), _calendar(_BME)),
    "rebal_w": (("days",), _calendar("isodow(d) = 5")),
    "rebal_me": (("days",), _calendar("d = last_day(d)")),
    "rebal_qe": (("days",), _calendar("d = last_day(d) AND month(d) % 3 = 0")),
    "bars": (
        (),
        "SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, "
        "arg_min(u, {'a': l_orderkey, 'b': l_linenumber, 'c': u}) AS open, max(u) AS high, min(u) AS low, "
        "avg(u) AS close, sum(l_quantity) AS volume FROM (SELECT *, l_extendedprice / l_quantity AS u FROM lineitem "
        "WHERE isodow(l_shipdate) < 6) JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    ),
    "members": ((), "SELECT DISTINCT p_brand AS ticker FROM part"),
    "macro_w": (
        (),
        "SELECT CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) / avg(count(*)) OVER () * 25.0 AS VIX, "
        "avg(o_totalprice) / 250000.0 - 1.0 AS T10Y2Y, "
        + ", ".join(
            f"avg(CASE WHEN o_orderpriority = '{p}' THEN o_totalprice END) / 100000.0 AS {k}"
            for k, p in MACRO_FROM_PRIORITY.items()
        )
        + ", max(o_totalprice) / 1000.0 AS CPI, avg(CASE WHEN o_orderstatus = 'F' THEN 10.0 ELSE 0.0 END) AS UNRATE "
        "FROM orders GROUP BY 1",
    ),
    "macro": (
        ("macro_w",),
        "SELECT date, 'VIX' AS indicator, VIX AS value FROM macro_w UNION ALL "
        + " UNION ALL ".join(
            f"SELECT date, '{k}', CAST({k} AS DOUBLE) FROM macro_w WHERE {k} IS NOT NULL"
            for k in ["T10Y2Y", *MACRO_FROM_PRIORITY, "CPI", "UNRATE"]
        ),
    ),
    "reference": (
        (),
        "SELECT upper(p_brand) AS ticker, p_brand AS name, p_type AS sector, 'Unknown' AS exchange, 'USD' AS currency "
        "FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS k "
        "FROM part GROUP BY 1, 2) WHERE k = 1",
    ),
    "rets": (
        ("bars",),
        "SELECT date, ticker, close, lag(date) OVER (PARTITION BY ticker ORDER BY date) AS prev_date, "
        "close / NULLIF(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r FROM bars",
    ),
    "bench": (("rets",), "SELECT date, close, r FROM rets WHERE ticker = 'Brand#1' AND r IS NOT NULL"),
    "macro_at": (
        ("macro_w", "rebal"),
        "SELECT r.as_of, " + ", ".join(
            f"(SELECT arg_max(m.{k}, m.date) FROM macro_w m WHERE m.date <= r.as_of AND m.{k} IS NOT NULL) AS {k}"
            for k in ["VIX", "T10Y2Y", *MACRO_FROM_PRIORITY, "CPI", "UNRATE"]
        ) + " FROM rebal r",
    ),
    # Last close before each decision date.
    "px": (
        ("bars", "members", "rebal"),
        "SELECT m.ticker, r.as_of, b.close AS price, b.date AS seen FROM members m CROSS JOIN rebal r "
        "ASOF LEFT JOIN bars b ON m.ticker = b.ticker AND r.as_of > b.date",
    ),
}


def with_ctes(names: str, body: str, **extra: str) -> str:
    """``names``: space-separated CTEs; inputs come along. ``extra`` adds query-specific ones, in order."""
    order: list[str] = []

    def add(n: str) -> None:
        for need in CTES[n][0]:
            add(need)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"{k} AS ({v})" for k, v in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body

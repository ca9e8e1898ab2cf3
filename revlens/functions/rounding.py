"""Exact half-away-from-zero rounding of ratios of integers.

``round(avg(x), 2)`` on doubles depends on how the engine rounds binary
fractions; the study's figures are averages and percentages of integer
counts, so they are computed exactly instead:

    round(scale * num / den, k) = sign(num) * ((2*scale*10^k*|num| + den) div (2*den)) / 10^k

with ``num``/``den`` the integer aggregates.  The text is plain SQL so the
same definition is used from the DataFrame API (``F.expr``) and in the
DuckDB oracle.  In Spark the integer division is written as
``(a - pmod(a, b)) / b`` on DECIMAL(38,0): the division is exact and stays
decimal (``div`` would cast to BIGINT, which wraps for huge quotients);
DuckDB's ``//`` on HUGEINT is exact already.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int_div(a: str, b: str, engine: str) -> str:
    """Floor division of non-negative integers, exactly."""
    if engine == "spark":
        return f"((({a}) - pmod({a}, {b})) / ({b}))"
    return f"(({a}) // ({b}))"


def units_sql(num: str, den: str, k: int, scale: int = 1, engine: str = "spark") -> str:
    """round(scale * num / den, k) as a signed count of 10^-k units."""
    p = scale * 10 ** k
    big = "DECIMAL(38,0)" if engine == "spark" else "HUGEINT"
    d = f"CAST(nullif({den}, 0) AS {big})"
    q = _int_div(f"2 * {p} * abs(CAST({num} AS {big})) + {d}", f"2 * {d}", engine)
    return f"((CASE WHEN ({num}) < 0 THEN -1 ELSE 1 END) * {q})"


def ratio_sql(num: str, den: str, k: int, scale: int = 1, engine: str = "spark") -> str:
    return f"(CAST({units_sql(num, den, k, scale, engine)} AS DOUBLE) / {10 ** k})"


def round_ratio(num: str, den: str, k: int, scale: int = 1) -> Column:
    """Column for ``round(scale * num / den, k)``; NULL when den is 0/NULL."""
    return F.expr(ratio_sql(num, den, k, scale))


def round_units(num: str, den: str, k: int, scale: int = 1) -> Column:
    return F.expr(units_sql(num, den, k, scale)).cast("long")


def units_to_double(units: Column, k: int) -> Column:
    return units.cast("double") / (10 ** k)

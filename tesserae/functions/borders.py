"""What an index outside an image stands for, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("constant", "valid", "edge", "wrap", "symmetric", "reflect")


def fit(i: Column, n: Column, mode: str) -> Column:
    """Index within 0..n-1 that stands for i; in modes constant and valid i itself."""
    if mode == "edge":
        return F.greatest(F.lit(0), F.least(i, n - 1))
    if mode == "wrap":
        return F.pmod(i, n)
    if mode == "symmetric":
        m = F.pmod(i, 2 * n)
        return F.when(m < n, m).otherwise(2 * n - 1 - m)
    if mode == "reflect":
        period = F.greatest(F.lit(1), 2 * n - 2)
        m = F.pmod(i, period)
        return F.when(m < n, m).otherwise(period - m)
    if mode in ("constant", "valid"):
        return i
    raise ValueError(f"mode must be one of {', '.join(MODES)}")


def fit_sql(i: str, n: str, mode: str) -> str:
    def mod(period: str) -> str:
        return f"((({i}) % ({period}) + ({period})) % ({period}))"

    if mode == "edge":
        return f"greatest(0, least({i}, {n} - 1))"
    if mode == "wrap":
        return mod(n)
    if mode == "symmetric":
        return f"least({mod(f'2 * {n}')}, 2 * {n} - 1 - {mod(f'2 * {n}')})"
    if mode == "reflect":
        return f"least({mod(f'2 * {n} - 2')}, 2 * {n} - 2 - {mod(f'2 * {n} - 2')})"
    return i

"""Small column helpers used by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def by_symbol():
    """A symbol's bars in order."""
    return W.partitionBy("symbol").orderBy("i")


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r(x: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison across engines; no negative zero."""
    return F.round(c(x), digits) + F.lit(0.0)


def scaled(x: str | Column, digits: int) -> Column:
    """Rounded as SQL engines round doubles: the product with 10^digits to a whole number, halves away from zero; no negative zero.

    ``r`` rounds the shortest decimal of a double, which differs where that lies a rounding error beside a half.
    """
    return F.round(c(x) * 10.0**digits) / 10.0**digits + F.lit(0.0)


def rows(before: int | None, after: int = 0):
    """The window of a symbol's bars from ``before`` bars back (None: all) to ``after`` bars on."""
    return by_symbol().rowsBetween(W.unboundedPreceding if before is None else -before, after)


def clamp(x: str | Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c(x), F.lit(low)), F.lit(high))


def log_ratio(a: str | Column, b: str | Column) -> Column:
    """Logarithm of a / b where zeros have the limits of IEEE arithmetic: -inf for 0 / b, inf for a / 0, NaN for 0 / 0."""
    inf, missing = float("inf"), c(a).isNull() | c(b).isNull()
    ends = F.when(missing, None).when(c(b) == 0, F.when(c(a) == 0, float("nan")).otherwise(inf)).when(c(a) == 0, -inf)
    return ends.otherwise(F.ln(c(a) / c(b)))


def ratio(a: str | Column, b: str | Column, default: float = 0.0) -> Column:
    return F.when(c(b) != 0, c(a) / c(b)).otherwise(F.lit(default))


def exact_mean(x: str | Column) -> Column:
    """The double next to the exact mean of values of up to twelve decimals, the same in any order of rows.

    Groups with values that are not finite or too large for it are averaged as doubles.
    """
    exact, n = c(x).try_cast("decimal(28,12)"), F.count(x)
    total = F.when(n == F.count(exact), F.try_sum(exact)).try_cast("decimal(27,12)")
    # 27 digits by 10 leave the quotient 23 decimals
    return F.coalesce((total / F.nullif(n, F.lit(0)).try_cast("decimal(10,0)")).cast("double"), F.avg(x))

"""Null-safe numeric expressions.

Missing is always NULL: under ANSI Spark a division by zero raises and NaN
sorts above every number, so NaN and infinities are turned into NULL early.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c: str | Column) -> Column:
    """Numeric coercion: text that is not a number, NaN and infinities become NULL."""
    return finite(col(c).try_cast("double"))


def finite(c: str | Column) -> Column:
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(INF)), c)


def finite_frame(df: DataFrame) -> DataFrame:
    """Infinities and NaN to NULL over every floating column."""
    floating = {
        f.name: finite(f.name)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floating) if floating else df


def safe_div(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a), col(b))


def ratio_change(now: Column, before: Column) -> Column:
    return F.try_divide(now, before) - F.lit(1.0)


def ln_positive(c: str | Column) -> Column:
    """Natural log, NULL outside its domain."""
    c = col(c)
    return F.when(c > 0, F.ln(c))


def log1p_safe(c: str | Column) -> Column:
    c = col(c)
    return F.when(c > -1, F.log1p(c))


def both(a: str | Column, b: str | Column, value: Column) -> Column:
    """``value`` only where both inputs are known (greatest/least skip NULLs)."""
    return F.when(col(a).isNotNull() & col(b).isNotNull(), value)


def larger(a: str | Column, b: str | Column) -> Column:
    return both(a, b, F.greatest(col(a), col(b)))


def smaller(a: str | Column, b: str | Column) -> Column:
    return both(a, b, F.least(col(a), col(b)))


def clip_low(c: str | Column, low: float) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def clip_high(c: str | Column, high: float) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.least(c, F.lit(high)))


def weekday_cycle(date: str | Column) -> tuple[Column, Column]:
    """Sine and cosine of the weekday, Monday = 0."""
    angle = F.lit(2.0 * math.pi) * F.weekday(col(date)) / F.lit(7.0)
    return F.sin(angle), F.cos(angle)


def branch(upper: Column, lower: Column) -> Column:
    """1 / -1 / 0; an unknown condition falls through to 0."""
    return F.when(upper, F.lit(1)).when(lower, F.lit(-1)).otherwise(F.lit(0))


def flag(cond: Column) -> Column:
    """0/1 where an unknown condition counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def digamma(value: str | Column) -> Column:
    """Derivative of the log-gamma function for positive numbers: recurrence up by six, then the asymptotic series."""
    x = col(value).cast("double")
    y = x + F.lit(6.0)
    below = F.lit(0.0)
    for i in range(6):
        below += F.lit(1.0) / (x + F.lit(float(i)))
    square = F.lit(1.0) / (y * y)
    series = square * (F.lit(1 / 12) - square * (F.lit(1 / 120) - square * (F.lit(1 / 252) - square * F.lit(1 / 240))))
    return F.ln(y) - F.lit(0.5) / y - series - below

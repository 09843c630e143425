"""Scalar and window expressions: safe ratios, gated windows and the Student-t p-value."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.try_divide(a, b)


def by(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(spec: WindowSpec, rows: int) -> WindowSpec:
    """The current row and the ``rows`` - 1 before it."""
    return spec.rowsBetween(-(rows - 1), 0)


def full(value: Column, over: Column, spec: WindowSpec, rows: int) -> Column:
    """``value`` over the last ``rows`` rows, null unless ``over`` has a value in each of them."""
    frame = trailing(spec, rows)
    return F.when(F.count(over).over(frame) == rows, value.over(frame))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t for whole degrees of freedom, as a finite trigonometric series.

    With theta = atan(|t| / sqrt(df)) the distribution function is a sum of powers of cos(theta);
    the sum is folded inside one expression, so no Python is involved. Null in, null out.
    """
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    even = (df % 2) == 0
    terms = F.when(even, df / 2 - 1).otherwise((df - 3) / 2).cast("int")
    c2 = F.pow(F.cos(theta), 2)
    start = F.when(even, F.lit(1.0)).otherwise(F.cos(theta))
    zero = F.struct(start.alias("term"), F.when(terms >= 0, start).otherwise(F.lit(0.0)).alias("total"))

    def step(acc: Column, k: Column) -> Column:
        factor = F.when(even, (2 * k - 1) / (2 * k)).otherwise((2 * k) / (2 * k + 1))
        term = acc["term"] * factor * c2
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, zero, step, lambda acc: acc["total"])
    inside = F.when(even, F.sin(theta) * total).otherwise((theta + F.when(df > 1, F.sin(theta) * total).otherwise(F.lit(0.0))) * (2 / math.pi))
    return F.when(t.isNotNull() & (df >= 1), F.greatest(F.lit(1.0) - inside, F.lit(0.0)))

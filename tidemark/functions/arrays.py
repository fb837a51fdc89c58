"""Column expressions over arrays of numbers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Columns of an earlier ``withColumn`` are put back into the expressions that use
    them when Spark moves a filter down, inside lambdas even once per element. A
    bound variable cannot be expanded like that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quantile_of_sorted(items: Column, p: float, how: str = "linear") -> Column:
    """Quantile ``p`` of an ascending array; null when it is empty.

    ``linear`` interpolates between the two neighbouring ranks, ``midpoint``
    takes their mean whatever the distance.
    """
    spot = (F.size(items) - 1) * F.lit(float(p))
    low = F.get(items, F.floor(spot).cast("int"))
    high = F.get(items, F.ceil(spot).cast("int"))
    if how == "midpoint":
        return (low + high) / 2
    if how != "linear":
        raise ValueError(f"unknown interpolation {how!r}")
    return low + (high - low) * (spot - F.floor(spot))


def median_of_sorted(items: Column) -> Column:
    n = F.size(items)
    low = F.get(items, F.floor((n - 1) / 2).cast("int"))
    high = F.get(items, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two equally long arrays."""
    gaps = F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v)


def fold_steps(start: Column, steps: int, advance: Callable[[Column], Column]) -> Column:
    """``advance`` applied ``steps`` times, all intermediate values as an array."""
    empty = F.array(start.cast("double"))
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        empty,
        lambda acc, _: F.concat(acc, F.array(advance(F.element_at(acc, -1)))),
    )
    return F.slice(grown, 2, steps)


def cyclic(ts_seconds: Column, period: float) -> tuple[Column, Column]:
    angle = ts_seconds * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)

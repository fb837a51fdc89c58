"""Long integer ranges as rows, without long arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 12  # of a number that one level resolves: no array holds more than 2**BITS elements
MOST = 1 << 3 * BITS  # longest range


def with_range(df: DataFrame, n: Column, out: str, spread: bool = False) -> DataFrame:
    """A row for each number 0 .. n-1 of each row of ``df``; no row where ``n`` is null or below 1.

    The range is cut into cells, and these into smaller ones, by three generators in a row, each over a
    bounded array. With ``spread`` the cells are dealt out over the partitions before their numbers are
    made, so that one long range does not stay in the task of its row. ``n`` is at most 2**36.
    """
    low, mid = F.lit(1 << BITS), F.lit(1 << 2 * BITS)
    helpers = ["_range_last", "_range_high", "_range_mid"]
    rows = df.withColumn(helpers[0], n.cast("long") - 1).filter(F.col(helpers[0]) >= 0)
    last, high, middle = (F.col(c) for c in helpers)

    def upto(most: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), most))

    full = F.lit((1 << BITS) - 1).cast("long")
    rows = rows.withColumn(helpers[1], upto(F.floor(last / mid)))
    rows = rows.withColumn(helpers[2], upto(F.least(full, F.floor((last - high * mid) / low))))
    if spread:
        rows = rows.repartition(F.xxhash64(*[c for c in rows.columns]))
    start = high * mid + middle * low
    numbers = rows.withColumn(out, upto(F.least(full, last - start)))
    return numbers.withColumn(out, F.col(out) + start).drop(*helpers)

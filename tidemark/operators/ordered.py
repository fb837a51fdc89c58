"""Sorting, limits and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import Order, numbered


def oldest_first(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """Global sort by series and time; a newest-first file becomes oldest first."""
    return df.orderBy(*keys, *order)


def first_rows(df: DataFrame, order: Order, n: int) -> DataFrame:
    """The first ``n`` rows of a stated order (a top-n, not a full sort)."""
    return df.orderBy(*order).limit(n)


def top_frequent(df: DataFrame, column: str, k: int, count: str = "n") -> DataFrame:
    """The ``k`` most frequent values, ties in value order."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias(count))
    return counts.orderBy(F.desc(count), column).limit(k)


def chronological_split(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    cuts: Mapping[str, float],
    last: str,
    out: str = "split",
) -> DataFrame:
    """Label rows by their place in the series.

    ``cuts`` maps each label but the last to the cumulative share where it ends,
    e.g. ``{"train": .7, "val": .9}`` with ``last="test"``.
    """
    placed = numbered(df, keys, order, "_pos", "_len")
    label = None
    for name, share in cuts.items():
        inside = F.col("_pos") < F.floor(F.col("_len") * F.lit(float(share)))
        label = F.when(inside, name) if label is None else label.when(inside, name)
    return placed.withColumn(out, label.otherwise(last)).drop("_pos", "_len")


def hashed_split(
    df: DataFrame, id_column: str, share: float, seed: int, out: str = "split"
) -> DataFrame:
    """Seeded random split that depends on the row id only, so that it is repeatable.

    The draw is the first 32 bits of the MD5 of ``<id>:<seed>`` (a null id counts as empty text), which
    other engines can compute too.
    """
    named = F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(f":{seed}"))
    draw = F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("double")
    return df.withColumn(out, F.when(draw < float(share) * 2.0**32, "test").otherwise("train"))


def concat(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)

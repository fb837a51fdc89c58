"""Feature scaling with exact inverses.

Every mode is the affine map ``(x - center) / scale + low``; its statistics are a
small table of one row per series, so the inverse is a projection on the same row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import let, median_of_sorted, quantile_of_sorted
from tidemark.operators.ordering import Frames, Order, attach, exact_quantiles
from tidemark.operators.radix import table_quantiles

MODES = ("minmax", "robust", "standard")


def _nonzero(width: Column) -> Column:
    return F.when(width == 0, F.lit(1.0)).otherwise(width)


def fit(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    mode: str = "robust",
    where: Column | None = None,
    low: float = 0.0,
    high: float = 1.0,
) -> DataFrame:
    """Statistics per series, from the rows that satisfy ``where``."""
    if mode not in MODES:
        raise ValueError(f"unknown scaling mode {mode!r}")
    keys = list(keys)
    rows = df if where is None else df.filter(where)
    if mode == "robust" and not keys:
        stats = []
        for c, (a, m, b) in zip(columns, table_quantiles(rows, columns, [0.25, 0.5, 0.75]), strict=True):
            width = None if a is None else (b - a if b != a else 1.0)
            stats += [
                F.lit(m).cast("double").alias(f"{c}_center"), F.lit(width).cast("double").alias(f"{c}_scale"),
                F.lit(0.0).alias(f"{c}_low"),
            ]
        return df.sparkSession.range(1).select(*stats)
    if mode == "robust":
        long = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
            keys, list(columns), "_column", "_value"
        )
        by = [*keys, "_column"]
        q = exact_quantiles(long, by, "_value", [0.25, 0.5, 0.75], ["_a", "_m", "_b"])
        stats = []
        for c in columns:
            mine = F.col("_column") == c
            stats += [
                F.max(F.when(mine, F.col("_m"))).alias(f"{c}_center"),
                F.max(F.when(mine, _nonzero(F.col("_b") - F.col("_a")))).alias(f"{c}_scale"),
                F.max(F.when(mine, F.lit(0.0))).alias(f"{c}_low"),
            ]
        return q.groupBy(*keys).agg(*stats)
    stats = []
    for c in columns:
        if mode == "minmax":
            center, low_c = F.min(c), F.lit(float(low))
            width = _nonzero(F.max(c) - F.min(c)) / F.lit(float(high - low))
        else:
            center, low_c = F.avg(c), F.lit(0.0)
            width = _nonzero(F.stddev_samp(c))
        stats += [
            center.alias(f"{c}_center"), width.alias(f"{c}_scale"), low_c.alias(f"{c}_low")
        ]
    return rows.groupBy(*keys).agg(*stats)


def scaled(column: str, source: str | None = None) -> Column:
    name = source or column
    return (F.col(column) - F.col(f"{name}_center")) / F.col(f"{name}_scale") + F.col(
        f"{name}_low"
    )


def unscaled(column: str, source: str | None = None) -> Column:
    name = source or column
    return (F.col(column) - F.col(f"{name}_low")) * F.col(f"{name}_scale") + F.col(
        f"{name}_center"
    )


def transform(
    df: DataFrame, stats: DataFrame, keys: Sequence[str], columns: Sequence[str],
    suffix: str = "_scaled",
) -> DataFrame:
    """Add the scaled columns and keep the statistics, so that ``invert`` needs no join."""
    rows = attach(df, stats, list(keys))
    return rows.withColumns({f"{c}{suffix}": scaled(c) for c in columns})


def invert(df: DataFrame, forecasts: dict[str, str]) -> DataFrame:
    """Undo the scaling of ``forecasts`` (forecast column -> the column it stands for)."""
    return df.withColumns({name: unscaled(name, source) for name, source in forecasts.items()})


def drop_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*[f"{c}_{part}" for c in columns for part in ("center", "scale", "low")])


def scale(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    mode: str = "robust",
    fit_scope: str = "train",
    split: str = "split",
    suffix: str = "_scaled",
) -> DataFrame:
    """Fit and apply in one step.

    ``fit_scope="train"`` uses the training rows of each series for all its rows,
    ``"split"`` fits each part of the split on itself.
    """
    if fit_scope == "split":
        by = [*keys, split]
        return transform(df, fit(df, by, columns, mode), by, columns, suffix)
    if fit_scope != "train":
        raise ValueError(f"unknown fit scope {fit_scope!r}")
    stats = fit(df, keys, columns, mode, where=F.col(split) == "train")
    return transform(df, stats, keys, columns, suffix)


def scale_constant(df: DataFrame, column: str, factor: float, out: str) -> DataFrame:
    return df.withColumn(out, F.col(column) / F.lit(float(factor)))


def scale_in_window(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    value: str,
    width: int,
    mode: str = "minmax",
) -> DataFrame:
    """Scale each row by the statistics of the ``width`` rows that end with it.

    Adds ``<value>_center``, ``<value>_scale``, ``<value>_low`` and
    ``<value>_scaled``; all are null while the window is incomplete.
    """
    frames = Frames(df, keys, order, before=width - 1)
    window = frames.rows(1 - width, 0)
    full = F.count(F.lit(1)).over(window) == width
    if mode == "minmax":
        rows = frames.df.withColumns(
            {"_a": F.min(value).over(window), "_b": F.max(value).over(window), "_full": full}
        )
        rows = frames.finish(rows).withColumn("_m", F.col("_a"))
    elif mode == "robust":
        rows = frames.df.withColumns({"_items": F.collect_list(value).over(window), "_full": full})
        found = let(
            F.sort_array("_items"),
            lambda items: F.struct(
                quantile_of_sorted(items, 0.25).alias("a"),
                median_of_sorted(items).alias("m"),
                quantile_of_sorted(items, 0.75).alias("b"),
            ),
        )
        rows = frames.finish(rows).withColumn("_q", found)
        rows = rows.withColumns({f"_{c}": F.col(f"_q.{c}") for c in "amb"})
    else:
        raise ValueError(f"unknown window scaling mode {mode!r}")
    rows = rows.withColumns(
        {
            f"{value}_center": F.when(F.col("_full"), F.col("_m")),
            f"{value}_scale": F.when(F.col("_full"), _nonzero(F.col("_b") - F.col("_a"))),
            f"{value}_low": F.when(F.col("_full"), F.lit(0.0)),
        }
    )
    return rows.withColumn(f"{value}_scaled", scaled(value)).drop(
        "_a", "_m", "_b", "_full", "_items", "_q"
    )

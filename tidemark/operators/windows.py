"""Windows over ordered series, each row shuffled once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import let, quantile_of_sorted
from tidemark.operators import orderstat
from tidemark.operators.ordering import Frames, Order


def _item(columns: Sequence[str]) -> Column:
    """One feature gives plain values, several give structs."""
    return F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)


def supervised_windows(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    features: Sequence[str],
    targets: Sequence[str],
    x: int,
    y: int,
) -> DataFrame:
    """(inputs, labels) pairs for forecasting.

    One pair per position i = x, x + y, x + 2y, ... below n - y: ``inputs`` are the
    x rows before i, ``labels`` the y rows from i on. The last start n - y is left
    out.
    """
    if x < 1 or y < 1:
        raise ValueError("window sizes must be positive")
    frames = Frames(df, keys, order, before=x, after=y, position="start")
    rows = frames.df.withColumns(
        {
            "inputs": F.collect_list(_item(features)).over(frames.rows(-x, -1)),
            "labels": F.collect_list(_item(targets)).over(frames.rows(0, y - 1)),
            "_more": F.lead(F.lit(1), y).over(frames.order),
        }
    )
    rows = frames.finish(rows)
    keep = (F.col("start") >= x) & ((F.col("start") - x) % y == 0) & F.col("_more").isNotNull()
    return rows.filter(keep).select(*keys, "start", "inputs", "labels")


def general_windows(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    features: Sequence[str],
    labels: Sequence[str],
    input_width: int,
    label_width: int,
    shift: int,
) -> DataFrame:
    """Windows of ``input_width + shift`` rows with stride 1, no partial ones.

    ``inputs`` are the first ``input_width`` rows, ``labels`` the last
    ``label_width``.
    """
    total = input_width + shift
    frames = Frames(df, keys, order, after=total - 1, position="start")
    rows = frames.df.withColumns(
        {
            "inputs": F.collect_list(_item(features)).over(frames.rows(0, input_width - 1)),
            "labels": F.collect_list(_item(labels)).over(
                frames.rows(total - label_width, total - 1)
            ),
            "_full": F.count(F.lit(1)).over(frames.rows(0, total - 1)) == total,
        }
    )
    return frames.finish(rows).filter("_full").select(*keys, "start", "inputs", "labels")


def lookback_windows(
    df: DataFrame, keys: Sequence[str], order: Order, features: Sequence[str], n: int
) -> DataFrame:
    """The n rows from each position on, for the first len - n - 1 positions."""
    frames = Frames(df, keys, order, after=n + 1, position="start")
    rows = frames.df.withColumns(
        {
            "inputs": F.collect_list(_item(features)).over(frames.rows(0, n - 1)),
            "_more": F.lead(F.lit(1), n + 1).over(frames.order),
        }
    )
    return frames.finish(rows).filter("_more is not null").select(*keys, "start", "inputs")


def short_series(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Series with too few rows for a lookback of n, which yield no window."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return counts.filter(F.col("rows") - n - 1 <= 0)


def sliding_windows(
    df: DataFrame, keys: Sequence[str], order: Order, value: str, n: int
) -> DataFrame:
    """Every complete window of n consecutive rows."""
    if n < 1:
        raise ValueError("n must be positive")
    frames = Frames(df, keys, order, after=n - 1, position="start")
    window = frames.rows(0, n - 1)
    rows = frames.df.withColumns(
        {
            "items": F.collect_list(F.struct(value)).over(window),
            "_full": F.count(F.lit(1)).over(window) == n,
        }
    )
    items = F.transform("items", lambda v: v[value])
    return frames.finish(rows).filter("_full").select(*keys, "start", items.alias("items"))


def last_rows(
    df: DataFrame, keys: Sequence[str], order: Order, value: str, n: int, out: str = "recent"
) -> DataFrame:
    """Add the values of the last n rows up to and including each row."""
    frames = Frames(df, keys, order, before=n - 1)
    return frames.finish(
        frames.df.withColumn(out, F.collect_list(value).over(frames.rows(1 - n, 0)))
    )


def rolling_moments(
    df: DataFrame, keys: Sequence[str], order: Order, value: str, n: int = 12
) -> DataFrame:
    """Add ``rolling_mean`` and ``rolling_std`` of the last n rows, null if fewer."""
    frames = Frames(df, keys, order, before=n - 1)
    window = frames.rows(1 - n, 0)
    full = F.count(value).over(window) == n
    return frames.finish(
        frames.df.withColumns(
            {
                "rolling_mean": F.when(full, F.avg(value).over(window)),
                "rolling_std": F.when(full, F.stddev_samp(value).over(window)),
            }
        )
    )


def rolling_median_mad(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    value: str,
    w: int,
    closed: str = "left",
) -> DataFrame:
    """Add ``median`` and ``mad`` of the rows [i-w, i+w) around each row.

    The deviations are taken from the window's own median. ``closed="both"`` adds
    the row i+w. ``rows_in_window`` and ``rows_around`` (over [i-w, i+w]) tell how
    complete the window is; nulls (and NaN) are left out of the statistics and counted in
    ``nulls_in_window``.
    """
    if closed not in ("left", "both"):
        raise ValueError(f"unknown closed side {closed!r}")
    return orderstat.rolling_median_mad(df, keys, order, value, w, w if closed == "both" else w - 1, w)


def rolling_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    value: str,
    n: int = 20,
    percents: Sequence[int] = (25, 50, 99),
    short_tail: bool = True,
) -> DataFrame:
    """Add midpoint percentiles ``p25``... of the n rows from each row on.

    With ``short_tail`` the last windows are shorter. Without it the last n starts
    are left out.
    """
    frames = Frames(df, keys, order, after=n)
    rows = frames.df.withColumns(
        {
            "_items": F.collect_list(value).over(frames.rows(0, n - 1)),
            "_more": F.lead(F.lit(1), n).over(frames.order),
        }
    )
    rows = frames.finish(rows)
    if not short_tail:
        rows = rows.filter("_more is not null")
    found = let(
        F.sort_array("_items"),
        lambda items: F.struct(
            *[quantile_of_sorted(items, p / 100, "midpoint").alias(f"p{p}") for p in percents]
        ),
    )
    rows = rows.withColumn("_found", found)
    return rows.withColumns({f"p{p}": F.col(f"_found.p{p}") for p in percents}).drop(
        "_items", "_more", "_found"
    )


def difference(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    value: str,
    direction: str = "back",
    first: float | None = None,
    out: str = "diff",
) -> DataFrame:
    """Add the absolute gap to the row before (``back``) or after (``ahead``).

    Rows without that neighbour get ``first`` (null by default).
    """
    frames = Frames(df, keys, order, before=1, after=1)
    step = F.lag if direction == "back" else F.lead
    gap = F.abs(F.col(value) - step(value, 1).over(frames.order))
    return frames.finish(frames.df.withColumn(out, F.coalesce(gap, F.lit(first).cast("double"))))


def next_value_pairs(df: DataFrame, keys: Sequence[str], order: Order, value: str) -> DataFrame:
    """Rows (x, y) of each value and its successor."""
    frames = Frames(df, keys, order, after=1)
    rows = frames.df.withColumn("_y", F.struct(F.lead(value).over(frames.order).alias("v")))
    rows = rows.withColumn("_has", F.lead(F.lit(1)).over(frames.order))
    rows = frames.finish(rows).filter("_has is not null")
    return rows.withColumns({"x": F.col(value), "y": F.col("_y.v")}).drop("_y", "_has")


def next_step_time(df: DataFrame, ts: str, minutes: int = 3, out: str = "next_ts") -> DataFrame:
    return df.withColumn(out, F.col(ts) + F.expr(f"INTERVAL '{minutes}' MINUTE"))

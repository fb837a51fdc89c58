"""Anomaly rules and detection reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import Frames, Order
from tidemark.operators.windows import difference, rolling_median_mad, rolling_percentiles

# Fixed value: makes the median absolute deviation an estimate of sigma for normal data.
MAD_TO_SIGMA = 1.4826


def hampel(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    value: str,
    w: int,
    n_sigmas: float = 3.0,
    include_last: bool = False,
    skip_nulls: bool = False,
    closed: str = "left",
) -> DataFrame:
    """Hampel filter: add ``is_outlier`` and ``cleaned`` (outliers become the median).

    Rows closer than w to either end are never flagged. ``include_last`` evaluates
    one row more at the end (position n - w), as a rolling window does.
    ``skip_nulls`` takes the statistics over the values present; otherwise a window
    that holds a null flags nothing.
    """
    rows = rolling_median_mad(df, keys, order, value, w, closed)
    if include_last:
        complete = F.col("rows_in_window") == (2 * w + 1 if closed == "both" else 2 * w)
    else:
        complete = F.col("rows_around") == 2 * w + 1
    if not skip_nulls:
        complete = complete & (F.col("nulls_in_window") == 0)
    far = F.abs(F.col(value) - F.col("median")) > F.lit(float(n_sigmas)) * (
        F.lit(MAD_TO_SIGMA) * F.col("mad")
    )
    flag = F.coalesce(complete & far, F.lit(False))
    return (
        rows.withColumn("is_outlier", flag)
        .withColumn(
            "cleaned", F.when(F.col("is_outlier"), F.col("median")).otherwise(F.col(value))
        )
        .drop("median", "mad", "rows_in_window", "rows_around", "nulls_in_window")
    )


def gap_or_level(
    df: DataFrame, actual: str, predicted: str, gap: float = 30.0, level: float = 60.0
) -> DataFrame:
    """Rows whose forecast misses by ``gap`` or reaches ``level``, with the rule that fired."""
    missed = F.abs(F.col(actual) - F.col(predicted)) >= gap
    high = F.col(predicted) >= level
    rule = (
        F.when(missed & high, "gap+level").when(missed, "gap").when(high, "level")
    )
    return df.withColumn("rule", rule).filter("rule is not null")


def prediction_jump(
    df: DataFrame, keys: Sequence[str], order: Order, predicted: str, jump: float = 1.0
) -> DataFrame:
    """Rows whose forecast moved by at least ``jump`` since the row before."""
    return difference(df, keys, order, predicted, "back", out="jump").filter(
        F.col("jump") >= jump
    )


def neighbour_jump(
    df: DataFrame, keys: Sequence[str], order: Order, value: str, jump: float = 30.0
) -> DataFrame:
    """Rows whose successor differs by at least ``jump``."""
    return difference(df, keys, order, value, "ahead", out="jump").filter(F.col("jump") >= jump)


def peak_alert(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    ts: str,
    value: str,
    width: int = 60,
    level: float = 250.0,
) -> DataFrame:
    """One alert per window whose peak is new.

    The window is the last ``width`` rows (complete ones only). Its peak is the
    earliest row of the largest value. An alert needs a peak of at least ``level``
    at another time than the peak of the window before.
    """
    frames = Frames(df, keys, order, before=width, after=0)
    window = frames.rows(1 - width, 0)
    previous = frames.rows(-width, -1)

    def peak_time(frame) -> Column:
        # Rows arrive in time order, so the first of the equal maxima wins.
        found = F.max(F.struct(F.col(value), F.negative(F.unix_micros(F.col(ts).cast("timestamp")))
                               .alias("_t"), F.col(ts).alias("_at")))
        return found.over(frame)

    rows = frames.df.withColumns(
        {
            "_peak": peak_time(window),
            "_last": peak_time(previous),
            "_full": F.count(F.lit(1)).over(window) == width,
            "_had": F.count(F.lit(1)).over(previous) == width,
        }
    )
    rows = frames.finish(rows).filter("_full")
    fresh = ~F.col("_had") | (F.col("_peak._at") != F.col("_last._at"))
    high = F.col(f"_peak.{value}") >= level
    return rows.filter(high & fresh).select(
        *keys,
        F.col(ts).alias("window_end"),
        F.col("_peak._at").alias("peak_ts"),
        F.col(f"_peak.{value}").alias("peak_value"),
    )


def rolling_percentile_alert(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    value: str,
    n: int = 20,
    level: float = 30.0,
    short_tail: bool = True,
) -> DataFrame:
    """Rows from which the 99th (midpoint) percentile of the next n rows reaches ``level``."""
    rows = rolling_percentiles(df, keys, order, value, n, (25, 50, 99), short_tail)
    top = F.greatest("p25", "p50", "p99")
    return rows.withColumn("peak", top).filter(F.col("peak") >= level)


def label_level(df: DataFrame, value: str, level: float = 60.0) -> DataFrame:
    return df.withColumn("label", F.when(F.col(value) >= level, "anomaly").otherwise("normal"))


def detection_sets(true: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outcome ``tp``, ``fp`` or ``fn`` per key of two key sets.

    The sets are stacked and grouped on the full key, so that each group holds a
    handful of rows whatever the distribution.
    """
    stacked = true.select(*keys, F.lit(1).alias("_true"), F.lit(0).alias("_found")).unionByName(
        found.select(*keys, F.lit(0).alias("_true"), F.lit(1).alias("_found"))
    )
    merged = stacked.groupBy(*keys).agg(
        F.max("_true").alias("_true"), F.max("_found").alias("_found")
    )
    outcome = (
        F.when((F.col("_true") == 1) & (F.col("_found") == 1), "tp")
        .when(F.col("_found") == 1, "fp")
        .otherwise("fn")
    )
    return merged.select(*keys, outcome.alias("outcome"))


def detection_report(sets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of true, identified and correct detections and the percent detected."""
    hit, extra = F.col("outcome") == "tp", F.col("outcome") == "fp"
    n_true = F.count_if(~extra)
    return sets.groupBy(*by).agg(
        n_true.alias("n_true"),
        F.count_if(F.col("outcome") != "fn").alias("n_identified"),
        F.count_if(hit).alias("n_correct"),
        F.count_if(extra).alias("n_false"),
        F.count_if(F.col("outcome") == "fn").alias("n_missed"),
        F.when(n_true > 0, F.count_if(hit) * 100.0 / n_true).alias("percent_detected"),
    )

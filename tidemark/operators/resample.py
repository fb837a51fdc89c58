"""Time buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import Frames, match, quantiles_of_counts
from tidemark.operators.ranges import with_range


def bucket(ts: str, unit: str) -> Column:
    return F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")


def resample(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    unit: str,
    aggs: Mapping[str, Column],
    empty: Mapping[str, float] | None = None,
    out: str = "bucket",
    fill_gaps: bool = True,
) -> DataFrame:
    """Aggregate per series and calendar bucket, with rows for empty buckets.

    Empty buckets between the first and last one of a series get null, or the
    value named in ``empty`` (0 for sums). They are made from the gap to the next
    bucket, so the filled result needs no second scan and no spine join, and a gap of
    any length is generated in bounded pieces.
    """
    grouped = df.groupBy(*keys, bucket(ts, unit).alias(out)).agg(
        *[c.alias(name) for name, c in aggs.items()]
    )
    if not fill_gaps:
        return grouped
    frames = Frames(grouped, keys, [out], after=1)
    ahead = frames.df.withColumn("_next", F.lead(out).over(frames.order))
    ahead = frames.finish(ahead)
    # a row stands for itself and the empty buckets up to the next one
    gap = F.coalesce(F.timestamp_diff(unit.upper(), F.col(out), F.col("_next")), F.lit(1))
    filled = with_range(ahead, gap, "_step")
    filled = filled.withColumn("_at", F.timestamp_add(unit.upper(), F.col("_step").cast("int"), F.col(out)))
    kept = F.col("_at") == F.col(out)
    empty = empty or {}
    cols = [
        F.when(kept, F.col(name)).otherwise(F.lit(empty.get(name))).alias(name) for name in aggs
    ]
    return filled.select(*keys, F.col("_at").alias(out), *cols)


def tumbling(
    df: DataFrame, keys: Sequence[str], ts: str, width: str, aggs: Mapping[str, Column]
) -> DataFrame:
    """Aggregate over fixed-length windows aligned on 1970-01-01 UTC."""
    grouped = df.groupBy(*keys, F.window(ts, width).alias("w")).agg(
        *[c.alias(name) for name, c in aggs.items()]
    )
    return grouped.select(
        *keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *aggs
    )


def tumbling_center(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    width: str,
    distinct: bool = True,
) -> DataFrame:
    """Row count, mean and exact median per fixed-length window.

    With ``distinct`` each value counts once for mean and median, while the row
    count still covers all rows.
    """
    by = [*keys, "start", "end"]
    placed = df.select(*keys, F.window(ts, width).alias("w"), value).select(
        *keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), value
    )
    counts = placed.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_rows"))
    counts = counts.withColumn("_freq", F.lit(1).cast("long") if distinct else F.col("_rows"))
    present = F.when(F.col(value).isNotNull(), F.col("_freq"))
    means = counts.groupBy(*by).agg(
        F.sum("_rows").alias("rows"),
        (F.sum(F.col(value) * present) / F.sum(present)).alias("mean"),
    )
    medians = quantiles_of_counts(counts, by, value, "_freq", [0.5], ["median"])
    return match(means, medians, by)

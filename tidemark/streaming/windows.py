"""Event-time windows with a watermark: the stream form of time buckets.

``ts`` must be a zoned timestamp; zone-less ones are read as UTC wall time.

A window is emitted once the watermark has passed its end, which rows at the end of a bounded input never
make happen. ``end_marker`` is a row for that: its time lies past any other, so it moves the watermark
behind every window, and ``event_time`` drops it from what is aggregated. A stream that has seen its marker
is over: rows that arrive later are late.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: The time of the marker row; rows at or after it are not data.
END_OF_INPUT = dt.datetime(9999, 12, 1)


def end_marker(spark: SparkSession, schema: T.StructType, ts: str) -> DataFrame:
    """One row that ends a stream of this schema: the end time, all other columns null."""
    row = tuple(END_OF_INPUT if f.name == ts else None for f in schema.fields)
    free = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    return spark.createDataFrame([row], free)


def event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """``stream`` with a watermark, without end markers.

    The filter reads the event time, so Spark keeps it behind the watermark, which sees the marker."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return rows.filter(F.col(ts) < F.lit(END_OF_INPUT).cast("timestamp"))


def _flat(grouped: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    return grouped.select(
        *keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *aggs
    )


def windowed(
    stream: DataFrame,
    keys: Sequence[str],
    ts: str,
    width: str,
    aggs: Mapping[str, Column],
    delay: str,
    slide: str | None = None,
) -> DataFrame:
    """Tumbling windows, or sliding ones if ``slide`` is given."""
    rows = event_time(stream, ts, delay)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    grouped = rows.groupBy(*keys, window.alias("w")).agg(
        *[c.alias(name) for name, c in aggs.items()]
    )
    return _flat(grouped, keys, aggs)


def sessions(
    stream: DataFrame,
    keys: Sequence[str],
    ts: str,
    gap: str,
    aggs: Mapping[str, Column],
    delay: str,
) -> DataFrame:
    """Runs of rows of a key that are at most ``gap`` apart."""
    rows = event_time(stream, ts, delay)
    grouped = rows.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(
        *[c.alias(name) for name, c in aggs.items()]
    )
    return _flat(grouped, keys, aggs)


def deduplicated(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark delay."""
    return event_time(stream, ts, delay).dropDuplicatesWithinWatermark(list(keys))

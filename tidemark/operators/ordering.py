"""Row order inside a series: positions, bounded frames, running totals.

Windows by ``partitionBy(series)`` put a whole series into one task. That is the
best plan while every series is of modest size, and it fails once one series
holds a large share of the table. Everything here therefore has two plans:

* no series above ``rowsPerTask``: a plain window, one shuffle by series;
* some series above it: the rows are range-partitioned by (series, order), which
  Spark balances by sampling whatever the key distribution, numbered inside each
  partition, and shifted by the row counts of the partitions before. Frames then
  run on chunks of consecutive positions that carry the neighbouring rows they
  need, so that no task ever sees more than a chunk.

The order must be total (end it with a unique column) for results to be stable.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.session import checkpointed, rows_per_task

Order = Sequence[str | Column]


#: Sizes counted before, by plan and keys. They steer the choice of a plan only, never a result.
_KNOWN_SIZES: dict[tuple, tuple[int, int]] = {}
MOST_KNOWN = 256


def _group_sizes(
    df: DataFrame, keys: Sequence[str], limit: int | None = None
) -> tuple[int, int]:
    """(largest group, all rows), counted once per plan and keys.

    The rows alone are counted first: if all of them are within the limit (those of a task),
    so is any group, and their number stands for the largest one.
    """
    limit = rows_per_task(df.sparkSession) if limit is None else limit
    at = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), tuple(keys), limit)
    if at not in _KNOWN_SIZES:
        if len(_KNOWN_SIZES) >= MOST_KNOWN:
            _KNOWN_SIZES.clear()
        total = top = df.count()
        if keys and total > limit:
            counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            top = counts.agg(F.max("n").alias("top")).first()["top"] or 0
        _KNOWN_SIZES[at] = (top, total)
    return _KNOWN_SIZES[at]


def largest_group(df: DataFrame, keys: Sequence[str], limit: int) -> int:
    """Rows of the largest group, or of the table if all its rows are within ``limit``."""
    return _group_sizes(df, keys, limit)[0]


def hot_rows(df: DataFrame, keys: Sequence[str]) -> int:
    """0 if every group fits into one task, else the row count of the table."""
    top, total = _group_sizes(df, keys)
    return total if top > rows_per_task(df.sparkSession) else 0


def has_hot_group(df: DataFrame, keys: Sequence[str]) -> bool:
    return hot_rows(df, keys) > 0


def match(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join on equal keys (nulls match nulls), keeping the left copy of the keys."""
    renamed = {key: f"_right_{key}" for key in keys}
    right = right.withColumnsRenamed(renamed)
    cond = F.lit(True)
    for key, other in renamed.items():
        cond = cond & F.col(key).eqNullSafe(F.col(other))
    return left.join(right, cond, how).drop(*renamed.values())


def _range_sorted(
    df: DataFrame, keys: Sequence[str], order: Order, total: int
) -> DataFrame:
    """Rows sorted by (keys, order) over balanced partitions, with a fixed row id.

    ``_rid`` is partition number * 2^33 + row number in the partition. Range
    bounds come from a sample, so the result is checkpointed: later reads must
    not draw other bounds.
    """
    spark = df.sparkSession
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        math.ceil(total / rows_per_task(spark)),
    )
    by = [*keys, *order]
    ranged = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return checkpointed(
        ranged.withColumn("_rid", F.monotonically_increasing_id()).withColumn(
            "_pid", F.shiftright("_rid", 33)
        )
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    weight: str | None = None,
    col: str = "before",
    hot: int | None = None,
) -> DataFrame:
    """Add ``col``: the sum of ``weight`` (or the count) over the rows ahead of each row.

    ``hot`` is the answer of ``hot_rows``, if the caller already has it.
    """
    hot = hot_rows(df, keys) if hot is None else hot
    amount = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    if not hot:
        w = Window.partitionBy(*keys).orderBy(*order)
        if weight is None:
            return df.withColumn(col, F.row_number().over(w).cast("long") - 1)
        ahead = w.rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(col, F.coalesce(F.sum(amount).over(ahead), F.lit(0).cast("long")))

    rows = _range_sorted(df, keys, order, hot)
    runs = rows.groupBy("_pid", *keys).agg(
        F.min("_rid").alias("_first"), F.sum(amount).alias("_amount")
    )
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn(
        "_ahead", F.coalesce(F.sum("_amount").over(earlier), F.lit(0).cast("long"))
    )
    joined = match(rows, runs.drop("_amount"), ["_pid", *keys], "inner")
    if weight is None:
        joined = joined.withColumn(col, F.col("_ahead") + F.col("_rid") - F.col("_first"))
    else:
        local = (
            Window.partitionBy("_pid", *keys)
            .orderBy("_rid")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        joined = joined.withColumn(
            col, F.col("_ahead") + F.coalesce(F.sum(amount).over(local), F.lit(0).cast("long"))
        )
    return joined.drop("_rid", "_pid", "_first", "_ahead")


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    col: str = "pos",
    length: str | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its series, and the series length."""
    hot = hot_rows(df, keys)
    rows = running_total(df, keys, order, None, col, hot)
    if length is None:
        return rows
    if hot:
        return attach(rows, series_length(df, keys, length), keys)
    return rows.withColumn(length, F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def series_length(df: DataFrame, keys: Sequence[str], col: str = "n") -> DataFrame:
    """One row per series with its row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(col))


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add per-series statistics to the rows.

    Without keys the single statistics row is read as a scalar subquery. With
    keys it is a null-safe left join: Spark broadcasts the statistics if they are
    below its threshold, else AQE splits the partitions of long series.
    """
    names = [c for c in stats.columns if c not in keys]
    if not keys:
        one = stats.select(F.struct(*names).alias("_stats")).scalar()
        out = df.withColumn("_stats", one)
        return out.select(*df.columns, *[F.col("_stats")[c].alias(c) for c in names])
    return match(df, stats, keys, "left")


class Frames:
    """Row frames over each series that stay bounded when a series is huge.

    ``before`` and ``after`` are the farthest rows any frame, ``lag`` or ``lead``
    will look at. Build columns on ``.df`` with ``.rows(a, b)`` and ``.order``
    as window specs, then call ``.finish``.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Order,
        before: int = 0,
        after: int = 0,
        position: str | None = None,
    ) -> None:
        if before < 0 or after < 0:
            raise ValueError("before and after must not be negative")
        self.before, self.after = before, after
        hot = hot_rows(df, keys)
        self._chunked = hot > 0
        self.most_chunks = 1  # of any series
        self._helpers: list[str] = []
        if not self._chunked:
            self.order = Window.partitionBy(*keys).orderBy(*order)
            self.df = df
            if position:
                self.df = df.withColumn(position, F.row_number().over(self.order).cast("long") - 1)
            return
        size = max(rows_per_task(df.sparkSession), before + after, 1)
        self.most_chunks = math.ceil(hot / size)
        pos = position or "_pos"
        self._helpers = ["_chunk", "_home"] + ([] if position else ["_pos"])
        rows = running_total(df, keys, order, None, pos, hot)
        home = F.floor(F.col(pos) / size)
        low = F.greatest(F.floor((F.col(pos) - after) / size), F.lit(0))
        high = F.floor((F.col(pos) + before) / size)
        self.df = rows.withColumn("_chunk", F.explode(F.sequence(low, high))).withColumn(
            "_home", F.col("_chunk") == home
        )
        self.order = Window.partitionBy(*keys, "_chunk").orderBy(pos)

    def rows(self, start: int, end: int) -> WindowSpec:
        if start < -self.before or end > self.after:
            raise ValueError("frame reaches past the rows declared in before/after")
        return self.order.rowsBetween(start, end)

    def with_groups(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_chunk`` (what one task may hold together) and ``_home`` (not a neighbour's copy) in both plans."""
        if self._chunked:
            return df
        return df.withColumns({"_chunk": F.lit(0).cast("long"), "_home": F.lit(True)})

    def finish(self, df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
        """Keep each row once (neighbour copies go) and drop helper columns."""
        if self._chunked:
            df = df.filter("_home")
        return df.drop(*self._helpers, *drop)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per series.

    Equal values are counted first (map-side combined), then sorted with a running
    count, and only the values at the wanted ranks are kept. Unlike the built-in
    ``percentile`` this never builds a value table of a series in memory.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_freq"))
    return quantiles_of_counts(counts, keys, value, "_freq", probs, names)


def quantiles_of_counts(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    freq: str,
    probs: Sequence[float],
    names: Sequence[str],
) -> DataFrame:
    """``exact_quantiles`` for rows (keys, value) that occur ``freq`` times."""
    counts = counts.filter(F.col(value).isNotNull()).select(
        *keys, value, F.col(freq).alias("_freq")
    )
    hot = hot_rows(counts, keys)
    ranked = running_total(counts, keys, [value], "_freq", "_before", hot)
    if hot:
        sized = attach(ranked, counts.groupBy(*keys).agg(F.sum("_freq").alias("_n")), keys)
    else:
        sized = ranked.withColumn("_n", F.sum("_freq").over(Window.partitionBy(*keys)))
    aggs = []
    for p, name in zip(probs, names, strict=True):
        spot = F.lit(float(p)) * (F.col("_n") - 1)
        for part, rank in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            inside = (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_freq"))
            aggs.append(F.max(F.when(inside, F.col(value))).alias(f"_{name}_{part}"))
    picked = sized.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs)
    cols = []
    for p, name in zip(probs, names, strict=True):
        spot = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        share = spot - F.floor(spot)
        cols.append((lo * (1 - share) + hi * share).cast("double").alias(name))
    return picked.select(*keys, *cols)

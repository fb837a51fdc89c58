"""Descriptive statistics of columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import attach, exact_quantiles, match, running_total
from tidemark.operators.radix import table_quantiles


def describe(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, a row per column.

    The moments of all columns are one wide aggregate; without keys the quartiles take four scans."""
    by = [*keys, "column"]
    numbers = {c: F.col(c).cast("double") for c in columns}
    moments = [
        F.struct(
            F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), F.max(x).alias("max"),
        )
        for c, x in numbers.items()
    ]
    rows = df.groupBy(*keys).agg(F.array(*moments).alias("_all"))
    rows = rows.select(*keys, F.explode("_all").alias("_one")).select(*keys, "_one.*")
    if not keys:
        found = table_quantiles(df, columns, [0.25, 0.5, 0.75])
        names = F.array(*[F.lit(c) for c in columns])
        at = F.array_position(names, F.col("column")) - 1
        return rows.withColumns(
            {
                name: F.get(F.array(*[F.lit(q[i]).cast("double") for q in found]), at.cast("int"))
                for i, name in enumerate(("q25", "q50", "q75"))
            }
        )
    long = df.select(*keys, *[x.alias(c) for c, x in numbers.items()]).unpivot(
        list(keys), list(columns), "column", "value"
    )
    quartiles = exact_quantiles(long, by, "value", [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    return match(rows, quartiles, by)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def positive_rate(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Percent of rows whose class is 1."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count_if(F.col(column) == 1) * 100 / F.count(F.lit(1))).alias("percent"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def distinct_estimate(df: DataFrame, column: str, rsd: float = 0.02) -> DataFrame:
    return df.agg(F.approx_count_distinct(column, rsd).alias("n"))


def average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add the 1-based rank of the value over the table, ties sharing their mean rank."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_freq"))
    ranks = running_total(counts.filter(F.col(column).isNotNull()), [], [column], "_freq", "_below")
    ranks = ranks.select(column, (F.col("_below") + (F.col("_freq") + 1) / 2).alias(out))
    return match(df, ranks, [column])


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank correlation of every column pair, over rows where all are present."""
    ranked = df.select(*columns).na.drop()
    for c in columns:
        ranked = average_rank(ranked, c, f"_rank_{c}")
    pairs = list(combinations_with_replacement(columns, 2))
    row = ranked.agg(
        *[F.corr(f"_rank_{a}", f"_rank_{b}").alias(f"{a}|{b}") for a, b in pairs]
    )
    long = row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "rho")
    return long.select(
        F.split_part("pair", F.lit("|"), F.lit(1)).alias("x"),
        F.split_part("pair", F.lit("|"), F.lit(2)).alias("y"),
        "rho",
    )


def box_stats(
    df: DataFrame, value: str, keys: Sequence[str] = (), whisker: float = 20.0
) -> DataFrame:
    """Quartiles, mean, whisker ends and the number of fliers beyond them."""
    keys = list(keys)
    quartiles = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    rows = with_fences(df, quartiles, keys, whisker)
    inside = F.col(value).between(F.col("_low"), F.col("_high"))
    return rows.groupBy(*keys).agg(
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.avg(value).alias("mean"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("fliers"),
    )


def fliers(
    df: DataFrame, value: str, keys: Sequence[str] = (), whisker: float = 20.0
) -> DataFrame:
    """The rows beyond the whiskers."""
    keys = list(keys)
    quartiles = exact_quantiles(df, keys, value, [0.25, 0.75], ["q1", "q3"])
    rows = with_fences(df, quartiles, keys, whisker)
    beyond = ~F.col(value).between(F.col("_low"), F.col("_high"))
    return rows.filter(beyond).select(*df.columns)


def with_fences(
    df: DataFrame, quartiles: DataFrame, keys: Sequence[str], whisker: float
) -> DataFrame:
    reach = (F.col("q3") - F.col("q1")) * whisker
    return attach(
        df,
        quartiles.withColumns({"_low": F.col("q1") - reach, "_high": F.col("q3") + reach}),
        keys,
    )


def _equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin 0..bins-1 of equal-width bins; the last one includes the maximum."""
    width = F.when(high > low, high - low).otherwise(F.lit(1.0))
    spot = F.floor((value - low) / width * bins)
    return F.least(spot, F.lit(bins - 1).cast("long"))


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Counts over a grid of equal-width bins between the extremes."""
    extremes = df.agg(
        F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1")
    )
    rows = attach(df.select(x, y).na.drop(), extremes, [])
    return rows.groupBy(
        _equal_width_bin(F.col(x), F.col("_x0"), F.col("_x1"), bins).alias("bx"),
        _equal_width_bin(F.col(y), F.col("_y0"), F.col("_y1"), bins).alias("by"),
    ).agg(F.count(F.lit(1)).alias("n"))


def density(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    points: int = 100,
    bins: int | None = 512,
) -> DataFrame:
    """Gaussian kernel density on an even grid, Scott bandwidth.

    The grid runs half a range beyond both extremes. Rows are first counted in
    ``bins`` equal-width bins (each standing for its centre), so the kernel work
    is bins x points per series, whatever the row count. ``bins=None`` keeps
    every distinct value apart.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.stddev_samp("_v").alias("_sd"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
    )
    if bins is None:
        mass = rows.groupBy(*keys, F.col("_v").alias("_at")).agg(F.count(F.lit(1)).alias("_m"))
        mass = attach(mass, stats, keys)
    else:
        slot = _equal_width_bin(F.col("_v"), F.col("_lo"), F.col("_hi"), bins)
        binned = attach(rows, stats.select(*keys, "_lo", "_hi"), keys)
        binned = binned.groupBy(*keys, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_m"))
        mass = attach(binned, stats, keys)
        centre = F.col("_lo") + (F.col("_slot") + 0.5) * (F.col("_hi") - F.col("_lo")) / bins
        mass = mass.withColumn("_at", centre)
    band = F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2))
    span = F.col("_hi") - F.col("_lo")
    spot = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    spread = mass.withColumn("_h", band).filter("_h > 0").withColumn("point", spot)
    grid = F.col("_lo") - span / 2 + F.col("point") * (span * 2 / (points - 1))
    z = (grid - F.col("_at")) / F.col("_h")
    kernel = F.exp(z * z * -0.5) / (F.col("_h") * F.col("_n") * math.sqrt(2 * math.pi))
    return spread.groupBy(*keys, "point").agg(
        F.first(grid).alias("x"), F.sum(kernel * F.col("_m")).alias("density")
    )


def count_by_remainder(df: DataFrame, column: str, modulus: int = 10) -> DataFrame:
    return df.groupBy((F.col(column) % modulus).alias("remainder")).agg(
        F.count(F.lit(1)).alias("n")
    )


def mean_series(df: DataFrame, label: str, series: str) -> DataFrame:
    """Position-wise mean of array series per class, in long form."""
    points = df.select(label, F.posexplode(series).alias("pos", "value"))
    return points.groupBy(label, "pos").agg(F.avg(F.col("value").cast("double")).alias("mean"))


def as_arrays(long: DataFrame, keys: Sequence[str], pos: str, value: str, out: str) -> DataFrame:
    """Collect long-form points, whose number is fixed by the series width, into arrays."""
    packed = F.array_sort(F.collect_list(F.struct(pos, value)))
    return long.groupBy(*keys).agg(F.transform(packed, lambda p: p[value]).alias(out))

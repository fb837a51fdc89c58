"""Column selection, parsing, repair and imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import cyclic
from tidemark.operators.ordering import Order, attach, exact_quantiles, numbered
from tidemark.operators.radix import table_quantiles

DAY_SECONDS = 86400.0
YEAR_SECONDS = 365.2425 * DAY_SECONDS


def feature_columns(df: DataFrame, drop: Sequence[str] = ("timestamp", "id")) -> list[str]:
    """Names of the columns that are features: all but ``drop``."""
    return [c for c in df.columns if c not in drop]


def select_features(df: DataFrame, drop: Sequence[str] = ("timestamp", "id")) -> DataFrame:
    return df.select(*feature_columns(df, drop))


def rename_by_position(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns, {len(names)} names")
    return df.toDF(*names)


def parse_timestamp(df: DataFrame, column: str, fmt: str, out: str | None = None) -> DataFrame:
    """Parse text into a zone-less timestamp; unreadable text gives null."""
    parsed = F.try_to_timestamp(F.col(column), F.lit(fmt)).cast("timestamp_ntz")
    return df.withColumn(out or column, parsed)


def null_markers(column: Column, markers: Sequence[str] = ("nan", "?")) -> Column:
    return F.when(F.trim(column).isin(*markers), None).otherwise(column)


def repair_sentinel(
    df: DataFrame, columns: Sequence[str], sentinel: float = -9999.0, value: float = 0.0
) -> DataFrame:
    repaired = {
        c: F.when(F.col(c) == F.lit(sentinel), F.lit(value)).otherwise(F.col(c)) for c in columns
    }
    return df.withColumns(repaired)


def fill_constant(
    df: DataFrame, value: float | str, columns: Sequence[str] | None = None
) -> DataFrame:
    return df.na.fill(value, subset=list(columns) if columns is not None else None)


def fill_text(df: DataFrame, columns: Sequence[str], marker: str = "_NA_") -> DataFrame:
    return df.na.fill(marker, subset=list(columns))


def impute(
    df: DataFrame, modes: Mapping[str, str], value: float = 1.0, keys: Sequence[str] = ()
) -> DataFrame:
    """Fill nulls column by column: ``default`` (minimum), ``mean`` or ``customize``.

    All statistics come from one aggregation, per series if keys are given.
    Columns that are not in ``modes`` stay as they are.
    """
    stats = []
    for name, mode in modes.items():
        if name not in df.columns:
            raise ValueError(f"no column {name!r}")
        if mode == "default":
            stats.append(F.min(name).alias(f"_fill_{name}"))
        elif mode == "mean":
            stats.append(F.avg(name).alias(f"_fill_{name}"))
        elif mode != "customize":
            raise ValueError(f"unknown imputation mode {mode!r} for {name!r}")
    out = df
    if stats:
        out = attach(df, df.groupBy(*keys).agg(*stats), list(keys))
    filled = {
        name: F.coalesce(
            F.col(name), F.lit(value) if mode == "customize" else F.col(f"_fill_{name}")
        )
        for name, mode in modes.items()
    }
    return out.withColumns(filled).select(*df.columns)


def drop_non_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows whose listed columns are all present and finite."""
    keep = F.lit(True)
    for name in columns:
        c = F.col(name)
        keep = keep & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return df.filter(keep)


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column with its null count."""
    columns = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "nulls")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; empty if the keys are unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def at_least(df: DataFrame, column: str, level: float) -> DataFrame:
    return df.filter(F.col(column) >= level)


def position_range(
    df: DataFrame, keys: Sequence[str], order: Order, first: int, last: int
) -> DataFrame:
    """Rows whose position in the series lies in [first, last]."""
    return numbered(df, keys, order, "pos").filter(F.col("pos").between(first, last))


def every_nth(
    df: DataFrame, keys: Sequence[str], order: Order, step: int, start: int
) -> DataFrame:
    """Systematic subsample: positions start, start + step, ... of each series."""
    spot = F.col("pos") - start
    return numbered(df, keys, order, "pos").filter((spot >= 0) & (spot % step == 0))


def calendar_slice(df: DataFrame, ts: str, unit: str, period: str) -> DataFrame:
    """Rows of one calendar period, as a plain range on ``ts`` that can be pushed down."""
    start = F.lit(period).cast("timestamp_ntz")
    step = {"month": "INTERVAL '1' MONTH", "year": "INTERVAL '1' YEAR", "day": "INTERVAL '1' DAY"}
    return df.filter((F.col(ts) >= start) & (F.col(ts) < start + F.expr(step[unit])))


def polar_to_xy(
    df: DataFrame, speed: str, degrees: str, x: str = "wx", y: str = "wy"
) -> DataFrame:
    angle = F.radians(degrees)
    return df.withColumns({x: F.col(speed) * F.cos(angle), y: F.col(speed) * F.sin(angle)})


def cyclic_time(df: DataFrame, ts: str) -> DataFrame:
    """Sine and cosine of the time of day and of the time of year."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)
    day_sin, day_cos = cyclic(seconds, DAY_SECONDS)
    year_sin, year_cos = cyclic(seconds, YEAR_SECONDS)
    return df.withColumns(
        {"day_sin": day_sin, "day_cos": day_cos, "year_sin": year_sin, "year_cos": year_cos}
    )


def calendar_fields(df: DataFrame, ts: str) -> DataFrame:
    parts = {
        "year": F.year,
        "month": F.month,
        "day": F.dayofmonth,
        "week": F.weekofyear,
        "hour": F.hour,
        "minute": F.minute,
        "second": F.second,
    }
    return df.withColumns({name: fn(ts) for name, fn in parts.items()})


def to_long(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str
) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def one_hot(df: DataFrame, column: str, classes: Sequence[int], prefix: str) -> DataFrame:
    flags = {f"{prefix}{k}": F.when(F.col(column) == k, 1).otherwise(0) for k in classes}
    return df.withColumns(flags)


def decile_bins(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), bins: int = 10
) -> DataFrame:
    """Add ``<column>_bin``: how many of the exact inner quantile edges lie below x."""
    probs = [i / bins for i in range(1, bins)]
    if not keys:  # the edges of all columns come from the same few scans
        found = dict(zip(columns, table_quantiles(df, columns, probs), strict=True))
        flags = {c: [F.lit(e) < F.col(c) for e in edges] for c, edges in found.items()}
        return df.withColumns(
            {f"{c}_bin": sum((f.cast("int") for f in flags[c]), F.lit(0)) for c in columns}
        )
    out = df
    for c in columns:
        names = [f"_edge{i}" for i in range(1, bins)]
        out = attach(out, exact_quantiles(df, list(keys), c, probs, names), list(keys))
        below = sum(((F.col(n) < F.col(c)).cast("int") for n in names), F.lit(0))
        out = out.withColumn(f"{c}_bin", below).drop(*names)
    return out

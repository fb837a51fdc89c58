"""Forecasts that Spark expresses as windows, sums and small linear systems."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import fold_steps
from tidemark.operators.ordering import Frames, Order, attach
from tidemark.operators.scaling import scale_in_window, unscaled


def persistence(
    df: DataFrame, keys: Sequence[str], order: Order, value: str, steps: int = 1,
    out: str = "predicted",
) -> DataFrame:
    """The value ``steps`` rows ago as the forecast of each row."""
    frames = Frames(df, keys, order, before=steps)
    return frames.finish(frames.df.withColumn(out, F.lag(value, steps).over(frames.order)))


def last_value(
    df: DataFrame, keys: Sequence[str], order: Order, value: str, horizon: int
) -> DataFrame:
    """Each row's value repeated for the next ``horizon`` rows, with the actual values.

    Long format: one row per (origin row, h).
    """
    frames = Frames(df, keys, order, after=horizon, position="origin")
    ahead = F.collect_list(F.struct(value)).over(frames.rows(1, horizon))
    rows = frames.finish(frames.df.withColumn("_ahead", ahead))
    rows = rows.select(
        *keys,
        "origin",
        F.col(value).alias("predicted"),
        F.posexplode("_ahead").alias("_h", "_actual"),
    )
    return rows.select(
        *keys,
        "origin",
        (F.col("_h") + 1).alias("h"),
        F.col("_actual")[value].alias("actual"),
        "predicted",
    )


def repeat_previous(
    df: DataFrame, keys: Sequence[str], order: Order, value: str, horizon: int,
    out: str = "predicted",
) -> DataFrame:
    """The previous ``horizon`` rows repeated: the value ``horizon`` rows ago."""
    return persistence(df, keys, order, value, horizon, out)


def _with_lag(df: DataFrame, keys: Sequence[str], order: Order, value: str) -> DataFrame:
    return persistence(df, keys, order, value, 1, "_lag")


def fit_ar1(
    df: DataFrame, keys: Sequence[str], order: Order, value: str, where: Column | None = None
) -> DataFrame:
    """``intercept`` and ``slope`` of each series regressed on its previous value."""
    rows = _with_lag(df, keys, order, value)
    rows = rows if where is None else rows.filter(where)
    return rows.groupBy(*keys).agg(
        F.regr_intercept(value, "_lag").alias("intercept"),
        F.regr_slope(value, "_lag").alias("slope"),
    )


def predict_ar1(
    df: DataFrame, model: DataFrame, keys: Sequence[str], order: Order, value: str,
    out: str = "predicted",
) -> DataFrame:
    """One-step forecast of each row from the row before."""
    rows = attach(_with_lag(df, keys, order, value), model, keys)
    return rows.withColumn(out, F.col("intercept") + F.col("slope") * F.col("_lag")).drop(
        "_lag", "intercept", "slope"
    )


def predict_drift(
    df: DataFrame, keys: Sequence[str], order: Order, value: str, where: Column | None = None,
    out: str = "predicted",
) -> DataFrame:
    """Residual forecast: the previous value plus the mean change of the series."""
    rows = _with_lag(df, keys, order, value)
    seen = rows if where is None else rows.filter(where)
    drift = seen.groupBy(*keys).agg(F.avg(F.col(value) - F.col("_lag")).alias("_drift"))
    return attach(rows, drift, keys).withColumn(out, F.col("_lag") + F.col("_drift")).drop(
        "_lag", "_drift"
    )


def forecast_ar1(
    df: DataFrame, model: DataFrame, keys: Sequence[str], order: Order, value: str, horizon: int
) -> DataFrame:
    """Recursive forecast of ``horizon`` steps past the end of each series."""
    last = df.groupBy(*keys).agg(F.max(F.struct(*order, value)).alias("_last"))
    rows = attach(last, model, keys)
    steps = fold_steps(
        F.col(f"_last.{value}"), horizon, lambda v: F.col("intercept") + F.col("slope") * v
    )
    return rows.select(*keys, F.posexplode(steps).alias("_h", "predicted")).select(
        *keys, (F.col("_h") + 1).alias("h"), "predicted"
    )


def lag_table(
    df: DataFrame, keys: Sequence[str], order: Order, value: str, lags: int, horizon: int = 1
) -> DataFrame:
    """Rows with ``lag_1`` (newest) .. ``lag_<lags>`` and the value ``horizon`` steps ahead of lag_1."""
    reach = lags + horizon - 1
    frames = Frames(df, keys, order, before=reach)
    cols = {
        f"lag_{i}": F.lag(value, horizon - 1 + i).over(frames.order) for i in range(1, lags + 1)
    }
    rows = frames.finish(frames.df.withColumns(cols))
    return rows.na.drop(subset=[f"lag_{lags}"])


def comoments(columns: Sequence[Column]) -> dict[str, Column]:
    """Row count, means and centred sums of products (upper triangle) of some columns.

    Spark's covariance keeps running means, so a large level does not swamp the spread.
    """
    n = F.count(F.lit(1))
    pairs = [F.covar_pop(a, b) * n for i, a in enumerate(columns) for b in columns[i:]]
    return {"rows": n, "means": F.array(*map(F.avg, columns)), "co": F.array(*pairs)}


def _weighted_comoments(
    rows: DataFrame, keys: Sequence[str], names: Sequence[str], weight: str
) -> DataFrame:
    """The same with weights: the means first, then the products of what is left."""
    w = F.col(weight)
    means = rows.groupBy(*keys).agg(
        F.array(*[F.sum(w * F.col(c)) / F.sum(w) for c in names]).alias("_means")
    )
    rows = attach(rows, means, keys)
    off = [F.col(c) - F.get("_means", F.lit(i)) for i, c in enumerate(names)]
    pairs = [F.sum(w * a * b) for i, a in enumerate(off) for b in off[i:]]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.first("_means").alias("_means"),
        F.array(*pairs).alias("_co"),
    )


def symmetric(upper: np.ndarray, size: int) -> np.ndarray:
    """Symmetric matrices of row-wise upper triangles (last axis)."""
    full = np.zeros((*upper.shape[:-1], size, size))
    i, j = np.triu_indices(size)
    full[..., i, j] = upper
    full[..., j, i] = upper
    return full


#: Smallest eigenvalue of a correlation matrix that still counts as independent columns.
INDEPENDENT = 1e-12


def solve_centred(
    co: np.ndarray, ridge: float = 0.0
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slopes, residual sums, scaled inverses and singular flags of centred systems.

    ``co`` holds products of features and, last, the target. Columns are scaled by their
    deviation first. A singular system has NaN slopes.
    """
    gram, moments, total = co[:, :-1, :-1], co[:, :-1, -1], co[:, -1, -1]
    k = gram.shape[1]
    gram_ridged = gram + ridge * np.eye(k)
    scale = np.sqrt(np.maximum(np.einsum("bii->bi", gram_ridged), 0.0))
    safe = np.where(scale > 0, scale, 1.0)
    unit = gram_ridged / safe[:, :, None] / safe[:, None, :]
    finite = np.isfinite(unit).all(axis=(1, 2))
    unit[~finite] = 0.0
    singular = ~finite | (scale == 0).any(axis=1)
    if k:
        singular |= np.linalg.eigvalsh(unit)[:, 0] < INDEPENDENT
    unit[singular] = np.eye(k)
    inverse = np.linalg.inv(unit) / safe[:, :, None] / safe[:, None, :]
    slopes = np.linalg.solve(unit, (moments / safe)[:, :, None])[:, :, 0] / safe
    left = total - 2 * np.einsum("bi,bi->b", slopes, moments)
    left = left + np.einsum("bi,bij,bj->b", slopes, gram, slopes)
    slopes[singular] = np.nan
    return slopes, np.where(singular, np.nan, np.maximum(left, 0.0)), inverse, singular


def least_squares(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    target: str,
    weight: str | None = None,
    ridge: float = 0.0,
) -> DataFrame:
    """Linear model with intercept per series: ``weights`` (intercept first), ``rows``, ``sse``.

    Means and centred products are plain aggregates (map-side combined, so a long series
    costs no more memory than a short one). Only the small centred systems are solved in
    numpy, in batches of series. ``ridge`` is added to the diagonal, but not for the
    intercept. Features that determine each other leave ``weights`` and ``sse`` null and
    set ``singular``.
    """
    names = [*features, target]
    used = [*names, *([weight] if weight else [])]
    rows = df.select(*keys, *dict.fromkeys(used)).na.drop(subset=used)
    rows = rows.withColumns({f"_v{i}": F.col(c).cast("double") for i, c in enumerate(names)})
    values = [f"_v{i}" for i in range(len(names))]
    if weight:
        table = _weighted_comoments(rows, keys, values, weight)
    else:
        sums = comoments([F.col(c) for c in values])
        table = rows.groupBy(*keys).agg(*[c.alias(f"_{name}") for name, c in sums.items()])
    size = len(names)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            co = symmetric(np.array(batch["_co"].tolist(), dtype=float), size)
            means = np.array(batch["_means"].tolist(), dtype=float)
            slopes, sse, _, singular = solve_centred(co, ridge)
            intercept = means[:, -1] - np.einsum("bi,bi->b", slopes, means[:, :-1])
            every = np.column_stack([intercept, slopes])
            weights = [None if bad else w.tolist() for w, bad in zip(every, singular)]
            yield batch[list(keys)].assign(
                rows=batch["_rows"], weights=weights, singular=singular,
                sse=[None if bad else float(e) for e, bad in zip(sse, singular)],
            )

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*keys).schema]
    return table.mapInPandas(
        solve,
        ", ".join([*schema, "rows long, weights array<double>, singular boolean, sse double"]),
    )


def predict_linear(
    df: DataFrame, model: DataFrame, keys: Sequence[str], features: Sequence[str],
    out: str = "predicted",
) -> DataFrame:
    rows = attach(df, model.select(*keys, "weights"), keys)
    total = F.get("weights", F.lit(0))
    for i, f in enumerate(features, start=1):
        total = total + F.get("weights", F.lit(i)) * F.col(f)
    return rows.withColumn(out, total).drop("weights")


def direct_multi_horizon(
    df: DataFrame, keys: Sequence[str], order: Order, value: str, lags: int, horizon: int
) -> DataFrame:
    """One linear model per step ahead, forecasts past the end of each series.

    All lags and leads come from one window pass; the steps become a key of the fit.
    """
    frames = Frames(df, keys, order, before=lags - 1, after=horizon)
    cols = {f"lag_{i}": F.lag(value, i - 1).over(frames.order) for i in range(1, lags + 1)}
    cols["_ahead"] = F.collect_list(F.struct(value)).over(frames.rows(1, horizon))
    cols["_last"] = F.lead(F.lit(1)).over(frames.order).isNull()
    rows = frames.finish(frames.df.withColumns(cols)).na.drop(subset=[f"lag_{lags}"])
    names = [f"lag_{i}" for i in range(1, lags + 1)]
    train = rows.select(*keys, *names, F.posexplode("_ahead").alias("_h", "_y")).select(
        *keys, *names, (F.col("_h") + 1).alias("h"), F.col("_y")[value].alias("_target")
    )
    model = least_squares(train, [*keys, "h"], names, "_target")
    last = rows.filter("_last").select(*keys, *names).withColumn(
        "h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    )
    return predict_linear(last, model, [*keys, "h"], names).select(*keys, "h", "predicted")


def score_windows_ar1(
    df: DataFrame,
    model: DataFrame,
    keys: Sequence[str],
    order: Order,
    value: str,
    width: int,
    mode: str = "minmax",
) -> DataFrame:
    """Scale every window on itself, forecast the next row, scale the forecast back.

    ``model`` holds intercept and slope on the scaled values. One plan for all
    windows: no loop over them.
    """
    rows = scale_in_window(df, keys, order, value, width, mode)
    rows = attach(rows.filter(F.col(f"{value}_scaled").isNotNull()), model, keys)
    rows = rows.withColumn(
        "predicted", F.col("intercept") + F.col("slope") * F.col(f"{value}_scaled")
    )
    return rows.withColumn("predicted", unscaled("predicted", value)).select(
        *df.columns, "predicted"
    )

"""Linear forecasts of many columns and steps from one factor per series.

Rows of a design block are [1, all lags of all columns, all steps ahead of all columns]. A block is never
a table: every task cuts it from its rows in pieces and folds each piece into a triangular factor (QR of
the factor on top of the piece). Factors of the chunks of a long series are folded together in a tree, so
what is moved is one small square matrix per chunk. All columns and steps share the factor; its leading
triangle gives every set of weights by back substitution, without forming normal equations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordering import Frames, Order

PIECE_CELLS = 1 << 20  # numbers of a design block that are held at once
FAN_IN = 16  # factors folded at one node of the tree
INDEPENDENT = 1e-11  # least share of a feature's length that earlier features do not explain


def fold(factor: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The triangular factor of all rows behind ``factor`` and of ``piece``."""
    r = np.linalg.qr(np.vstack([factor, piece]), mode="r")
    return np.vstack([r, np.zeros((piece.shape[1] - len(r), piece.shape[1]))]) if len(r) < piece.shape[1] else r


def design_factor(values: np.ndarray, home: np.ndarray, lags: int, horizon: int) -> tuple[int, np.ndarray]:
    """Row count and factor of the windows whose newest lag is a ``home`` row; ``values`` is rows x columns."""
    columns = values.shape[1]
    width = 1 + columns * (lags + horizon)
    factor, used = np.zeros((0, width)), 0
    windows = len(values) - lags - horizon + 1
    if windows > 0:
        view = np.lib.stride_tricks.sliding_window_view(values, lags + horizon, axis=0)
        own = np.flatnonzero(home[lags - 1 : lags - 1 + windows])
        step = max(1, PIECE_CELLS // width)
        for at in range(0, len(own), step):
            part = view[own[at : at + step]]
            part = part[np.isfinite(part).all(axis=(1, 2))]
            if not len(part):
                continue
            past = part[:, :, lags - 1 :: -1] if lags > 1 else part[:, :, :1]
            rows = [np.ones((len(part), 1)), past.reshape(len(part), -1), part[:, :, lags:].reshape(len(part), -1)]
            factor, used = fold(factor, np.hstack(rows)), used + len(part)
    return used, factor


def solve_factor(factor: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Weights (features x targets), residual sums and a singular flag of a square factor."""
    lead, right = factor[:features, :features], factor[:features, features:]
    length = np.sqrt((lead * lead).sum(axis=0))
    singular = bool((length == 0).any() or (np.abs(np.diag(lead)) < INDEPENDENT * length).any())
    sse = (factor[features:, features:] ** 2).sum(axis=0)
    if singular:
        return np.full(right.shape, np.nan), np.full(len(sse), np.nan), True
    return np.linalg.solve(lead / length, right) / length[:, None], sse, False


def _factors(df: DataFrame, keys: Sequence[str], order: Order, columns: Sequence[str], lags: int, horizon: int):
    """(keys, chunk, rows, factor, newest) per chunk, and the most chunks a series can have."""
    numbers = [F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)]
    named = df.select(*keys, *[c.alias(f"_o{i}") for i, c in enumerate(F.col(o) if isinstance(o, str) else o for o in order)], *numbers)
    frames = Frames(named, keys, [f"_o{i}" for i in range(len(order))], before=lags - 1, after=horizon, position="_at")
    rows = frames.with_groups(frames.df)
    schema = T.StructType([
        *[T.StructField(f"k{i}", named.schema[k].dataType) for i, k in enumerate(keys)],
        T.StructField("chunk", T.LongType()), T.StructField("rows", T.LongType()),
        T.StructField("factor", T.BinaryType()), T.StructField("newest", T.BinaryType()),
    ])
    size = len(columns)

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("_at")
        values = np.column_stack([group[f"_v{i}"].to_numpy().astype(float) for i in range(size)])
        home = group["_home"].to_numpy()
        used, factor = design_factor(values, home, lags, horizon)
        newest = None
        if home[-1] and len(values) >= lags:  # no row follows: the end of the series
            newest = np.ascontiguousarray(values[-lags:][::-1].T).tobytes()
        own = [group[k].slice(0, 1).combine_chunks() for k in keys]
        made = [group["_chunk"].slice(0, 1).combine_chunks(), pa.array([used]), pa.array([factor.tobytes()], pa.binary()), pa.array([newest], pa.binary())]
        return pa.Table.from_arrays([*own, *made], schema.names)

    kept = rows.select(*keys, "_chunk", "_home", "_at", *[f"_v{i}" for i in range(size)])
    return kept.groupBy(*keys, "_chunk").applyInArrow(work, schema), frames.most_chunks


def _fold_tree(factors: DataFrame, names: Sequence[str], width: int, chunks: int) -> DataFrame:
    schema = factors.schema

    def merge(group: pa.Table) -> pa.Table:
        total, factor, newest = 0, np.zeros((0, width)), None
        group = group.sort_by("chunk")
        for rows, own, last in zip(group["rows"].to_pylist(), group["factor"].to_pylist(), group["newest"].to_pylist()):
            total, newest = total + rows, newest if last is None else last
            if len(own):
                factor = fold(factor, np.frombuffer(own).reshape(-1, width))
        keys = [group[k].slice(0, 1).combine_chunks() for k in names]
        made = [pa.array([group["chunk"][0].as_py() // FAN_IN]), pa.array([total]), pa.array([factor.tobytes()], pa.binary()), pa.array([newest], pa.binary())]
        return pa.Table.from_arrays([*keys, *made], schema.names)

    while chunks > 1:
        factors = factors.groupBy(*names, F.floor(F.col("chunk") / FAN_IN)).applyInArrow(merge, schema)
        chunks = math.ceil(chunks / FAN_IN)
    return factors


def horizon_forecast(
    df: DataFrame, keys: Sequence[str], order: Order, columns: Sequence[str], lags: int, horizon: int
) -> DataFrame:
    """Forecasts of every column for steps 1 to ``horizon`` past the end of each series.

    One linear model with intercept per (series, column, step) over the last ``lags`` values of all
    columns, fitted to the windows that have all lags and all steps and no missing value. Rows ``keys``,
    ``column``, ``h``, ``predicted``, ``rows`` (of the fit) and ``sse``. ``predicted`` and ``sse`` are
    null if the features determine each other or there are fewer windows than weights; ``predicted``
    also if the series ends with a missing value among its last lags. Series shorter than ``lags`` give
    nulls as well.
    """
    if lags < 1 or horizon < 1 or not columns:
        raise ValueError("at least one column, lag and step is needed")
    size, features = len(columns), 1 + len(columns) * lags
    width = features + size * horizon
    names = [f"k{i}" for i in range(len(keys))]
    factors, chunks = _factors(df, keys, order, columns, lags, horizon)
    whole = _fold_tree(factors, names, width, chunks)
    schema = T.StructType([
        *[whole.schema[k] for k in names], T.StructField("column", T.StringType()), T.StructField("h", T.IntegerType()),
        T.StructField("predicted", T.DoubleType()), T.StructField("rows", T.LongType()), T.StructField("sse", T.DoubleType()),
    ])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, factor, newest = (batch.column(c)[i].as_py() for c in ("rows", "factor", "newest"))
                square = np.zeros((width, width))
                held = np.frombuffer(factor).reshape(-1, width)
                square[: len(held)] = held
                weights, sse, _ = solve_factor(square, features)
                last = np.full(features - 1, np.nan) if newest is None else np.frombuffer(newest)
                guess = weights[0] + last @ weights[1:]
                steps = size * horizon
                own = [batch.column(k).take(pa.array([i] * steps)) for k in names]
                made = [
                    pa.array(np.repeat(list(columns), horizon)), pa.array(np.tile(np.arange(1, horizon + 1, dtype=np.int32), size)),
                    pa.array(guess, from_pandas=True), pa.array([rows] * steps, pa.int64()), pa.array(sse, from_pandas=True),
                ]
                yield pa.RecordBatch.from_arrays([*own, *made], schema.names)

    slim = whole.select(*names, "rows", "factor", "newest")
    return slim.mapInArrow(solve, schema).toDF(*keys, "column", "h", "predicted", "rows", "sse")

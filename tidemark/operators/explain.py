"""Which slices of a series drive a classifier: perturb, score, fit a local linear model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.forecast import least_squares

# Distance factor, kernel width and penalty of the local model.
DISTANCE_FACTOR, KERNEL_WIDTH, RIDGE = 100.0, 25.0, 1.0


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers from consecutive ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def perturbed(
    df: DataFrame,
    series: str,
    id_column: str,
    slices: int,
    samples: int,
    seed: int = 0,
    replacement: str = "total_mean",
) -> DataFrame:
    """``samples`` variants of each series with some slices switched off.

    Adds ``sample`` and ``mask`` (1 = slice kept) and replaces ``series``. Sample 0
    is the series itself. Draws follow from a hash of the id, so a task that runs
    again draws the same ones. Switched-off values become the mean of the series
    (``total_mean``) or noise inside its range (``noise``).
    """
    if replacement not in ("total_mean", "noise"):
        raise ValueError(f"unknown replacement {replacement!r}")
    # One row becomes many: spread the rows first, whatever files they came from.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(tasks, id_column).withColumn(
        "_seed", F.xxhash64(id_column, F.lit(seed))
    )
    rest = [c for c in df.columns if c != series]

    def draw(start: int, width: int, stream: int) -> np.ndarray:
        """A (samples, width) matrix of pseudo-random 64-bit numbers."""
        at = np.arange(samples * width, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        base = _mixed(np.array([(start + stream) % 2**64], dtype=np.uint64))
        return _mixed(at + base).reshape(samples, width)

    def variants(values: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        rank = draw(start, slices, 1).argsort(axis=1).argsort(axis=1)
        off = 1 + draw(start, 1, 2) % np.uint64(slices)
        off[0] = 0
        mask = (rank >= off.astype(int)).astype(float)
        width = -(-len(values) // slices)
        kept = mask[:, np.arange(len(values)) // width] == 1.0
        if replacement == "noise":
            unit = draw(start, len(values), 3) / 2.0**64
            fill = values.min() + (values.max() - values.min()) * unit
        else:
            fill = np.full((samples, len(values)), values.mean())
        return mask, np.where(kept, values, fill)

    def vary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, 8192 // samples)
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                masks, changed = [], []
                for values, start in zip(part[series], part["_seed"]):
                    mask, new = variants(np.asarray(values, dtype=float), int(start))
                    masks.extend(mask)
                    changed.extend(new)
                out = {c: np.repeat(part[c].to_numpy(), samples) for c in rest}
                out["sample"] = np.tile(np.arange(samples), len(part))
                yield pd.DataFrame({**out, "mask": masks, series: changed})

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema]
    return rows.mapInPandas(
        vary, ", ".join([*schema, "sample int, mask array<double>", f"`{series}` array<double>"])
    )


def slice_weights(
    df: DataFrame,
    id_column: str,
    series: str,
    score: Callable[[DataFrame], DataFrame],
    slices: int = 24,
    samples: int = 1000,
    top: int = 10,
    seed: int = 0,
    replacement: str = "total_mean",
) -> DataFrame:
    """The ``top`` slices by absolute weight for each series.

    ``score`` takes the perturbed rows and adds a column ``score``, for instance a
    class probability. Samples are weighted by their closeness to the series
    (cosine distance of the masks); the local model is a ridge fit from sums.
    """
    rows = score(perturbed(df, series, id_column, slices, samples, seed, replacement))
    kept = F.aggregate("mask", F.lit(0.0), lambda a, v: a + v)
    distance = (1 - F.sqrt(kept / F.lit(float(slices)))) * DISTANCE_FACTOR
    near = F.sqrt(F.exp(-(distance * distance) / F.lit(KERNEL_WIDTH**2)))
    names = [f"_m{i}" for i in range(slices)]
    flat = rows.select(
        id_column,
        F.col("score").cast("double").alias("_score"),
        near.alias("_near"),
        *[F.get("mask", F.lit(i)).alias(n) for i, n in enumerate(names)],
    )
    model = least_squares(flat, [id_column], names, "_score", weight="_near", ridge=RIDGE)
    weights = model.select(
        id_column, F.posexplode(F.slice("weights", 2, slices)).alias("slice", "weight")
    )
    ranked = Window.partitionBy(id_column).orderBy(F.desc(F.abs("weight")), "slice")
    return (
        weights.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= top)
        .select(id_column, "rank", "slice", "weight")
    )

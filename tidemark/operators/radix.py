"""Exact quantiles of many columns of a table by radix selection.

Doubles become unsigned keys of the same order. The first pass counts the leading bits of the keys of all
columns; the cells that hold the wanted ranks are looked up in the running counts, and each further pass
counts the next bits of the keys inside those cells only. Four scans find every rank of every column,
however many there are: no sort, no shuffle of rows, and no job per column. A task sends one count per
cell it has met; the driver gets one row per wanted rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BITS = 16  # of a key that one pass resolves
PASSES = 64 // BITS
CELLS = 1 << BITS


def ordered_keys(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the numbers; NaN is the largest, both zeros are equal."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    bits = x.view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def from_key(key: int) -> float:
    bits = key & ~(1 << 63) if key >> 63 else ~key & (2**64 - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _counts(prefixes: list[list[int]], done: int):
    """(column, prefix, cell, n): keys whose first ``done`` bits are one of the column's prefixes, by their next bits."""
    known = [np.array(sorted(p), np.uint64) for p in prefixes]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(len(p) * CELLS, np.int64) for p in known]
        for batch in batches:
            for i, own in enumerate(known):
                if not len(own):
                    continue
                key = ordered_keys(batch.column(i).drop_null().to_numpy(zero_copy_only=False).astype(np.float64))
                if done:
                    prefix = key >> np.uint64(64 - done)
                    at = np.minimum(np.searchsorted(own, prefix), len(own) - 1)
                    inside = own[at] == prefix
                    key, at = key[inside], at[inside]
                else:
                    at = np.zeros(len(key), np.int64)
                cell = (key >> np.uint64(64 - done - BITS)) & np.uint64(CELLS - 1)
                held[i] += np.bincount(at * CELLS + cell.astype(np.int64), minlength=len(held[i]))
        for i, counts in enumerate(held):
            met = np.flatnonzero(counts)
            if len(met):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(met), i, np.int32)), pa.array(known[i][met // CELLS].astype(np.int64)), pa.array((met % CELLS).astype(np.int32)), pa.array(counts[met])],
                    ["column", "prefix", "cell", "n"],
                )

    return work


def select_ranks(df: DataFrame, columns: Sequence[str], ranks_of) -> list[dict[int, float]]:
    """Per column: rank (from 0) to value, for the ranks that ``ranks_of(number of values)`` names."""
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    prefixes: list[list[int]] = [[0] for _ in columns]
    # column -> rank -> (prefix found so far, rank inside it)
    found: list[dict[int, tuple[int, int]]] = [{} for _ in columns]
    for turn in range(PASSES):
        cells = numbers.mapInArrow(_counts(prefixes, turn * BITS), "column int, prefix long, cell int, n long")
        cells = cells.groupBy("column", "prefix", "cell").agg(F.sum("n").alias("n"))
        group = Window.partitionBy("column", "prefix")
        upto = group.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        if turn == 0:
            cells = cells.persist()
            for r in cells.groupBy("column").agg(F.sum("n").alias("n")).collect():
                found[r["column"]] = {rank: (0, rank) for rank in ranks_of(r["n"])}
        asked = sorted({(i, p, rank) for i, own in enumerate(found) for p, rank in own.values()})
        if not asked:
            break
        asks = df.sparkSession.createDataFrame(asked, "column int, prefix long, rank long")
        hit = cells.join(F.broadcast(asks), ["column", "prefix"])  # a row per wanted rank
        hit = hit.filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
        step = {(r["column"], r["prefix"], r["rank"]): (r["cell"], r["rank"] - r["before"]) for r in hit.collect()}
        if turn == 0:
            cells.unpersist()
        for i, own in enumerate(found):
            for rank, (p, inside) in own.items():
                cell, inside = step[i, p, inside]
                own[rank] = ((_unsigned(p) << BITS | cell) if turn else cell, inside)
            prefixes[i] = sorted({p for p, _ in own.values()})
        # prefixes travel as longs
        found = [{rank: (_signed(p), inside) for rank, (p, inside) in own.items()} for own in found]
    return [{rank: from_key(_unsigned(p)) for rank, (p, _) in own.items()} for own in found]


def _signed(p: int) -> int:
    return p - (1 << 64) if p >= 1 << 63 else p


def _unsigned(p: int) -> int:
    return p + (1 << 64) if p < 0 else p


def table_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> list[list[float | None]]:
    """Exact linear-interpolated quantiles of each column; nulls are left out, NaN is the largest value.

    A column without values gives None for each of ``probs``."""

    def spots(n: int) -> list[float]:
        return [p * (n - 1) for p in probs]

    def ranks_of(n: int) -> set[int]:
        return {r for s in spots(n) for r in (math.floor(s), math.ceil(s))}

    out: list[list[float | None]] = []
    for own in select_ranks(df, columns, lambda n: ranks_of(n) | {n - 1}):
        if not own:
            out.append([None] * len(probs))
            continue
        n = max(own) + 1
        out.append([own[math.floor(s)] * (1 - (s - math.floor(s))) + own[math.ceil(s)] * (s - math.floor(s)) if s != math.floor(s) else own[int(s)] for s in spots(n)])
    return out

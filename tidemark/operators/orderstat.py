"""Order statistics of sliding windows: median and median absolute deviation.

Rows pass in order, series after series, in Arrow batches. Narrow windows of many series are sorted side by
side as rows of one matrix. A wide window slides over a sorted list: a row enters and leaves by binary
search, the median is read in place, and the median deviation is selected from the two sorted runs of
deviations to either side of it, so a row costs the logarithm of the width and no window is sorted twice.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import Frames, Order

NARROW = 64  # widest window that is sorted as a matrix row
CELLS = 1 << 21  # numbers of window matrices held at once


class SortedWindow:
    """The values of a window, sorted."""

    def __init__(self) -> None:
        self.items: list[float] = []

    def add(self, x: float) -> None:
        insort(self.items, x)

    def remove(self, x: float) -> None:
        del self.items[bisect_left(self.items, x)]

    def median(self) -> float:
        n = len(self.items)
        return (self.items[(n - 1) // 2] + self.items[n // 2]) / 2 if n else np.nan

    def _deviation(self, middle: float, split: int, rank: int) -> float:
        """The deviation from ``middle`` of this rank (from 0); items before ``split`` are smaller than it."""
        items, n = self.items, len(self.items)
        low, high = max(0, rank + 1 - (n - split)), min(split, rank + 1)  # taken from the left run
        while low < high:
            left = (low + high) // 2
            # too few from the left, if its next deviation is smaller than the last one taken from the right
            if middle - items[split - 1 - left] < items[split + rank - left] - middle:
                low = left + 1
            else:
                high = left
        right = rank + 1 - low
        best = -np.inf
        if low:
            best = middle - items[split - low]
        if right:
            best = max(best, items[split + right - 1] - middle)
        return best

    def mad(self) -> float:
        n = len(self.items)
        if not n:
            return np.nan
        middle = self.median()
        split = bisect_left(self.items, middle)
        return (self._deviation(middle, split, (n - 1) // 2) + self._deviation(middle, split, n // 2)) / 2


def _wide(x: np.ndarray, first: np.ndarray, last: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    median, mad = np.full(len(x), np.nan), np.full(len(x), np.nan)
    values = x.tolist()
    for start in np.unique(first).tolist():
        stop = int(last[start])
        window = SortedWindow()
        entered, gone = start, start
        for i in range(start, stop):
            while entered < min(stop, i + after + 1):
                if values[entered] == values[entered]:
                    window.add(values[entered])
                entered += 1
            while gone < i - before:
                if values[gone] == values[gone]:
                    window.remove(values[gone])
                gone += 1
            median[i], mad[i] = window.median(), window.mad()
    return median, mad


def _middle(ordered: np.ndarray, count: np.ndarray) -> np.ndarray:
    low = np.take_along_axis(ordered, np.maximum((count - 1) // 2, 0)[:, None], 1)[:, 0]
    high = np.take_along_axis(ordered, np.minimum(count // 2, ordered.shape[1] - 1)[:, None], 1)[:, 0]
    return np.where(count > 0, (low + high) / 2, np.nan)


def _narrow(x: np.ndarray, first: np.ndarray, last: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    width = before + after + 1
    median, mad = np.empty(len(x)), np.empty(len(x))
    padded = np.concatenate([np.full(before, np.nan), x, np.full(after, np.nan)])
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    step = max(1, CELLS // width)
    for at in range(0, len(x), step):
        rows = np.arange(at, min(len(x), at + step))
        place = rows[:, None] + np.arange(-before, after + 1)
        own = np.where((place >= first[rows, None]) & (place < last[rows, None]), view[rows], np.nan)
        own.sort(axis=1)
        count = (own == own).sum(axis=1)
        median[rows] = _middle(own, count)
        with np.errstate(invalid="ignore"):
            own = np.abs(own - median[rows, None])
        own.sort(axis=1)
        mad[rows] = _middle(own, count)
    return median, mad


def median_mad(x: np.ndarray, first: np.ndarray, last: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Median and MAD of the values from ``before`` rows ahead to ``after`` rows behind each row.

    The series of a row is ``first`` (inclusive) to ``last`` (exclusive); NaN is left out."""
    return (_narrow if before + after + 1 <= NARROW else _wide)(x, first, last, before, after)


def rolling_median_mad(
    df: DataFrame, keys: Sequence[str], order: Order, value: str, before: int, after: int, around: int
) -> DataFrame:
    """Add ``median``, ``mad``, ``rows_in_window``, ``nulls_in_window`` and ``rows_around``.

    The window is rows [i - ``before``, i + ``after``]; ``rows_around`` counts [i - ``around``, i + ``around``].
    """
    frames = Frames(df, keys, order, before=max(before, around), after=max(after, around), position="_at")
    rows = frames.with_groups(frames.df)
    if frames.most_chunks > 1:
        rows = rows.repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", "_at")
    else:
        rows = rows.sortWithinPartitions(*keys, *order)  # the order of the numbering: no second sort
    # not deterministic: no filter may move below it, as it reads whole series
    stats = F.pandas_udf(_stats(before, after, around), _STATS).asNondeterministic()
    rows = rows.withColumn("_stats", stats(F.col(value).cast("double"), "_at", "_chunk")).filter("_home")
    return rows.select(*df.columns, "_stats.*")


_STATS = "median double, mad double, rows_in_window long, nulls_in_window long, rows_around long"


def _stats(before: int, after: int, around: int):
    """One result per row, in the order of the rows; a series is complete when the next one begins."""

    def of_whole(x: np.ndarray, begins: np.ndarray) -> pd.DataFrame:
        ends = np.append(begins[1:], len(x))
        first, last = np.repeat(begins, ends - begins), np.repeat(ends, ends - begins)
        median, mad = median_mad(x, first, last, before, after)
        i = np.arange(len(x))
        low, high = np.maximum(first, i - before), np.minimum(last, i + after + 1)
        missing = np.concatenate([[0], np.cumsum(np.isnan(x))])
        near = np.minimum(last, i + around + 1) - np.maximum(first, i - around)
        return pd.DataFrame({
            "median": median, "mad": mad, "rows_in_window": high - low,
            "nulls_in_window": missing[high] - missing[low], "rows_around": near,
        })

    def work(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []  # of the newest series, which may go on
        starts: list[int] = []
        size, ended = 0, None  # position and chunk of the row before
        for value, position, chunk in batches:
            x, at, own = value.to_numpy(float), position.to_numpy(), chunk.to_numpy()
            if not len(x):
                continue
            fresh = np.ones(len(at), bool)
            fresh[1:] = (np.diff(at) != 1) | (np.diff(own) != 0)
            fresh[0] = ended != (at[0] - 1, own[0])
            ended = (at[-1], own[-1])
            begins = np.flatnonzero(fresh)
            starts += (begins + size).tolist()
            held.append(x)
            size += len(x)
            if len(begins) and starts[-1]:
                every, done = np.concatenate(held), starts[-1]
                yield of_whole(every[:done], np.array(starts[:-1]))
                held, starts, size = [every[done:]], [0], size - done
        if size:
            yield of_whole(np.concatenate(held), np.array(starts))

    return work

"""Row windows over a stream, with the last rows of every series as keyed state.

Series are dealt by a hash of their key into ``BUCKETS`` buckets, which are what Spark groups by, so that a
worker handles all series of a bucket as one block of columns. The state of a bucket is a map (RocksDB)
from series to the newest ``before`` rows of each; a batch reads and writes only the series it has rows of,
and what a batch costs does not depend on how many series there are. Rows of a batch are put in the stated
order, behind the rows kept, and handed to ``compute``. Rows that are not after the newest row of their
series are late; they come out with ``late`` set and change nothing. With ``idle`` an event-time timer drops
the state of a series once the watermark is that far past its newest row.

A task holds the rows that one batch has of a bucket, no more; ``sources`` bounds batches by files.
Not-a-number counts as missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidemark.streaming.run import _start

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Earlier rows and new rows of one series, in order; the number of earlier rows; returns one row per new row.
#: Of a ``whole`` bucket: those of one series after the other; the place of every row in its series, from 0;
#: returns one row per row.
Compute = Callable[[pd.DataFrame, Any], pd.DataFrame]

BUCKETS = 1_024

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _plain(x: Any) -> Any:
    """A value that the state takes; the two zeros are one key."""
    if x is pd.NA or x is pd.NaT:
        return None
    x = x.item() if isinstance(x, np.generic) else x
    return x + 0.0 if isinstance(x, float) else x


class LastRows(StatefulProcessor):
    """Keeps the newest ``before`` rows of the series of a bucket and computes over them and the new ones."""

    def __init__(
        self, keys: T.StructType, order: Sequence[str], before: int, schema: T.StructType, out: T.StructType, compute: Compute, whole: bool, idle_ms: int | None
    ):
        self.keys, self.order, self.before, self.schema, self.out = keys, list(order), before, schema, out
        self.compute, self.whole, self.idle_ms, self.buckets = compute, whole, idle_ms, BUCKETS

    def init(self, handle: Any) -> None:
        self.handle = handle
        rows = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in self.schema.fields])
        self.rows = handle.getMapState("rows", self.keys, rows)

    def _columns(self, rows: pd.DataFrame) -> pd.DataFrame:
        """``rows`` with exact integers, whatever is missing."""
        whole = [f.name for f in self.schema.fields if isinstance(f.dataType, INTEGERS)]
        for name in whole:
            gone = rows.pop(_gone(name)).to_numpy(bool)
            if gone.any():
                rows[name] = pd.arrays.IntegerArray(rows[name].to_numpy(np.int64), gone)
        return rows

    def _series(self, key: Any, rows: pd.DataFrame) -> tuple[np.ndarray, list[tuple]]:
        """The number of each row's series, and the keys of the series."""
        names = self.keys.names
        codes = rows.groupby(names, dropna=False, sort=False).ngroup().to_numpy()
        first = np.unique(codes, return_index=True)[1]
        null = int(key[0]) // self.buckets
        own = [[None] * len(first) if null >> i & 1 else [_plain(x) for x in rows[name].iloc[first].tolist()] for i, name in enumerate(names)]
        return codes, list(zip(*own))

    def _kept(self, keys: list[tuple]) -> tuple[pd.DataFrame, np.ndarray]:
        """The rows kept of these series, one series after the other, and how many there are of each."""
        found = [self.rows.getValue(k) for k in keys]
        counts = np.array([len(f[0]) if f is not None else 0 for f in found], np.int64)
        columns = {}
        for i, f in enumerate(self.schema.fields):
            values = [x for row in found if row is not None for x in row[i]]
            if isinstance(f.dataType, INTEGERS):
                gone = np.array([x is None for x in values], bool)
                exact = np.array([0 if x is None else x for x in values], np.int64)
                columns[f.name] = pd.arrays.IntegerArray(exact, gone) if gone.any() else exact
            else:
                columns[f.name] = values
        return pd.DataFrame(columns, columns=self.schema.names), counts

    def _sorted(self, rows: pd.DataFrame, codes: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
        """By series, then by the stated order, missing last, then by arrival."""
        by: list[np.ndarray] = []
        for name in reversed(self.order):
            gone = rows[name].isna().to_numpy()
            by += [rows[name].fillna(0).to_numpy(), gone]
        at = np.lexsort([*by, codes])
        return rows.iloc[at].reset_index(drop=True), codes[at]

    def _late(self, rows: pd.DataFrame, codes: np.ndarray, kept: pd.DataFrame, counts: np.ndarray) -> np.ndarray:
        """Whether a row is not after the last row kept of its series."""
        late = np.zeros(len(rows), bool)
        at = np.flatnonzero(counts[codes] > 0)
        if len(at):
            last = (np.cumsum(counts) - 1)[codes[at]]
            same = np.ones(len(at), bool)
            before = np.zeros(len(at), bool)
            for name in self.order:
                new, old = rows[name].iloc[at].reset_index(drop=True), kept[name].iloc[last].reset_index(drop=True)
                before |= same & (new < old).fillna(False).to_numpy(bool)
                same &= (new == old).fillna(False).to_numpy(bool)
            late[at] = before | same
        return late

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = self.schema.names
        new = self._columns(pd.concat(list(rows), ignore_index=True))
        for i, name in enumerate(self.keys.names):
            if int(key[0]) // self.buckets >> i & 1:
                new[name] = None
        codes, keys = self._series(key, new)
        kept, counts = self._kept(keys)
        new, codes = self._sorted(new, codes)
        late = self._late(new, codes, kept, counts)
        if late.any():
            yield self._shaped(new[late], True)
        fresh, codes = new[~late].reset_index(drop=True), codes[~late]
        if not len(fresh):
            return
        # series without fresh rows are left alone
        held = np.repeat(np.arange(len(keys)), counts)
        used = np.isin(held, codes)
        every = pd.concat([kept[used], fresh[names]], ignore_index=True) if used.any() else fresh[names]
        both = np.concatenate([held[used], codes])
        at = np.argsort(both, kind="stable")
        every, both, known = every.iloc[at].reset_index(drop=True), both[at], at < used.sum()
        start = np.flatnonzero(np.diff(both, prepend=-1))
        end = np.append(start[1:], len(both))
        if self.whole:
            made = self.compute(every, np.arange(len(both)) - np.repeat(start, end - start))[~known]
        else:
            parts = [self.compute(every.iloc[a:b].reset_index(drop=True), int(known[a:b].sum())) for a, b in zip(start, end)]
            made = pd.concat(parts, ignore_index=True)
        yield self._shaped(pd.concat([fresh, made.reset_index(drop=True)], axis=1), False)
        lists = [[_plain(x) for x in every[n].tolist()] for n in names]
        for a, b in zip(start, end):
            a = max(a, b - max(self.before, 1))  # one row at least, to tell late rows
            self.rows.updateValue(keys[both[a]], tuple(x[a:b] for x in lists))
        if self.idle_ms is not None:
            first = lists[names.index(self.order[0])]
            self._wake(min(self._expires(first[b - 1]) for b in end))

    def _expires(self, newest: int) -> int:
        return int(newest) // 1000 + self.idle_ms

    def _wake(self, at: int) -> None:
        """See that a timer of the bucket goes off at ``at`` or before."""
        set_at = list(self.handle.listTimers())
        if not set_at or at < min(set_at):
            for other in set_at:
                self.handle.deleteTimer(other)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Drop the idle series of the bucket and wait for the next one."""
        now = expiredTimerInfo.getExpiryTimeInMs()
        now = max(now, timerValues.getCurrentWatermarkInMs())
        at = self.schema.names.index(self.order[0])
        found = [(tuple(k), self._expires(v[at][-1])) for k, v in self.rows.iterator()]
        for k, expires in found:
            if expires <= now:
                self.rows.removeKey(k)
        left = [expires for _, expires in found if expires > now]
        if left:
            self.handle.registerTimer(min(left))
        return iter(())

    def _shaped(self, rows: pd.DataFrame, late: bool) -> pd.DataFrame:
        rows = rows.assign(late=late)
        return pd.DataFrame({f.name: rows[f.name] if f.name in rows else None for f in self.out.fields}).astype(object)

    def close(self) -> None:
        pass


def _gone(name: str) -> str:
    """Workers rename columns that begin with an underscore."""
    return f"{name}__gone"


def row_windows(
    stream: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: int,
    compute: Compute,
    made: str,
    ts: str | None = None,
    delay: str | None = None,
    idle_ms: int | None = None,
    whole: bool = False,
) -> DataFrame:
    """The rows of ``stream`` with the columns ``made`` (a schema string) that ``compute`` returns, and ``late``.

    With ``whole`` it is called once for all series of a bucket, else once per series (see ``Compute``).
    ``order`` must be numbers; a leading timestamp goes in as microseconds. ``idle_ms`` needs that, and
    an event-time column ``ts`` with a watermark ``delay``.
    """
    use_rocksdb(stream.sparkSession)
    slim = stream if ts is None else stream.withWatermark(ts, delay)
    kept = [f for f in stream.schema.fields if f.name not in keys and f.name != ts]
    added = T._parse_datatype_string(made)
    out = T.StructType([*[stream.schema[k] for k in keys], *[T.StructField(f.name, f.dataType) for f in kept], *added.fields, T.StructField("late", T.BooleanType())])
    state = T.StructType([T.StructField(f.name, f.dataType) for f in kept])
    own = T.StructType([stream.schema[k] for k in keys])
    # which keys are null is part of the bucket; whole numbers go to the workers without nulls, which would make them floats
    null = sum((F.col(k).isNull().cast("int") * F.lit(1 << i) for i, k in enumerate(keys)), F.lit(0))
    dealt = slim.withColumn("bucket__", null * F.lit(BUCKETS) + F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    whole_numbers = [f for f in [*own.fields, *kept] if isinstance(f.dataType, INTEGERS)]
    flags = {_gone(f.name): F.col(f.name).isNull() for f in whole_numbers if f.name not in keys}
    dealt = dealt.withColumns(flags | {f.name: F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)) for f in whole_numbers})
    job = LastRows(own, order, before, state, out, compute, whole, idle_ms)
    return dealt.groupBy("bucket__").transformWithStateInPandas(
        statefulProcessor=job, outputStructType=out, outputMode="Append", timeMode="EventTime" if idle_ms is not None else "None"
    )


def use_rocksdb(spark: SparkSession) -> None:
    """List state and timers need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def start_with_late(
    result: DataFrame, out: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df, every: str | None = None
) -> StreamingQuery:
    """Write ``shape(rows)`` of each batch to ``out/batch_id=<id>`` and its late rows to ``out/late/batch_id=<id>``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            where = f"batch_id={batch_id}"
            shape(batch.filter("NOT late").drop("late")).write.mode("overwrite").parquet(f"{out}/{where}")
            batch.filter("late").drop("late").write.mode("overwrite").parquet(f"{out}/late/{where}")
        finally:
            batch.unpersist()

    return _start(result.writeStream.outputMode("append").foreachBatch(write), checkpoint, every)


def in_micros(df: DataFrame, ts: str) -> DataFrame:
    """``ts`` (zone-less ones as UTC wall time) as microseconds."""
    return df.withColumn(ts, F.unix_micros(F.col(ts).cast("timestamp")))


def from_micros(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn(ts, F.timestamp_micros(ts).cast("timestamp_ntz"))


def sliding(values: np.ndarray, width: int, reducer: Callable[..., np.ndarray], place: np.ndarray | None = None) -> np.ndarray:
    """``reducer`` (along the last axis, blind to NaN) of each value and the ``width`` - 1 before it.

    ``place`` holds the place of each value in its series, if there are several one after the other."""
    padded = np.concatenate([np.full(width - 1, np.nan), values.astype(float)])
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    if place is not None:
        view = np.where(np.arange(width)[::-1] <= place[:, None], view, np.nan)
    return reducer(view, axis=-1)

"""Running totals of a stream as a keyed table of base and delta files.

A batch is aggregated on its own and written as a delta; no state is read or rewritten for it. Every
``merge_every`` batches the base and the deltas since are merged into a new base. What makes up the totals
after a batch stands in a manifest, which is written last: readers take the newest manifest and never see
half a batch. Paths are reused in rings (two bases, twice ``merge_every`` deltas and manifests), so the
folder is bounded by the distinct keys, however long the stream runs, and a reader has ``merge_every``
batches of time before what its manifest names is overwritten. A batch that runs again writes the same
files from the same files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.streaming.run import _start

MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


class RunningTotals:
    """``aggs``: name to (merge rule, aggregate of a batch), like ``{"n": ("sum", F.count(F.lit(1)))}``."""

    def __init__(
        self, spark: SparkSession, folder: str, keys: Sequence[str], aggs: Mapping[str, tuple[str, Column]], merge_every: int = 16
    ) -> None:
        if merge_every < 1 or not keys or any(rule not in MERGE for rule, _ in aggs.values()):
            raise ValueError("keys, a positive merge_every and the rules sum, min or max are needed")
        self.spark, self.folder, self.keys, self.aggs, self.merge_every = spark, folder, list(keys), dict(aggs), merge_every

    def _delta(self, batch: int) -> str:
        return f"{self.folder}/delta/slot-{batch % (2 * self.merge_every)}"

    def _base(self, batch: int) -> str:
        """The base that holds all batches up to the last multiple of ``merge_every`` at or before ``batch``."""
        return f"{self.folder}/base/slot-{batch // self.merge_every % 2}"

    def paths(self, batch: int) -> list[str]:
        """What the totals after ``batch`` (from 0) are made of."""
        done = batch + 1
        merged = done - done % self.merge_every
        base = [self._base(merged)] if merged else []
        return base + [self._delta(b) for b in range(merged, done)]

    def _merged(self, paths: Sequence[str]) -> DataFrame:
        rows = self.spark.read.parquet(*paths)
        return rows.groupBy(*self.keys).agg(*[MERGE[rule](name).alias(name) for name, (rule, _) in self.aggs.items()])

    def process(self, batch: DataFrame, batch_id: int) -> None:
        delta = batch.groupBy(*self.keys).agg(*[c.alias(name) for name, (_, c) in self.aggs.items()])
        delta.write.mode("overwrite").parquet(self._delta(batch_id))
        done = batch_id + 1
        if done % self.merge_every == 0:
            before = [self._base(done - self.merge_every)] if done > self.merge_every else []
            deltas = [self._delta(b) for b in range(done - self.merge_every, done)]
            self._merged(before + deltas).write.mode("overwrite").parquet(self._base(done))
        manifest = self.spark.createDataFrame([(batch_id, self.paths(batch_id))], "batch_id long, paths array<string>")
        manifest.coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest/slot-{batch_id % (2 * self.merge_every)}")

    def read(self) -> DataFrame:
        """The totals after the newest whole batch; the folder must hold one."""
        found = self.spark.read.schema("batch_id long, paths array<string>").json(f"{self.folder}/manifest/slot-*")
        newest = found.orderBy(F.desc("batch_id")).select("paths").first()
        return self._merged(newest["paths"])

    def start(self, stream: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        return _start(stream.writeStream.foreachBatch(self.process), checkpoint, every)

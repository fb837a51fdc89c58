"""Exact dedup with an extendible-hash index on shared files.

Keys are the 64-bit hashes of the whole texts. A histogram over the leading key bits (a bounded number
of cells) drives the directory: an overfull bucket splits on its next bit, and the directory doubles
when the bucket already uses all its bits. Buckets are contiguous key ranges, one owner task each.

Before anything is shuffled, each batch folds its equal texts into one page entry (text, largest id,
member ids), so a hot text reaches its owner once per batch and not once per copy. The owner reads its
range in key order, keeps the distinct texts of the current key as a collision chain, and compares
bytes with it. A key that cannot be split (copies, or a true collision) just makes its bucket longer;
it is read as a stream. The index (keys, chain numbers, members; no texts) is written to the shared
folder; totals of a chain are summed and joined back to its entries, where AQE splits hot keys.

Null texts count as empty, and all empty texts are one group. Of equal texts the row with the largest
id stays; null ids are smaller than any id. Of repeated rows (same id and text) exactly one is kept.
An empty table gives an empty result. Only ``id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import scratch

BUCKET_BYTES = 8 << 20  # text of a bucket before it splits
FIRST_BITS = 12  # leading bits of the first histogram
MOST_BITS = 20  # of the largest histogram, which bounds the directory
ROWS_OUT = 2_000


@dataclass
class Directory:
    """Extendible hashing over leading bits: 2**depth slots, each naming a bucket."""

    bits: int
    weights: np.ndarray  # bytes per cell of ``bits`` leading bits
    depth: int = 0
    slots: list[int] = field(default_factory=lambda: [0])
    local: list[tuple[int, int]] = field(default_factory=lambda: [(0, 0)])  # (prefix, depth) of a bucket

    def __post_init__(self) -> None:
        self._sums = np.concatenate([[0], np.cumsum(self.weights)])

    def weight(self, bucket: int) -> int:
        prefix, depth = self.local[bucket]
        width = self.bits - depth
        return int(self._sums[(prefix + 1) << width] - self._sums[prefix << width])

    def double(self) -> None:
        self.slots = [b for b in self.slots for _ in range(2)]
        self.depth += 1

    def split(self, bucket: int) -> int:
        prefix, depth = self.local[bucket]
        if depth == self.depth:
            self.double()
        new = len(self.local)
        self.local[bucket] = (prefix << 1, depth + 1)
        self.local.append((prefix << 1 | 1, depth + 1))
        width = self.depth - depth - 1
        start = (prefix << 1 | 1) << width
        self.slots[start : start + (1 << width)] = [new] * (1 << width)
        return new

    def grow(self, capacity: int) -> Directory:
        """Split until every bucket holds at most ``capacity`` or has used all bits."""
        todo = [0]
        while todo:
            bucket = todo.pop()
            if self.weight(bucket) > capacity and self.local[bucket][1] < self.bits:
                todo += [bucket, self.split(bucket)]
        return self


def build_directory(keyed: DataFrame, capacity: int = BUCKET_BYTES) -> Directory:
    """The directory for ``keyed`` (key, text); at most 2**MOST_BITS sums reach the driver."""
    bits = FIRST_BITS
    while True:
        cell = F.shiftrightunsigned("key", 64 - bits)
        rows = keyed.groupBy(cell.alias("cell")).agg(F.sum(F.octet_length("text") + 8).alias("bytes")).collect()
        weights = np.zeros(1 << bits, np.int64)
        for r in rows:
            weights[r["cell"]] = r["bytes"]
        want = int(np.ceil(np.log2(max(1.0, weights.sum() / capacity)))) + 3
        if want <= bits or bits == MOST_BITS:
            # once the directory is at its bound, buckets grow instead
            return Directory(bits, weights).grow(max(capacity, int(weights.sum()) >> (MOST_BITS - 3)))
        bits = min(want, MOST_BITS)


def _fold(slots: np.ndarray, depth: int):
    """Fold the equal texts of a batch into one entry each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            found: dict[bytes, list[int]] = {}
            for row, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                found.setdefault(text, []).append(row)
            entries = list(found.items())
            for at in range(0, len(entries), ROWS_OUT):
                part = entries[at : at + ROWS_OUT]
                key = keys[[rows[0] for _, rows in part]]
                slot = key.view(np.uint64) >> np.uint64(64 - depth) if depth else np.zeros(len(key), np.uint64)
                members = [[ids[r] for r in rows] for _, rows in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slots[slot.astype(np.int64)], pa.int32()),
                        pa.array(key),
                        pa.array([t for t, _ in part], pa.binary()),
                        pa.array([hashlib.sha256(t).hexdigest() for t, _ in part]),
                        pa.array(range(page, page + len(part)), pa.int64()),
                        pa.array(members, pa.list_(pa.int64())),
                    ],
                    ["bucket", "key", "text", "sha", "page", "members"],
                )
                page += len(part)

    return work


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner: number the distinct texts of each key; entries arrive in key order."""
    current, chain = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_OUT):
            part = batch.slice(at, ROWS_OUT)
            numbers = []
            for key, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                if key != current:
                    current, chain = key, []
                number = next((i for i, known in enumerate(chain) if known == text), len(chain))
                if number == len(chain):
                    chain.append(text)
                numbers.append(number)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(numbers, pa.int32()), *part.columns[3:]],
                ["bucket", "key", "chain", "sha", "page", "members"],
            )


def build_index(df: DataFrame, id: str = "doc_id", text: str = "text", key=None, capacity: int = BUCKET_BYTES) -> str:
    """Write the index of ``df`` to the shared folder and return its path."""
    slim = df.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = slim.select("id", (key if key is not None else F.xxhash64("text")).alias("key"), "text")
    directory = build_directory(keyed, capacity)
    slots = np.array(directory.slots, np.int32)
    entries = keyed.mapInArrow(
        _fold(slots, directory.depth),
        "bucket int, key long, text binary, sha string, page long, members array<bigint>",
    )
    owned = entries.repartitionById(len(directory.local), F.col("bucket")).sortWithinPartitions("key")
    index = owned.mapInArrow(
        _chain, "bucket int, key long, chain int, sha string, page long, members array<bigint>"
    )
    path = scratch(df.sparkSession, "exact_index")
    index.write.parquet(path)
    return path


def exact_groups(df: DataFrame, id: str = "doc_id", text: str = "text", **build) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256."""
    index = df.sparkSession.read.parquet(build_index(df, id, text, **build))
    index = index.withColumn("largest", F.array_max("members"))
    totals = index.groupBy("key", "chain").agg(
        F.max("largest").alias("keep_id"),
        F.sum(F.size("members").cast("long")).alias("group_size"),
        F.max_by("page", F.struct("largest", "page")).alias("keep_page"),
    )
    first = F.when(F.col("keep_id").isNull(), 0).otherwise(F.array_position("members", F.col("keep_id")) - 1)
    return (
        index.join(totals, ["key", "chain"])
        .withColumn("keeper", F.when(F.col("page") == F.col("keep_page"), first).otherwise(-1))
        .select("keep_id", "group_size", "keeper", "sha", F.posexplode("members").alias("at", "doc_id"))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("at") == F.col("keeper")).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def drop_copies(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each group of equal texts, all its columns unchanged."""
    kept = exact_groups(df, id, text).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    marked = df.withColumn("__key", sha)
    same = (marked[id].cast("long").eqNullSafe(kept["__id"])) & (marked["__key"] == kept["__sha"])
    # repeated rows share id and text, and all of them meet the kept one
    one = Window.partitionBy("__key", id).orderBy(F.lit(0))
    return (
        marked.join(kept, same, "left_semi")
        .withColumn("__n", F.row_number().over(one))
        .filter("__n = 1")
        .drop("__key", "__n")
    )

"""Exact nearest neighbours by a Voronoi-partitioned join.

Pivots from a bounded sample of the training rows cut both sides into cells, by the nearest pivot. The
training rows nearest to the pivots give every test cell a bound: k of them lie within their distance to
their pivot, plus the way between the pivots, plus the radius of the cell. A training row is then sent
only to cells whose pivot it is within bound plus radius of (triangle inequality), so on clustered data
most cells never see most rows. Where that would send more than ``MOST_COPIES`` copies of a row on average,
as on data spread evenly in many dimensions, all rows are one cell. What meets is cut into blocks: at most
``MOST_BLOCKS`` a side, so that what is shuffled grows with the rows, until blocks reach ``BLOCK_BYTES``. A
meeting goes by tiles in single precision, rechecks what its rounding leaves open in double precision, and
keeps k rows per test row. Copies of a training vector beyond those that can be neighbours are dropped first, so a vector
that a third of all rows share costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import checkpointed

SAMPLE = 4_096  # training rows that pivots are chosen from
MOST_PIVOTS = 512
CELL_ROWS = 256  # training rows per cell that the number of pivots aims at
SLACK = 1e-9  # of distances, for their rounding
MOST_COPIES = 32  # of a row that the cells may ask for, on average
MOST_BLOCKS = 12  # of a side of a cell, as long as they are small
BLOCK_BYTES = 32 << 20  # of the vectors of a block
TILE = 512, 4_096  # test and training rows of a tile


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; slightly off for near-equal vectors, see ``SLACK``."""
    gaps = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(gaps, 0.0))


def slack_of(size: float) -> float:
    """What a distance between vectors of this length may be off by."""
    return 1e-7 * (1.0 + size)


def choose_pivots(x: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first rows of ``x``, until all are covered or there are ``most``."""
    chosen = [0]
    near = distances(x, x[:1])[:, 0]
    while len(chosen) < most and near.max() > slack_of(np.abs(x).max()):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _place(pivots: np.ndarray):
    """(id, label, v, cell, far): the nearest pivot and the distance to it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(matrix(batch.column(2), pivots.shape[1]), pivots)
            cells = d.argmin(axis=1).astype(np.int32) if len(d) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells), pa.array(d[np.arange(len(d)), cells])], ["id", "label", "v", "cell", "far"]
            )

    return work


def _send(pivots: np.ndarray, reach: np.ndarray):
    """(id, label, v, target): each row once for every cell it can hold a neighbour for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                part = batch.slice(at, 2_048)
                row, target = np.nonzero(distances(matrix(part.column(2), pivots.shape[1]), pivots) <= reach)
                for i in range(0, len(row), 4_096):
                    own = part.take(pa.array(row[i : i + 4_096]))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(target[i : i + 4_096].astype(np.int32))], ["id", "label", "v", "target"])

    return work


def reaches(pivots: np.ndarray, radius: np.ndarray, nearest: list[list[float]], k: int) -> np.ndarray:
    """How far from a pivot the k nearest rows of any test row of its cell can lie; -1 for cells without test rows.

    ``radius`` is that of the test rows of a cell (-1: none), ``nearest`` the k least distances of training
    rows to the pivot of their cell."""
    far = np.array([d for own in nearest for d in own])
    cell = np.array([i for i, own in enumerate(nearest) for _ in own], np.int64)
    between = distances(pivots, pivots)
    out = np.full(len(pivots), -1.0)
    slack = slack_of(float(np.abs(pivots).max(initial=0.0)) * pivots.shape[1] ** 0.5 + radius.max(initial=0.0))
    for i in np.flatnonzero(radius >= 0):
        ways = between[i, cell] + far
        bound = np.inf if len(ways) < k else np.partition(ways, k - 1)[k - 1] + radius[i]
        out[i] = bound + radius[i] + 4 * slack
    return out


def _wanted(pivots: np.ndarray, reach: np.ndarray):
    """(target, n): how many of the rows each cell asks for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pivots), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                total += (distances(matrix(batch.slice(at, 2_048).column(0), pivots.shape[1]), pivots) <= reach).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots), dtype=np.int32)), pa.array(total)], ["target", "n"])

    return work


class Best:
    """The k nearest training rows so far of a tile of test rows."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.row, self.column, self.gap, self.id = (np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64))
        self.worst = np.full(n, np.inf)

    def add(self, row: np.ndarray, column: np.ndarray, gap: np.ndarray, ids: np.ndarray) -> None:
        row, column, gap, ids = (np.concatenate(x) for x in ((self.row, row), (self.column, column), (self.gap, gap), (self.id, ids)))
        order = np.lexsort((ids, gap, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        order, row, place = order[place < self.k], row[place < self.k], place[place < self.k]
        self.row, self.column, self.gap, self.id = row, column[order], gap[order], ids[order]
        full = place == self.k - 1
        self.worst[row[full]] = self.gap[full]


def _own(own: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal ids, by the second."""
    order = np.argsort(ids, kind="stable")
    low, high = (np.searchsorted(ids[order], own, side) for side in ("left", "right"))
    n = high - low
    row = np.repeat(np.arange(len(own)), n)
    column = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    order = np.argsort(column, kind="stable")
    return row[order], column[order]


def nearest(a: np.ndarray, own: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, leave_one_out: bool) -> Best:
    """The k rows of ``b`` nearest to each row of ``a``."""
    best = Best(len(a), k)
    same = _own(own, ids) if leave_one_out else (np.zeros(0, np.int64),) * 2
    middle = b.mean(0)
    from_middle = a - middle
    square = (from_middle * from_middle).sum(1)
    for at in range(0, len(b), TILE[1]):
        part, cut = b[at : at + TILE[1]], slice(*np.searchsorted(same[1], [at, at + TILE[1]]))
        # |a - b|^2 - |a|^2 by one product, of vectors no longer than 1
        right = part - middle
        other = (right * right).sum(1)
        size = max(float(square.max()), float(other.max())) or 1.0
        scale = 1.0 / np.sqrt(size) if 1e-300 < size < 1e300 else 1.0
        left = np.hstack([-2.0 * scale * from_middle, np.ones((len(a), 1))])
        right = np.hstack([scale * right, (other * scale * scale)[:, None]])
        shift = 32.0 * a.shape[1] * np.finfo(float).eps * scale * max(float(np.abs(a).max()), float(np.abs(part).max()))
        for kind in (np.float32, np.float64) if scale != 1.0 or size == 1.0 else (np.float64,):
            gaps = left.astype(kind) @ right.astype(kind).T
            gaps[same[0][cut], same[1][cut] - at] = np.inf
            # its rounding: of the product, of its terms and of the shift to the middle
            off = 4.0 * (a.shape[1] + 8) * float(np.finfo(kind).eps) * max(1.0, size * scale * scale) + shift
            limit = (best.worst - square) * scale**2 + off
            if k <= len(part) and not np.isfinite(limit).all():
                some = np.partition(gaps[:, : max(k, TILE[1] // 4)], k - 1, axis=1)[:, k - 1]
                limit = np.minimum(limit, some.astype(float) + 2.0 * off)
            row, column = np.nonzero((gaps <= np.nextafter(limit.astype(kind), kind(np.inf))[:, None]) & (gaps < np.inf))
            if len(row) <= 16 * (k + 4) * len(a):
                break
        for i in range(0, len(row), 1 << 16):
            r, c = row[i : i + (1 << 16)], column[i : i + (1 << 16)]
            exact = ((part[c] - a[r]) ** 2).sum(1)
            near = exact <= best.worst[r]
            best.add(r[near], c[near] + at, exact[near], ids[at + c[near]])
    return best


def _meet(k: int, leave_one_out: bool, width: int):
    def work(tests: pa.Table, trains: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], [], []]
        if len(tests) and len(trains):
            b, ids = matrix(trains["v"].combine_chunks(), width), trains["id"].to_numpy()
            a, own = matrix(tests["v"].combine_chunks(), width), tests["id"].to_numpy()
            for at in range(0, len(a), TILE[0]):
                best = nearest(a[at : at + TILE[0]], own[at : at + TILE[0]], b, ids, k, leave_one_out)
                for out, values in zip(found, (own[at + best.row], best.id, best.gap, best.column)):
                    out.append(values)
        test, train, gap, column = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        label = trains["label"].take(pa.array(column.astype(np.int64))) if len(trains) else pa.chunked_array([pa.array([], pa.int64())])
        return pa.table({"test_id": pa.array(test, pa.int64()), "train_id": pa.array(train, pa.int64()), "distance2": pa.array(gap, pa.float64()), "train_label": label})

    return work


def _usable(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


class Join:
    """The plan of one exact neighbour join; ``sent`` counts the training rows that each cell must see."""

    def __init__(self, test: DataFrame, train: DataFrame, id_column: str, vector: str, label: str, k: int, block_rows: int, leave_one_out: bool):
        def slim(df: DataFrame, own: Column) -> DataFrame:
            rows = df.select(F.col(id_column).cast("long").alias("id"), own.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
            # adding 0.0 makes the two zeros equal
            return rows.filter(_usable(F.col("v")) & (F.size("v") > 0)).withColumn("v", F.transform("v", lambda x: x + 0.0))

        self.k, self.block_rows, self.leave_one_out = k, block_rows, leave_one_out
        # a test row needs k of the smallest ids of a vector, and one more if it may be one of them
        same = Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last())
        trains = slim(train, F.col(label)).withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k + leave_one_out).drop("_n")
        trains, tests = checkpointed(trains), slim(test, F.lit(None))
        sample = trains.select("v").orderBy(F.xxhash64("v"), "id").limit(SAMPLE).collect()
        self.width = len(sample[0]["v"]) if sample else 0
        self.rows, self.sent = None, {}
        if not sample:
            return
        x = np.array([r["v"] for r in sample])
        total = len(x) if len(x) < SAMPLE else trains.count()
        self.pivots = choose_pivots(x, max(1, min(MOST_PIVOTS, total // CELL_ROWS)))
        schema = "id long, label long, v array<double>, cell int, far double"
        placed = trains.mapInArrow(_place(self.pivots), schema)
        self.tests = checkpointed(tests.mapInArrow(_place(self.pivots), schema))
        need = k + leave_one_out
        first = Window.partitionBy("cell").orderBy("far")
        nearest: list[list[float]] = [[] for _ in self.pivots]
        for r in placed.select("cell", "far").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= need).collect():
            nearest[r["cell"]].append(r["far"])
        radius = np.full(len(self.pivots), -1.0)
        self.asked: dict[int, int] = {}
        for r in self.tests.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():
            radius[r["cell"]], self.asked[r["cell"]] = r["far"], r["n"]
        reach = reaches(self.pivots, radius, nearest, need)
        wanted = trains.select("v").mapInArrow(_wanted(self.pivots, reach), "target int, n long")
        self.sent = {r["target"]: r["n"] for r in wanted.groupBy("target").agg(F.sum("n").alias("n")).filter("n > 0").collect()}
        asked = sum(self.asked.values())
        if self._shipped() > MOST_COPIES * (asked + total):
            self.pivots, self.asked, self.sent = self.pivots[:1], {0: asked}, {0: total}
            self.tests = self.tests.withColumn("cell", F.lit(0))
            self.rows = trains.withColumn("target", F.lit(0))
        else:
            self.rows = trains.mapInArrow(_send(self.pivots, reach), "id long, label long, v array<double>, target int")

    def _parts(self, n: int) -> int:
        """Blocks that so many rows of a side of a cell are cut into."""
        most = max(1, BLOCK_BYTES // (8 * self.width))
        return max(1, min(-(-n // self.block_rows), MOST_BLOCKS), -(-n // most))

    def _shipped(self) -> int:
        """Rows that meetings by cells take in all."""
        cells = [(n, self.sent.get(i, 0)) for i, n in self.asked.items()]
        return sum(n * self._parts(m) + m * self._parts(n) for n, m in cells)

    def _blocks(self, counts: dict[int, int]) -> Column:
        """Blocks of the row's cell, looked up among at most ``MOST_PIVOTS`` cells."""
        return F.get(F.lit([self._parts(counts.get(i, 0)) for i in range(len(self.pivots))]), F.col("cell"))

    def result(self) -> DataFrame:
        def block(counts: dict[int, int]) -> Column:
            return F.pmod(F.xxhash64("id"), self._blocks(counts)).cast("int")

        def every(counts: dict[int, int]) -> Column:
            return F.explode(F.sequence(F.lit(0), self._blocks(counts) - 1))

        tests = self.tests.withColumn("tb", block(self.asked)).withColumn("rb", every(self.sent))
        trains = self.rows.withColumnRenamed("target", "cell")
        trains = trains.withColumn("rb", block(self.sent)).withColumn("tb", every(self.asked))
        met = tests.select("id", "v", "cell", "tb", "rb").groupBy("cell", "tb", "rb").cogroup(trains.groupBy("cell", "tb", "rb"))
        found = met.applyInArrow(_meet(self.k, self.leave_one_out, self.width), "test_id long, train_id long, distance2 double, train_label long")
        # every input partition passes on at most k rows per test row
        ranked = Window.partitionBy("test_id").orderBy("distance2", "train_id")
        best = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= self.k)
        return best.select("test_id", "rank", "train_id", "distance2", "train_label")


def nearest_neighbours(
    test: DataFrame,
    train: DataFrame,
    id_column: str,
    vector: str,
    label: str,
    k: int = 5,
    block_rows: int = 4096,
    leave_one_out: bool = False,
) -> DataFrame:
    """The k nearest training rows of each test row by Euclidean distance, exact; ties go by id.

    Rows ``(test_id, rank, train_id, distance2, train_label)``. Ids must be unique on each side. With
    ``leave_one_out`` a training row is no neighbour of the test row with its id. Vectors that are null,
    empty or hold nulls or non-finite numbers have no neighbours and are none; all others must have the
    same length.
    """
    join = Join(test, train, id_column, vector, label, k, block_rows, leave_one_out)
    if join.rows is None:
        return test.sparkSession.createDataFrame([], "test_id long, rank int, train_id long, distance2 double, train_label long")
    return join.result()

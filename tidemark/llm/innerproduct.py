"""Exact top-k inner products by norm order and rotated partial sums.

Components become floor(scale * x), and scores are inner products of these integers. All vectors are
written once in blocks of descending length (a range partitioning by width, length and row number). The
blocks are met in bands, longest first, each band a few times as many blocks as the one before: a query
goes to a block only while its length times the block's greatest length can still beat its k-th best
score so far. So candidates of little length are never read for queries whose results are settled.

Inside a block, vectors are rotated by the eigenvectors of a sample's second moments, which puts most of
the energy into the leading coordinates. The inner product of the leading coordinates plus the product
of the lengths of the rests (Cauchy-Schwarz) bounds the score; only pairs whose bound reaches the
query's k-th best are scored with all integers. The sample steers speed alone: rounding errors of the
rotation are covered by a slack, and any rotation gives the same result. Of equal vectors in a block,
the k + 1 with the smallest ids can be in a result, so a much repeated vector is folded to these.

A block is bounded in bytes, and queries reach a task in groups bounded in bytes, so neither a task nor
the driver holds all of them; a band sends k rows per query and block at most. Scores are exact as long
as they fit a long; larger ones (components beyond about 2**31) are computed with whole numbers and cut
to the ends of a long, where they tie.

Vectors that are null or hold nulls or non-finite numbers take no part, nor do such whose scaled
components are not finite. Vectors of different lengths are not compared; empty ones score 0 with each
other. Rows are told apart by number, so a repeated row is a candidate of its own, and a query never
meets its own row. Null ids come after all others. An empty table gives an empty result. Only the id and
vector columns are read, by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.components import written

SCALE = 64
K = 20
BLOCK_BYTES = 64 << 20  # of integers in a block of candidates, at most on average
LEAST_BYTES = 1 << 20  # smaller blocks are not made for the sake of parallel tasks
QUERY_BYTES = 32 << 20  # of queries that meet a block in one task, on average
BAND = 4  # a band holds this many times the blocks met before it
SAMPLE = 4_096  # vectors behind the rotations
ROTATION_BYTES = 16 << 20  # of rotations sent to the workers; other widths stay unrotated
ENERGY = 0.7  # share of the second moment in the leading coordinates
TILE = 1_024
EXACT = 2.0**52
LARGEST = 2**63 - 1


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows, without overflow of their squares."""
    top = np.maximum(np.abs(x).max(axis=1, initial=0.0), 1e-300)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))


def scores(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of integer rows of ``a`` with those of ``b``, as longs."""
    if bound < EXACT:
        return np.rint(a @ b.T).astype(np.int64)
    whole = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    return np.array([[max(-LARGEST - 1, min(LARGEST, s)) for s in row] for row in whole], np.int64).reshape(len(a), len(b))


def pair_scores(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    if bound < EXACT:
        return np.rint(np.einsum("ij,ij->i", a, b)).astype(np.int64)
    return np.array([max(-LARGEST - 1, min(LARGEST, sum(int(x) * int(y) for x, y in zip(u, v)))) for u, v in zip(a, b)], np.int64)


def _scaled(scale: float):
    """Rows (id, width, length, data): finite scaled vectors as float64 integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_048):
                batch = whole.slice(at, 2_048)
                ids, width, length, data = [], [], [], []
                vectors = batch.column(1)
                for i, v in zip(batch.column(0).to_pylist(), vectors):
                    if not v.is_valid or v.values.null_count:
                        continue
                    with np.errstate(over="ignore"):
                        x = np.floor(v.values.to_numpy(zero_copy_only=False) * scale) + 0.0
                    if np.isfinite(x).all():
                        ids.append(i)
                        width.append(len(x))
                        length.append(float(lengths(x[None])[0]))
                        data.append(x.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(width, pa.int32()), pa.array(length, pa.float64()), pa.array(data, pa.binary())],
                    ["id", "width", "length", "data"],
                )

    return work


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """An orthogonal matrix per width, leading directions first, from a bounded sample."""
    held: dict[int, list[bytes]] = {}
    for r in rows.select("width", "data").orderBy(F.xxhash64("row")).limit(SAMPLE).collect() if rows.head(1) else []:
        held.setdefault(r["width"], []).append(bytes(r["data"]))
    out, room = {}, ROTATION_BYTES
    for width, data in sorted(held.items(), key=lambda x: -len(x[1])):
        if width and 8 * width * width <= room:
            x = np.frombuffer(b"".join(data)).reshape(-1, width)
            x = x / max(1e-300, np.abs(x).max())
            _, vectors = np.linalg.eigh(x.T @ x)
            out[width], room = vectors[:, ::-1].copy(), room - 8 * width * width
    return out


class Best:
    """The k best (score, id, row) of every query so far, in order; empty places hold the least long."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -LARGEST - 1)
        self.id = np.full((n, k), LARGEST)
        self.row = np.full((n, k), LARGEST)

    def add(self, query: np.ndarray, score: np.ndarray, id: np.ndarray, row: np.ndarray) -> None:
        """``query`` ascending."""
        if not len(query):
            return
        here, at = np.unique(query, return_inverse=True)
        q = np.concatenate([np.repeat(np.arange(len(here)), self.k), at])
        s = np.concatenate([self.score[here].ravel(), score])
        i = np.concatenate([self.id[here].ravel(), id])
        r = np.concatenate([self.row[here].ravel(), row])
        order = np.lexsort((r, i, ~s, q))
        q = q[order]
        first = np.searchsorted(q, np.arange(len(here)))
        take = order[first[:, None] + np.arange(self.k)]
        self.score[here], self.id[here], self.row[here] = s[take], i[take], r[take]


class Block:
    """Candidates of one width in descending length, with their rotated leading coordinates."""

    def __init__(self, x: np.ndarray, id: np.ndarray, row: np.ndarray, turn: np.ndarray | None, k: int):
        keep = np.arange(len(x))
        if x.shape[1]:  # of equal vectors, those with the k + 1 smallest ids
            _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, 8 * x.shape[1]))).ravel(), return_inverse=True)
            order = np.lexsort((row, id, same))
            first = np.searchsorted(same[order], same[order])
            keep = order[np.arange(len(order)) - first <= k]
        length = lengths(x[keep])
        keep = keep[np.lexsort((row[keep], id[keep], -length))]
        self.x, self.id, self.row = x[keep], id[keep], row[keep]
        self.length = lengths(self.x)
        y = self.x if turn is None else self.x @ turn
        energy = np.cumsum((y / max(1e-300, np.abs(y).max(initial=0.0))) ** 2, axis=1).sum(axis=0)
        self.lead = int(np.searchsorted(energy, ENERGY * energy[-1]) + 1) if len(energy) else 0
        self.turn, self.head, self.rest = turn, y[:, : self.lead], lengths(y[:, self.lead :])

    def meet(self, x: np.ndarray, row: np.ndarray, floor: np.ndarray, k: int) -> Best:
        """The best of this block for queries ``x`` whose k-th best score so far is ``floor``."""
        best = Best(len(x), k)
        own = lengths(x)
        y = x if self.turn is None else x @ self.turn
        head, rest = y[:, : self.lead], lengths(y[:, self.lead :])
        for at in range(0, len(self.x), TILE):
            part = slice(at, at + TILE)
            need = np.maximum(best.score[:, -1], floor).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                most = own * self.length[at]
                live = np.flatnonzero(~(most * (1 + 1e-9) + 1 < need))  # a bound that is no number keeps the pair
                if not len(live):
                    break  # all later vectors are shorter
                bound = head[live] @ self.head[part].T + np.outer(rest[live], self.rest[part])
                q, c = np.nonzero(~(bound + 1e-9 * most[live, None] + 1 < need[live, None]))
            if not len(q):
                continue
            top = float(most[live].max())
            if len(q) * 4 > bound.size:
                score = scores(x[live], self.x[part], top)[q, c]
            else:
                score = np.concatenate([pair_scores(x[live[q[i : i + 65_536]]], self.x[at + c[i : i + 65_536]], top) for i in range(0, len(q), 65_536)])
            c = at + c
            q = live[q]
            ok = (self.row[c] != row[q]) & (score >= np.maximum(best.score[q, -1], floor[q]))
            best.add(q[ok], score[ok], self.id[c[ok]], self.row[c[ok]])
        return best


def _meet(turns: dict[int, np.ndarray], k: int):
    """Candidates of a block first, then its queries in order: (query, score, id, row) of the best."""
    fields = ["query", "score", "id", "row"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))  # block, part, width
            asks = batch.column(3).to_numpy(zero_copy_only=False)
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or asks[i] != asks[i - 1]], len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if keys[a] != at:
                    at, held, block = keys[a], [], None
                width = at[2]
                part = batch.slice(a, b - a)
                x = np.frombuffer(b"".join(part.column(7).to_pylist())).reshape(b - a, width)
                id, row = (part.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
                if not asks[a]:
                    held.append((x, id, row))
                    continue
                if block is None:
                    if not held:
                        continue
                    block = Block(*map(np.concatenate, zip(*held)), turns.get(width), k)
                floor = part.column(6).to_numpy(zero_copy_only=False)
                for i in range(0, b - a, TILE):
                    best = block.meet(x[i : i + TILE], row[i : i + TILE], floor[i : i + TILE], k)
                    found = best.row.ravel() < LARGEST
                    query = np.repeat(row[i : i + TILE], k)[found]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (query, best.score.ravel()[found], best.id.ravel()[found], best.row.ravel()[found])], fields)

    return work


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(df: DataFrame, ask: Column, id: str = "vec_id", vector: str = "embedding", k: int = K, scale: float = SCALE, block_bytes: int = BLOCK_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of ``df`` that score highest for each row where ``ask`` holds.

    ``ask`` is an expression over a column ``id``."""
    spark = df.sparkSession
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = written(rows.mapInArrow(_scaled(scale), "id long, width int, length double, data binary").withColumn("row", F.monotonically_increasing_id()), "ip_rows")
    last = F.coalesce("id", F.lit(LARGEST))  # null ids come last
    total = rows.agg(F.sum(F.col("width") * F.lit(8).cast("long") + 64).alias("all"), F.sum(F.when(ask, F.col("width") * F.lit(8).cast("long") + 64)).alias("asked")).head()
    size, asked = total["all"] or 0, total["asked"] or 0
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-size // block_bytes), min(spread, -(-size // min(LEAST_BYTES, block_bytes))))
    turns = rotations(rows)
    cut = rows.repartitionByRange(blocks, F.col("width"), F.desc("length"), F.xxhash64("row"))
    cut = written(cut.withColumn("block", F.spark_partition_id()), "ip_blocks")
    met = cut.groupBy("width", "block").agg(F.max("length").alias("longest"))
    met = written(met.withColumn("turn", F.row_number().over(Window.partitionBy("width").orderBy("block")) - 1), "ip_order")
    most = met.agg(F.max("turn")).head()[0]
    groups = max(1, -(-asked // query_bytes))
    queries = written(rows.filter(ask).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")), "ip_queries")
    best = spark.createDataFrame([], "query long, score long, id long, row long, rank int")
    floor = best.select("query", F.col("score").alias("floor")).limit(0)
    low, high = 0, 1
    while most is not None and low <= most:
        band = met.filter(F.col("turn").between(low, high - 1))
        asking = queries.join(floor.withColumnRenamed("query", "row"), "row", "left")
        asking = asking.withColumn("floor", F.coalesce("floor", F.lit(-LARGEST - 1)))
        may = ~(F.col("length") * F.col("longest") * (1 + 1e-9) + 1 < F.col("floor"))
        sent = asking.join(band, "width").filter(may).select("block", "part", "width", F.lit(1).alias("asks"), last.alias("id"), "row", "floor", "data")
        parts = sent.select("block", "part", "width").distinct()
        held = cut.join(parts, ["block", "width"]).select("block", "part", "width", F.lit(0).alias("asks"), last.alias("id"), "row", F.lit(0).cast("long").alias("floor"), "data")
        tasks = min(10_000, (high - low) * groups)
        task = F.pmod(F.col("block") * groups + F.col("part"), F.lit(tasks)).cast("int")
        both = sent.union(held).repartitionById(tasks, task).sortWithinPartitions("block", "part", "width", "asks")
        found = both.mapInArrow(_meet(turns, k), "query long, score long, id long, row long")
        best = written(_ranked(found.union(best.drop("rank")), k), "ip_best")
        floor = best.filter(F.col("rank") == k).select("query", F.col("score").alias("floor"))
        low, high = high, high * (1 + BAND)
    names = queries.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    shown = F.when(F.col("id") < LARGEST, F.col("id"))
    return best.join(names, "query").select("query_id", "rank", shown.alias("vec_id"), "score")


def report(df: DataFrame) -> DataFrame:
    """The 20 best of every row whose id is divisible by 20."""
    return top_k(df, F.col("id") % 20 == 0)


#: The report in DuckDB SQL: all rows for every query.
TWIN = f"""
    WITH rows AS (
      SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
      FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
      SELECT q.n, q.vec_id AS query_id, c.n AS m, c.vec_id,
        CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
      FROM rows q JOIN rows c ON q.n <> c.n AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
    ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST, m) AS INTEGER) AS rank FROM pairs)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""

"""DartMinHash signatures of word shingles, and the banded near-duplicate join.

**Darts.** The region of an element of weight w is split into unit layers (the last one partial). Darts
fall on a layer as a Poisson process over rank: the gaps between ranks are exponential variates drawn
from hashes of (element, layer, number), so equal elements get equal darts in every document. Each dart
hashes to one of ``COORDINATES`` coordinates; the earliest dart of each coordinate is the signature. A
document of total weight W throws only darts of rank up to about t ln t / W, so long documents cost one
hash per element and every document a bounded number of darts; if a coordinate stays empty the rank
limit is doubled. Two signatures agree in a coordinate with the probability of their weighted Jaccard
similarity.

**Join.** Documents with the same words in the same order are folded into one class first (per batch,
before any shuffle). ``BANDS`` bands of ``ROWS`` coordinates give buckets; a pair of similarity 0.8
shares none with probability (1 - 0.8**6)**40 < 6e-6. Within a bucket pairs are not enumerated:

1. every class is compared with the bucket's leader (its smallest class), by exact Jaccard similarity;
   those that fail get a leader among themselves, ``LEADER_ROUNDS`` times; links so far give components;
2. where a bucket still holds several components, the members outside the largest one are compared with
   all members, in chunks, inside tasks that return links only.

So every pair of a bucket is compared, or in one component already. Nothing is capped.

Words are maximal runs of letters A-Z (folded), digits and non-ASCII characters. A text of one to four
words is one shingle; a text without words (null, empty) is linked to nothing. Sets are compared unless
``counted`` asks for multiplicities. Null ids are allowed; a class of null ids only has a null class id.
Of repeated rows one is kept. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.components import components, written

WORDS = 5
COORDINATES = 240
ROWS = 6
BANDS = COORDINATES // ROWS
THRESHOLD = 0.8
LEADER_ROUNDS = 2
CHUNK = 256  # members of a bucket compared at once
WINDOW = 1 << 18  # bytes hashed at once
DOCS_AT_ONCE = 512
TEXT_AT_ONCE = 1 << 20

U = np.uint64
_SALT = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BYTE = np.where(_IS_WORD, _SALT, U(0))
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, WINDOW + 1), _powers(_INVERSE, WINDOW + 1)


def _window_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in a window that cuts no word."""
    up, down = (_UP, _DOWN) if len(data) <= WINDOW else (_powers(_BASE, len(data)), _powers(_INVERSE, len(data)))
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IS_WORD[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U)), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the text of each; temporaries are bounded by WINDOW."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    hashes, places, at = [], [], 0
    while at < len(data):
        end = min(at + WINDOW, len(data))
        if end < len(data):
            gaps = np.flatnonzero(~_IS_WORD[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word fills the window: go to its end
                while end < len(data) and _IS_WORD[data[end]]:
                    end += 1
        h, s = _window_words(data[at:end])
        hashes.append(h)
        places.append(s + at)
        at = end
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, U), np.searchsorted(ends, place, "right")


_STEP = mix(np.arange(1, 17, dtype=U) * _BASE) | U(1)


def shingles(words: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of WORDS words (fewer words: of all of them), and the text of each."""
    n = len(words) - WORDS + 1
    runs, of = np.zeros(0, U), np.zeros(0, np.int64)
    if n > 0:
        whole = owner[:n] == owner[WORDS - 1 :]
        total = words[:n] * _STEP[0]
        for k in range(1, WORDS):
            total = total + words[k : n + k] * _STEP[k]
        runs, of = mix(total[whole]), owner[:n][whole]
    counts = np.bincount(owner, minlength=docs)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        first = np.searchsorted(owner, short)
        extra = [mix((words[i : i + c] * _STEP[:c]).sum(keepdims=True) + U(c))[0] for i, c in zip(first, counts[short])]
        order = np.argsort(np.concatenate([of, short]), kind="stable")
        runs, of = np.concatenate([runs, np.array(extra, U)])[order], np.concatenate([of, short])[order]
    return runs, of


def layered(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray):
    """Unit layers of weighted elements: element per layer, its filled share, and its text."""
    layers = np.ceil(weights).astype(np.int64)
    index = np.repeat(np.arange(len(elements)), layers)
    level = np.arange(len(index)) - np.repeat(np.cumsum(layers) - layers, layers)
    share = np.minimum(1.0, weights[index] - level)
    return mix(elements[index] + level.astype(U) * _BASE), share, owner[index]


def multiplicities(elements: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Elements renamed by occurrence, so that a set of them stands for the multiset."""
    order = np.lexsort((elements, owner))
    e, o = elements[order], owner[order]
    fresh = np.ones(len(e), bool)
    fresh[1:] = (e[1:] != e[:-1]) | (o[1:] != o[:-1])
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(e)), 0))
    out = np.empty_like(elements)
    out[order] = mix(e + (np.arange(len(e)) - start).astype(U) * _BASE)
    return out


def throw(elements: np.ndarray, owner: np.ndarray, docs: int, share: np.ndarray | None = None) -> np.ndarray:
    """docs x COORDINATES: the earliest dart of each coordinate; rows without elements are all ones."""
    empty = U(2**64 - 1)
    best = np.full(docs * COORDINATES, empty)
    weight = np.bincount(owner, share, docs) if share is not None else np.bincount(owner, minlength=docs)
    limit = COORDINATES * (np.log(COORDINATES) + 3) / np.maximum(weight, 1e-300)
    while len(elements):
        at, rank, number = np.arange(len(elements)), np.zeros(len(elements)), 0
        reach = limit[owner]
        while len(at):
            number += 1
            u = mix(elements[at] + np.full(1, number, U) * _STEP[0])
            if number == 1:  # most elements of a long text have no dart: compare before taking logarithms
                near = u >= (np.exp(-reach) * 2.0**64).astype(U)
                at, u, rank = at[near], u[near], rank[near]
            rank = rank - np.log((u >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
            keep = rank <= reach[at]
            at, u, rank = at[keep], u[keep], rank[keep]
            dart = mix(u)
            lands = slice(None)
            if share is not None:
                height = (mix(dart) >> U(11)).astype(np.float64) * 2.0**-53
                lands = height < share[at]
            key = (rank[lands].astype(np.float32).view(np.uint32).astype(U) << U(32)) | (dart[lands] >> U(32))
            coordinate = (dart[lands] & U(0xFFFFFFFF)) % U(COORDINATES)
            np.minimum.at(best, owner[at[lands]] * COORDINATES + coordinate.astype(np.int64), key)
        missed = (best.reshape(docs, COORDINATES) == empty).any(axis=1)
        again = missed[owner]
        elements, owner = elements[again], owner[again]
        share = share[again] if share is not None else None
        limit = limit * 2
    return best.reshape(docs, COORDINATES)


def bands(signature: np.ndarray) -> np.ndarray:
    """docs x BANDS bucket keys."""
    darts = (signature & U(0xFFFFFFFF)).reshape(len(signature), BANDS, ROWS)
    key = np.arange(BANDS, dtype=U) * _BASE
    for k in range(ROWS):
        key = mix((key ^ darts[:, :, k]) * _STEP[k])
    return key.view(np.int64)


def _order_hash(words: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """Two 64-bit hashes of each text's word sequence."""
    first = np.searchsorted(owner, np.arange(docs))
    place = (np.arange(len(words)) - first[owner]).astype(U)
    out = np.zeros((docs, 2), U)
    present = np.unique(owner)
    for k in range(2):
        term = mix(words * _STEP[k] + place * _STEP[k + 2])
        if len(term):
            out[present, k] = np.add.reduceat(term, first[present])
    return out.view(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of bounded rows and text."""
    for whole in batches:
        at = 0
        while at < whole.num_rows:
            part = whole.slice(at, DOCS_AT_ONCE)
            texts, size = [], 0
            for t in part.column(column).cast(pa.binary()):
                texts.append(t.as_py() or b"")
                size += len(texts[-1])
                if size >= TEXT_AT_ONCE:
                    break
            at += len(texts)
            yield part.slice(0, len(texts)), texts


_MEMBERS = pa.list_(pa.struct([("id", pa.int64()), ("key", pa.int64())]))


def _sign(counted: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for part, texts in _pieces(batches, 2):
            docs = len(texts)
            ids, keys = part.column(0).to_pylist(), part.column(1).to_pylist()
            words, owner = word_hashes(texts)
            counts = np.bincount(owner, minlength=docs)
            order = _order_hash(words, owner, docs)
            groups: dict = {}
            for row in range(docs):
                own = (order[row, 0], order[row, 1], counts[row]) if counts[row] else (row,)
                groups.setdefault(own, []).append(row)
            rows = [min(g, key=lambda r: (ids[r] is None, ids[r] or 0)) for g in groups.values()]
            runs, of = shingles(words, owner, docs)
            if counted:
                runs = multiplicities(runs, of)
            new = np.full(docs, -1)
            new[rows] = np.arange(len(rows))
            chosen = new[of] >= 0
            keyed = bands(throw(runs[chosen], new[of[chosen]], len(rows)))
            buckets = [keyed[i] if counts[r] else None for i, r in enumerate(rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(page, page + len(rows)), pa.int64()),
                    pa.array(order[rows, 0]),
                    pa.array(order[rows, 1]),
                    pa.array([ids[r] for r in rows], pa.int64()),
                    pa.array([keys[r] for r in rows], pa.int64()),
                    pa.array([[{"id": ids[r], "key": keys[r]} for r in g] for g in groups.values()], _MEMBERS),
                    pa.array(buckets, pa.list_(pa.int64())),
                ],
                ["page", "hi", "lo", "smallest", "key", "members", "bands"],
            )
            page += len(rows)

    return work


def _sets(counted: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _pieces(batches, 1):
            words, owner = word_hashes(texts)
            runs, of = shingles(words, owner, len(texts))
            if counted:
                runs = multiplicities(runs, of)
            cut = np.searchsorted(of, np.arange(len(texts) + 1))
            each = [np.unique(runs[a:b]).view(np.int64) for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(each, pa.list_(pa.int64()))], ["node", "runs"]
            )

    return work


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, similarity of the shingle sets of each distinct pair of classes."""
    left = sets.select(F.col("node").alias("a"), F.col("runs").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("runs").alias("right"))
    shared = F.size(F.array_intersect("left", "right"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", (shared / (F.size("left") + F.size("right") - shared)).alias("similarity"))


def _meet(threshold: float):
    """Links between the small components of a bucket and all its other members."""

    def work(key: tuple, group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        small = group["small"].to_numpy(zero_copy_only=False)
        node, own = group["node"].to_numpy(), group["own"].to_numpy()
        keys = np.array(group["bands"].to_pylist(), np.int64).reshape(len(node), BANDS)
        band = int((keys[0] == bucket).argmax())
        runs = group["runs"].combine_chunks()
        runs = runs.chunk(0) if isinstance(runs, pa.ChunkedArray) else runs
        cut, values = runs.offsets.to_numpy(), runs.values.to_numpy()
        size = np.diff(cut)
        others = np.flatnonzero(~small)
        place = np.repeat(np.arange(len(others)), size[others])
        flat = np.concatenate([values[cut[i] : cut[i + 1]] for i in others]) if len(others) else values[:0]
        u, v = [], []
        for i in np.flatnonzero(small):
            mine = np.sort(values[cut[i] : cut[i + 1]])
            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            same = np.bincount(place[mine[at] == flat], minlength=len(others))
            near = same / (size[i] + size[others] - same) >= threshold
            # a pair is met in the first bucket that it shares
            first = ~(keys[i, :band] == keys[others, :band]).any(axis=1)
            hits = others[near & first & (own[others] != own[i])]
            u += [node[i]] * len(hits)
            v += node[hits].tolist()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return work


def _across(members: DataFrame, classes: DataFrame, sets: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """u, v: links between different components of a bucket; ``members`` has bucket, node.

    Members outside the largest component meet all members, in chunks of at most CHUNK on average; pairs
    are compared inside a task, and only links leave it.
    """
    members = members.join(found, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("own"))
    members = written(members, "bucket_components")
    sizes = members.groupBy("bucket", "own").count()
    sizes = sizes.groupBy("bucket").agg(F.max_by("own", F.struct("count", "own")).alias("largest"), F.sum("count").alias("n"), F.max("count").alias("most"))
    sizes = sizes.filter("n > most").select(
        "bucket", "largest", F.ceil((F.col("n") - F.col("most")) / CHUNK).alias("rows"), F.ceil(F.col("n") / CHUNK).alias("columns")
    )
    mixed = members.join(sizes, "bucket")
    small = mixed.filter("own <> largest").select(
        "bucket", "node", "own", F.lit(True).alias("small"),
        F.pmod(F.xxhash64("node"), F.col("rows")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"),
    )
    every = mixed.select(
        "bucket", "node", "own", F.lit(False).alias("small"),
        F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod(F.xxhash64("node"), F.col("columns")).alias("j"),
    )
    held = sets.join(classes.select("node", "bands"), "node")
    return small.union(every).join(held, "node").groupBy("bucket", "i", "j").applyInArrow(_meet(threshold), "u long, v long")


def near_groups(df: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, counted: bool = False) -> DataFrame:
    """One row per row of ``df``: doc_id, class_id (smallest id of its group), class_size, kept, text_key."""
    source = df.select(
        F.col(id).cast("long").alias("id"),
        F.xxhash64(text).alias("key"),
        F.col(text).alias("text"),
    )
    rows = written(
        source.mapInArrow(_sign(counted), "page long, hi long, lo long, smallest long, key long, members array<struct<id:bigint,key:bigint>>, bands array<bigint>"),
        "signatures",
    )
    worded = rows.filter(F.col("bands").isNotNull())
    classes = written(
        worded.groupBy("hi", "lo").agg(F.min_by(F.struct("page", "smallest", "key", "bands"), "page").alias("c")).select("hi", "lo", F.col("c.page").alias("node"), "c.smallest", "c.key", "c.bands"),
        "classes",
    )
    placed = classes.select(F.explode("bands").alias("bucket"), F.col("node").alias("a"))
    leaders = placed.groupBy("bucket").agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1")
    shared = written(placed.join(leaders.drop("n"), "bucket"), "bucket_members")
    wanted = shared.select(F.col("a").alias("node")).distinct().join(classes, "node")
    wanted = wanted.select("node", F.coalesce("smallest", F.lit(0)).alias("id"), "key")
    texts = source.select(F.coalesce("id", F.lit(0)).alias("id"), "key", "text").join(wanted, ["id", "key"])
    sets = written(texts.select("node", "text").mapInArrow(_sets(counted), "node long, runs array<bigint>").dropDuplicates(["node"]), "sets")

    left, links = shared.filter("a <> b"), []
    for _ in range(LEADER_ROUNDS):
        known = written(_compared(left.select("a", "b").distinct(), sets), "compared")
        links.append(known.filter(F.col("similarity") >= threshold).select(F.col("a").alias("u"), F.col("b").alias("v")))
        failed = left.join(known.filter(F.col("similarity") < threshold), ["a", "b"]).select("bucket", "a")
        next_leader = failed.groupBy("bucket").agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
        left = written(failed.join(next_leader, "bucket").filter("a <> b"), "bucket_members")
    linked = written(reduce(DataFrame.union, links).distinct(), "links")
    found = components(linked)
    late = written(_across(shared.select("bucket", F.col("a").alias("node")), classes, sets, found, threshold), "late_links")
    if not late.isEmpty():
        found = components(linked.union(late))

    member = rows.join(classes.select("hi", "lo", "node"), ["hi", "lo"], "left")
    member = member.withColumn("node", F.when(F.col("bands").isNull(), F.col("page")).otherwise(F.col("node")))
    member = member.select("node", "page", "smallest", "members").join(found, "node", "left")
    member = written(member.withColumn("root", F.coalesce("root", "node")).drop("node"), "members")
    totals = member.groupBy("root").agg(
        F.min("smallest").alias("class_id"),
        F.sum(F.size("members").cast("long")).alias("class_size"),
        F.min_by("page", F.struct(F.col("smallest").isNull(), "smallest", "page")).alias("keep_page"),
    )
    first = F.when(F.col("class_id").isNull(), 0).otherwise(F.array_position("members.id", F.col("class_id")) - 1)
    return (
        member.join(totals, "root")
        .withColumn("keeper", F.when(F.col("page") == F.col("keep_page"), first).otherwise(-1))
        .select("class_id", "class_size", "keeper", F.posexplode("members").alias("at", "own"))
        .select(
            F.col("own.id").alias("doc_id"),
            "class_id",
            "class_size",
            (F.col("at") == F.col("keeper")).alias("kept"),
            F.col("own.key").alias("text_key"),
        )
    )


def drop_near(df: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with one row of each near-duplicate group, all its columns unchanged."""
    kept = near_groups(df, id, text, threshold).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__own"))
    marked = df.withColumn("__key", F.xxhash64(text))
    same = (marked[id].cast("long").eqNullSafe(kept["__id"])) & (marked["__key"] == kept["__own"])
    one = Window.partitionBy("__key", id).orderBy(F.lit(0))
    return (
        marked.join(kept, same, "left_semi")
        .withColumn("__n", F.row_number().over(one))
        .filter("__n = 1")
        .drop("__key", "__n")
    )

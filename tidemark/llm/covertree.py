"""Exact threshold pairs of embeddings by dual traversal of cover trees.

Unit vectors at cosine >= t lie within e = sqrt(2 - 2t) of each other. The tree's top level is a set of
nested centres, chosen farthest-first from a bounded sample, each of which covers a cell (the vectors
nearest to it). Cells are cut into blocks of bounded size around local centres, and every block carries
its own tree, whose nodes halve their covering radius at each level. A pair of nodes is dropped when its
centres are farther apart than e plus both radii; when both radii and the distance together stay within
e, all its vectors are linked without being compared; else the wider node is opened. Of a leaf pair, the
vectors outside the other leaf's cone, widened by the threshold's angle, are left out. The others meet in
single precision by their leading coordinates and the norms of the rest, which bound the product from
above; what may reach the threshold is compared by its dot product in double precision.

Blocks lie in bands of bounded size, one folder of the shared folder each. A task meets pairs of bands and
reads both from there, so a vector is shuffled and written once however many others it meets. Pairs of
bands are pruned by the bound of their cells before any is read. Executors read bands with pyarrow, so
``spark.checkpoint.dir`` must be on a file system that pyarrow opens (local or mounted, hdfs, s3, gs).

Equal vectors are one class with a count, so copies are never compared or expanded. A task returns link
counts per class and a spanning forest of its links, never its pairs.

Vectors that are null, empty or zero, or hold nulls or non-finite numbers, are linked to nothing; so are
vectors of different lengths. Null ids are counted as vectors but are no component's id. Repeated rows
are vectors of their own, linked as copies. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidemark.llm.components import components, written
from tidemark.session import scratch

THRESHOLD = 0.9
SAMPLE = 4_096  # vectors from which centres are chosen
MOST_CELLS = 1_024
CELL = 2_048  # vectors per cell that the number of centres aims at
BLOCK = 2_048  # vectors per block that the cuts of a cell aim at
BAND = 65_536  # most vectors of a band, on average of a cell's salts
BAND_BYTES = 64 << 20  # most bytes of a band's vectors in double precision
BANDS = 16  # bands at least, if there are as many vectors
LEAF = 128
ROWS = 512  # rows of a leaf compared at once
CONE = 256  # least vectors of nodes that are met by cones
FEW = 16_384  # pairs of nodes up to which all are compared in double precision
AGAIN = 16_384  # coordinates that are met in the time that a comparison in double precision takes
OPEN = 65_536  # pairs that are compared in the time that one more pair of nodes takes
MANY = 1 / 256  # share of candidates above which all of a leaf is compared in double precision
WIDEST = 2_048  # longest vectors for which leading directions are sought
SLACK = 1e-7  # bounds leave this much to the exact comparison


def reach_of(threshold: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * threshold))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def farthest_first(x: np.ndarray, most: int, within: float) -> list[int]:
    """Centres until all of ``x`` is within the radius of one, or there are ``most``."""
    chosen = [0]
    near = distances(x, x[:1])[:, 0]
    while len(chosen) < most and near.max() > within:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[chosen[-1:]])[:, 0])
    return chosen


def basis_of(x: np.ndarray, threshold: float) -> np.ndarray | None:
    """Leading directions of the sample, as many as make its pairs cheapest to tell apart; None: whole vectors meet."""
    d = x.shape[1]
    if d > WIDEST:
        return None
    x = x[: SAMPLE // 4]
    by_energy = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    apart = x @ x.T < threshold
    best, cost = None, float(d)
    for m in range(16, d, 8):
        s = sketch_of(x, by_energy[:, :m])
        if (c := m + AGAIN * (apart & (s @ s.T >= threshold)).mean()) < cost:
            best, cost = np.ascontiguousarray(by_energy[:, :m]), c
    return best


def sketch_of(x: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """Unit vectors in single precision: whole, or along the basis with the norm of the rest; products are no less."""
    if basis is None:
        return x.astype(np.float32)
    y = x @ basis
    rest = np.sqrt(np.maximum(0.0, 1 - (y * y).sum(axis=1, keepdims=True)))
    return np.hstack([y, rest]).astype(np.float32)


class Tree:
    """Nodes over a permutation of unit vectors: centre, radius, range and children of each."""

    def __init__(self, x: np.ndarray, basis: np.ndarray | None = None):
        self.order = np.arange(len(x))
        self.radius: list[float] = []
        self.range: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        centres: list[int] = []
        self._grow(x, 0, len(x), int((x @ x.mean(axis=0)).argmax()), centres)
        self._settle(x[self.order], np.argsort(self.order)[centres], basis)

    def _grow(self, x: np.ndarray, start: int, end: int, centre: int, centres: list[int]) -> int:
        own = x[self.order[start:end]]
        d = distances(own, x[centre][None])[:, 0]
        me = len(self.radius)
        centres.append(centre)
        self.radius.append(float(d.max()))
        self.range.append((start, end))
        self.children.append([])
        n = end - start
        if n > LEAF and self.radius[me] > 1e-6:
            most = max(8, n // 8)
            chosen = farthest_first(own, most + 1, self.radius[me] / 2)
            if len(chosen) <= most:  # else the vectors fill the ball, and smaller balls hold one each
                to = distances(own, own[chosen]).argmin(axis=1)
                by = np.argsort(to, kind="stable")
                heads = self.order[start:end][chosen]
                self.order[start:end] = self.order[start:end][by]
                cuts = np.searchsorted(to[by], np.arange(len(chosen) + 1))
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    self.children[me].append(self._grow(x, start + a, start + b, int(heads[k]), centres))
        return me

    def _settle(self, x: np.ndarray, at: np.ndarray, basis: np.ndarray | None) -> None:
        self.x, self.at, self.basis = x, at, basis
        self.c = x[at]
        self.r = np.array(self.radius)
        self._sketch: np.ndarray | None = None
        self._cones: dict[int, tuple[np.ndarray, float]] = {}

    def packed(self) -> dict[str, bytes]:
        """All but the vectors, which are kept in tree order."""
        up = np.full(len(self.radius), -1)
        for k, below in enumerate(self.children):
            up[below] = k
        nodes = np.column_stack([np.array(self.range), up, self.at]).astype(np.int32)
        return {"radius": self.r.tobytes(), "shape": nodes.tobytes()}

    @classmethod
    def unpacked(cls, x: np.ndarray, radius: bytes, shape: bytes, basis: np.ndarray | None) -> Tree:
        t = cls.__new__(cls)
        nodes = np.frombuffer(shape, np.int32).reshape(-1, 4)
        t.order = np.arange(len(x))
        t.radius = np.frombuffer(radius, np.float64).tolist()
        t.range = [(s, e) for s, e in nodes[:, :2].tolist()]
        t.children = [[] for _ in t.radius]
        for k, up in enumerate(nodes[:, 2].tolist()):
            if up >= 0:
                t.children[up].append(k)
        t._settle(x, nodes[:, 3], basis)
        return t

    @property
    def sketch(self) -> np.ndarray:
        if self._sketch is None:
            self._sketch = sketch_of(self.x, self.basis)
        return self._sketch

    def cone(self, node: int) -> tuple[np.ndarray, float]:
        """Mean direction of a node's vectors, and the least cosine to it."""
        if node not in self._cones:
            own = self.x[slice(*self.range[node])]
            c = own.mean(axis=0)
            c = c / max(1e-300, float(np.sqrt(c @ c)))
            self._cones[node] = (c, float((own @ c).min()))
        return self._cones[node]


def in_cone(x: np.ndarray, cone: tuple[np.ndarray, float], threshold: float) -> np.ndarray:
    """Whether unit vectors lie in the cone widened by the threshold's angle."""
    c, low = cone
    wide = math.acos(max(-1.0, min(1.0, low))) + math.acos(max(-1.0, min(1.0, threshold)))
    return x @ c >= (math.cos(wide) - SLACK if wide < math.pi else -np.inf)


def places_of(maybe: np.ndarray, n: int) -> np.ndarray:
    """Flat places of the n true ones; few are found faster by searching the bytes."""
    if n > maybe.size // 1024:
        return np.flatnonzero(maybe)
    out, held, at = np.empty(n, np.int64), maybe.tobytes(), -1
    for k in range(n):
        out[k] = at = held.find(b"\x01", at + 1)
    return out


def close(a: Tree, p: int, b: Tree, q: int, threshold: float):
    """Places of the linked pairs of two nodes that are not opened, some rows at a time."""
    (s, e), (f, g) = a.range[p], b.range[q]
    rows, columns = np.arange(s, e), np.arange(f, g)
    small = len(rows) * len(columns) <= FEW
    if not small:
        if min(len(rows), len(columns)) >= CONE:
            rows, columns = rows[in_cone(a.x[s:e], b.cone(q), threshold)], columns[in_cone(b.x[f:g], a.cone(p), threshold)]
        sa = a.sketch[s:e] if len(rows) == e - s else a.sketch[rows]
        sb = b.sketch[f:g] if len(columns) == g - f else b.sketch[columns]
        least = np.float32(threshold - 2.0**-22 * (sa.shape[1] + 8))  # more than single precision can lose
    for at in range(0, len(rows) if len(columns) else 0, ROWS):
        own = rows[at : at + ROWS]
        if not small:
            maybe = sa[at : at + ROWS] @ sb.T >= least
            n = np.count_nonzero(maybe)
            if not n:
                continue
        if small or n > MANY * maybe.size:
            u, v = np.nonzero(a.x[own] @ b.x[columns].T >= threshold)
        else:
            u, v = np.divmod(places_of(maybe, n), len(columns))
            linked = np.einsum("ij,ij->i", a.x[own[u]], b.x[columns[v]]) >= threshold
            u, v = u[linked], v[linked]
        if len(u):
            yield own[u], columns[v]


def traverse(a: Tree, b: Tree, threshold: float):
    """Ranges of all linked pairs: ('all', i, j) for node pairs, ('some', rows, columns) for places."""
    reach = reach_of(threshold)
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        open_a = a.children[i] if a.children[i] and (2 * a.r[i] >= b.r[j] or not b.children[j]) else [i]
        open_b = b.children[j] if b.children[j] and (2 * b.r[j] >= a.r[i] or not a.children[i]) else [j]
        below = (open_a != [i] or not a.children[i]) and (open_b != [j] or not b.children[j])
        d = distances(a.c[open_a], b.c[open_b])
        spread = a.r[open_a][:, None] + b.r[open_b][None]
        whole = d + spread <= reach - SLACK
        near = (d <= reach + spread + SLACK) & ~whole
        sizes = np.outer([a.range[k][1] - a.range[k][0] for k in open_a], [b.range[k][1] - b.range[k][0] for k in open_b])
        if below and not whole.any() and (sizes[near] + OPEN).sum() >= sizes.sum():
            for rows, columns in close(a, i, b, j, threshold):  # opening leaves out too little
                yield "some", rows, columns
            continue
        for u, v in zip(*np.nonzero(whole)):
            yield "all", open_a[u], open_b[v]
        for u, v in zip(*np.nonzero(near)):
            p, q = open_a[u], open_b[v]
            if a.children[p] or b.children[q]:
                todo.append((p, q))
                continue
            for rows, columns in close(a, p, b, q, threshold):
                yield "some", rows, columns


def merged(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after linking u with v, by hooking to the smaller label and pointer jumping."""
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return labels
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def block_links(a: Tree, wa: np.ndarray, b: Tree, wb: np.ndarray, same: bool, threshold: float):
    """Linked weight of every vector of both trees (in tree order), and labels over both."""
    na, nb = len(a.x), len(b.x)
    ca, cb = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    labels = np.arange(na + nb)
    shift = 0 if same else na
    for kind, p, q in traverse(a, b, threshold):
        if kind == "all":
            (s, e), (f, g) = a.range[p], b.range[q]
            ca[s:e] += wb[f:g].sum()
            cb[f:g] += wa[s:e].sum()
            ends = np.concatenate([np.arange(s, e), np.arange(f, g) + shift])
            labels = merged(labels, np.full(len(ends), ends[0]), ends)
        else:
            np.add.at(ca, p, wb[q])
            np.add.at(cb, q, wa[p])
            labels = merged(labels, p, q + shift)
    if same:  # every pair was met from both sides, and each vector met itself
        ca -= wa
        cb = np.zeros(0, np.int64)
        labels = labels[:na]
    return ca, cb, labels


_BLOCK = "band int, first int, width int, hi binary, lo binary, weights binary, vectors binary, radius binary, shape binary"


def folded(hi: np.ndarray, lo: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of every class in order of its hashes, and the weight of all its places."""
    order = np.lexsort((lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    return order[new], np.add.reduceat(weights[order], np.flatnonzero(new)) if len(order) else weights


def by_width(vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each width with the places of its vectors, and these as rows."""
    widths = np.asarray(vectors.value_lengths())
    flat, starts = np.asarray(vectors.flatten()), np.cumsum(widths) - widths
    for w in np.unique(widths).tolist():
        own = np.flatnonzero(widths == w)
        yield w, own, flat.reshape(-1, w) if len(own) == len(widths) else flat[starts[own][:, None] + np.arange(w)]


def cuts(x: np.ndarray, block: int) -> Iterator[np.ndarray]:
    """Places of the blocks of a cell: the vectors nearest to local centres, cut again by their distance to these."""
    n = math.ceil(len(x) / block)
    c = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(2 if n > 1 else 0):
        to = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, to, x)
        c = np.where(np.any(sums, axis=1, keepdims=True), sums, c)
        c = c / np.sqrt((c * c).sum(axis=1, keepdims=True))
    products = x @ c.T
    to = products.argmax(axis=1)
    for k in np.unique(to).tolist():
        own = np.flatnonzero(to == k)
        own = own[np.argsort(-products[own, k], kind="stable")]
        yield from np.array_split(own, math.ceil(len(own) / (2 * block)))


def _build_band(block: int):
    def work(group: pa.Table) -> pa.Table:
        hi, lo = (np.asarray(group[c].combine_chunks()) for c in ("hi", "lo"))
        keep, weights = folded(hi, lo, np.asarray(group["weight"].combine_chunks()))
        group = group.take(pa.array(keep)).combine_chunks()
        hi, lo, cells = (np.asarray(group[c].combine_chunks()) for c in ("hi", "lo", "cell"))
        out, first, band = [], 0, group["band"][0].as_py()
        vectors = group["vector"].combine_chunks()
        for width, places, raw in by_width(vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors):
            for cell in np.unique(cells[places]).tolist():
                own = np.flatnonzero(cells[places] == cell)
                x = unit(raw[own].astype(np.float64))
                for part in cuts(x, block):
                    tree = Tree(x[part])
                    at = own[part[tree.order]]
                    tables = {k: v[places[at]].tobytes() for k, v in (("hi", hi), ("lo", lo), ("weights", weights))}
                    out.append({"band": band, "first": first, "width": width, **tables, "vectors": raw[at].tobytes(), **tree.packed()})
                    first += len(at)
        kinds = {"band": pa.int32(), "first": pa.int32(), "width": pa.int32()}
        names = [c.split()[0] for c in _BLOCK.split(", ")]
        return pa.Table.from_pylist(out, schema=pa.schema([(c, kinds.get(c, pa.binary())) for c in names]))

    return work


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there. Spark does not escape local paths."""
    return (fs.LocalFileSystem(), path.removeprefix("file:")) if path.startswith(("file:", "/")) else fs.FileSystem.from_uri(path)


class Band:
    """The blocks of a band, read from the shared folder; their trees are unpacked when they are met."""

    def __init__(self, path: str, band: int, bases: dict[int, np.ndarray | None]):
        where, at = opened(path)
        self.rows = ds.dataset(f"{at}/band={band}", filesystem=where, format="parquet").to_table().to_pylist()
        self.bases = bases
        for row in self.rows:
            for c in ("hi", "lo", "weights"):
                row[c] = np.frombuffer(row[c], np.int64)
            n, width = len(row["hi"]), row["width"]
            kind = np.float32 if len(row["vectors"]) == 4 * n * width else np.float64
            row["vectors"] = np.frombuffer(row["vectors"], kind).reshape(n, width)
        self.size = sum(len(r["hi"]) for r in self.rows)
        self.heads = {}
        for width in {r["width"] for r in self.rows}:
            own = [k for k, r in enumerate(self.rows) if r["width"] == width]
            tops = [self.rows[k]["vectors"][np.frombuffer(self.rows[k]["shape"], np.int32)[3]] for k in own]
            radius = [np.frombuffer(self.rows[k]["radius"], np.float64)[0] for k in own]
            self.heads[width] = np.array(own), unit(np.array(tops, np.float64)), np.array(radius)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes by place."""
        rows = sorted(self.rows, key=lambda r: r["first"])
        return tuple(np.concatenate([r[c] for r in rows]) for c in ("hi", "lo"))

    def tree(self, k: int) -> Tree:
        row = self.rows[k]
        if "tree" not in row:
            row["tree"] = Tree.unpacked(unit(row["vectors"].astype(np.float64)), row["radius"], row["shape"], self.bases.get(row["width"]))
        return row["tree"]


def band_links(a: Band, b: Band, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked weight of every vector of both bands (of one, if they are the same), and labels over them."""
    reach, shift = reach_of(threshold), 0 if a is b else a.size
    counts, ends = np.zeros(shift + b.size, np.int64), [np.zeros((2, 0), np.int64)]
    for width in a.heads.keys() & b.heads.keys():
        (own_a, ca, ra), (own_b, cb, rb) = a.heads[width], b.heads[width]
        near = distances(ca, cb) <= reach + ra[:, None] + rb[None] + SLACK
        for i, j in zip(*np.nonzero(np.triu(near) if a is b else near)):
            p, q = int(own_a[i]), int(own_b[j])
            same = a is b and p == q
            wa, wb = a.rows[p]["weights"], b.rows[q]["weights"]
            ca_, cb_, labels = block_links(a.tree(p), wa, b.tree(q), wb, same, threshold)
            s, f = a.rows[p]["first"], shift + b.rows[q]["first"]
            counts[s : s + len(wa)] += ca_
            places = np.arange(s, s + len(wa))
            if not same:
                counts[f : f + len(wb)] += cb_
                places = np.concatenate([places, np.arange(f, f + len(wb))])
            moved = np.flatnonzero(labels != np.arange(len(labels)))
            ends.append(np.array([places[moved], places[labels[moved]]]))
    u, v = np.concatenate(ends, axis=1)
    return counts, merged(np.arange(len(counts)), u, v)


def _meet(path: str, first: np.ndarray, second: np.ndarray, bases: dict[int, np.ndarray | None], threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, at = None, -1
        for batch in batches:
            for k in batch.column(0).to_pylist():
                i, j = int(first[k]), int(second[k])
                if at != i:
                    a, at = Band(path, i, bases), i
                b = a if i == j else Band(path, j, bases)
                counts, labels = band_links(a, b, threshold)
                some = np.flatnonzero((counts > 0) | (labels != np.arange(len(labels))))
                if not len(some):
                    continue
                node, hi, lo = (i << 32) + np.arange(a.size), *a.ids()
                if b is not a:
                    node = np.concatenate([node, (j << 32) + np.arange(b.size)])
                    hi, lo = (np.concatenate(x) for x in zip((hi, lo), b.ids()))
                out = [node[some], hi[some], lo[some], counts[some], node[labels[some]]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["node", "hi", "lo", "links", "root"])

    return work


def usable(v: Column) -> Column:
    d = v.cast("array<double>")
    good = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(d, lambda x: x != 0), F.lit(False))


def _place(centres: dict[int, np.ndarray], first: dict[int, int], bands: tuple[np.ndarray, np.ndarray] | None = None):
    """Nearest centre (cells are numbered through all widths) and the distance to it, and with ``bands`` (first
    band and number of bands of every cell) the band. Equal vectors of a batch are one row."""
    narrow = {w: c.astype(np.float32) for w, c in centres.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                keep, weights = folded(np.asarray(b.column(0)), np.asarray(b.column(1)), np.ones(b.num_rows, np.int64))
                b = b.take(pa.array(keep))
                cell, far = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
                for width, own, x in by_width(b.column(2)):
                    if width not in centres:  # one cell, as wide as can be
                        cell[own], far[own] = first[width], 2.0
                        continue
                    x = unit(x.astype(np.float64))
                    to = (x.astype(np.float32) @ narrow[width].T).argmax(axis=1)
                    cell[own] = to + first[width]
                    far[own] = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", x, centres[width][to])))
                if bands is None:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell), pa.array(far)], ["hi", "cell", "far"])
                else:
                    salt = (np.asarray(b.column(0)).astype(np.uint64) >> np.uint64(11)) % bands[1][cell].astype(np.uint64)
                    band = (bands[0][cell] + salt.astype(np.int64)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(band), pa.array(cell), b.column(0), b.column(1), pa.array(weights), b.column(2)], ["band", "cell", "hi", "lo", "weight", "vector"]
                    )

    return work


def near_order(c: np.ndarray) -> list[int]:
    """Centres in an order that keeps near ones together: halved again and again along their widest direction."""
    todo, out = [np.arange(len(c))], []
    while todo:
        own = todo.pop()
        if len(own) == 1:
            out.append(int(own[0]))
            continue
        x = c[own] - c[own].mean(axis=0)
        way = x[int((x * x).sum(axis=1).argmax())]
        for _ in range(8):
            way = (x @ way) @ x
            way = way / max(1e-300, float(np.sqrt(way @ way)))
        by = own[np.argsort(x @ way, kind="stable")]
        todo += [by[len(by) // 2 :], by[: len(by) // 2]]
    return out


def packed_cells(order: list[int], size: dict[int, int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """First band and number of bands of every cell: small cells share one, in order, larger ones get several."""
    start, many = np.zeros(max(order, default=-1) + 1, np.int64), np.ones(max(order, default=-1) + 1, np.int64)
    band, held = 0, 0
    for cell in order:
        if held and held + size[cell] > most:
            band, held = band + 1, 0
        start[cell], many[cell] = band, max(1, math.ceil(size[cell] / most))
        held += size[cell]
        if many[cell] > 1:
            band, held = band + int(many[cell]), 0
    return start, many


def linked(df: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept."""
    spark = df.sparkSession
    kind = df.select(vector).schema[0].dataType
    slim = "array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>"
    rows = df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    # adding 0.0 makes the two zeros equal
    rows = rows.withColumn("vector", F.when(usable(F.col("vector")), F.transform("vector", lambda x: x + 0.0)))
    rows = rows.withColumns({"hi": F.xxhash64("vector"), "lo": F.xxhash64(F.lit(1), "vector")})
    good = rows.filter(F.col("vector").isNotNull())
    classes = good.groupBy("hi", "lo").agg(F.count("*").alias("weight"), F.min("id").alias("smallest"), F.min(F.size("vector")).alias("width"))
    classes = written(classes, "vector_classes")
    n = classes.count()
    keys = classes.select(F.xxhash64("hi").alias("key"), "lo").orderBy("key", "lo").limit(SAMPLE).agg(F.max("key")).collect()[0][0]
    some = good.filter(F.xxhash64("hi") <= F.lit(keys)) if n else good.limit(0)
    some = some.groupBy("hi", "lo").agg(F.first("vector").alias("vector")).orderBy(F.xxhash64("hi"), "lo").limit(SAMPLE)
    sample = [r["vector"] for r in some.collect()] if n else []
    centres: dict[int, np.ndarray] = {}
    bases: dict[int, np.ndarray | None] = {}
    for width in sorted({len(v) for v in sample}):
        x = unit(np.array([v for v in sample if len(v) == width]))
        cells = max(1, min(MOST_CELLS, len(x), round(n / CELL * len(x) / len(sample))))
        centres[width] = x[farthest_first(x, cells, 0.0)]
        bases[width] = basis_of(x, threshold)
    widths = [r["width"] for r in classes.select("width").distinct().collect()]
    first, order = {}, []
    for width in [*centres, *sorted(set(widths) - set(centres))]:  # a length that the sample missed is one cell
        first[width] = len(order)
        order += [first[width] + i for i in near_order(centres[width])] if width in centres else [first[width]]
    slim_good = good.select("hi", "lo", F.col("vector").cast(slim).alias("vector"))
    stats = slim_good.mapInArrow(_place(centres, first), "hi long, cell int, far double")
    stats = stats.groupBy("cell").agg(F.max("far").alias("radius"), F.approx_count_distinct("hi").alias("size")).collect()
    radius, size = {r["cell"]: r["radius"] for r in stats}, {r["cell"]: r["size"] for r in stats}
    order = [c for c in order if c in size]
    most = max(1, min(BAND, BAND_BYTES // (8 * max(widths, default=1)), max(BLOCK // 4, math.ceil(n / BANDS))))
    start, many = packed_cells(order, size, most)
    placed = slim_good.mapInArrow(
        _place(centres, first, (start, many)), f"band int, cell int, hi long, lo long, weight long, vector {slim}"
    )
    path = scratch(spark, "vector_bands")
    placed.groupBy("band").applyInArrow(_build_band(BLOCK), _BLOCK).write.partitionBy("band").parquet(path)
    reach = reach_of(threshold)
    last = int(max((start[c] + many[c] for c in order), default=0))
    meets = np.zeros((last, last), bool)
    for width, f in first.items():
        own = [c for c in range(f, f + len(centres.get(width, [0]))) if c in size]
        if own:
            r = np.array([radius[c] for c in own])
            d = distances(x, x) if width in centres and len(x := centres[width][[c - f for c in own]]) else np.zeros((1, 1))
            near = (d <= reach + r[:, None] + r[None] + SLACK).astype(np.float32)
            holds = np.zeros((len(own), last), np.float32)
            for k, c in enumerate(own):
                holds[k, start[c] : start[c] + many[c]] = 1
            meets |= holds.T @ near @ holds > 0
    held = [int(r["band"]) for r in spark.read.parquet(path).select("band").distinct().collect()] if n else []
    meets[np.setdiff1d(np.arange(last), held)] = False
    meets[:, np.setdiff1d(np.arange(last), held)] = False
    i, j = (x.astype(np.int32) for x in np.nonzero(np.triu(meets)))
    tasks = max(1, min(len(i), 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    partial = spark.range(0, len(i), 1, tasks).mapInArrow(_meet(path, i, j, bases, threshold), "node long, hi long, lo long, links long, root long")
    partial = written(partial, "band_links")
    found = components(partial.select(F.col("node").alias("u"), F.col("root").alias("v")).filter("u <> v").distinct())
    met = partial.groupBy("node", "hi", "lo").agg(F.sum("links").alias("links")).join(found, "node", "left")
    met = met.select("hi", "lo", "links", F.coalesce("root", "node").alias("root")).join(classes.select("hi", "lo", "smallest"), ["hi", "lo"])
    met = written(met, "linked_classes")
    least = met.groupBy("root").agg(F.min("smallest").alias("component_id"))
    met = met.join(least, "root").select("hi", "lo", "links", "component_id")
    known = classes.join(met, ["hi", "lo"], "left").select(
        "hi",
        "lo",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.when(F.col("links").isNull(), F.col("smallest")).otherwise(F.col("component_id")).alias("component_id"),
    )
    bad = rows.filter(F.col("vector").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = good.select("id", "hi", "lo").join(known, ["hi", "lo"]).select("id", "n_links", "component_id").union(bad)
    return every.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )

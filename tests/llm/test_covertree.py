from __future__ import annotations

import contextlib
import os
import threading

import numpy as np
import pytest

from tidemark.llm import covertree
from tidemark.session import shared_dir


def brute(rows, threshold=0.9):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    link = [set() for _ in rows]
    for a in ok:
        for b in ok:
            if a != b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    link[a].add(b)
    out, seen = [], [None] * len(rows)
    for i in range(len(rows)):
        if seen[i] is None:
            group, todo = {i}, [i]
            while todo:
                for j in link[todo.pop()] - group:
                    group.add(j)
                    todo.append(j)
            least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            for j in group:
                seen[j] = (least,)
        out.append((rows[i][0], len(link[i]), seen[i][0], rows[i][0] is not None and rows[i][0] == seen[i][0]))
    return sorted(out, key=repr)


def sample(seed, dims=8):
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=dims) for _ in range(60)]
    for size, noise in ((40, 0.02), (30, 0.12), (30, 0.3)):
        centre = rng.normal(size=dims)
        centre /= np.linalg.norm(centre)
        x += [(centre + noise * rng.normal(size=dims)) * rng.uniform(0.1, 9) for _ in range(size)]
    x += [x[70]] * 12 + [x[3] * 2, -x[3]]
    ids = rng.permutation(len(x)) + 5
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in zip(ids, x)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * dims), (1003, [float("nan")] * dims), (1004, [None] + [1.0] * (dims - 1)), (1005, [float("inf")] + [0.0] * (dims - 1))]
    return rows + [(1006, [1.0, 0.0]), (1007, [1.0, 0.1]), (None, rows[60][1]), rows[61], (None, [0.0] * dims)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("leaf", [4, 128])
def test_trees_find_all_pairs(monkeypatch, seed, leaf):
    monkeypatch.setattr(covertree, "LEAF", leaf)
    rng = np.random.default_rng(seed)
    x = covertree.unit(np.array([v for _, v in sample(seed)[:170]]))
    cut = 90
    a, b = covertree.Tree(x[:cut]), covertree.Tree(x[cut:])
    wa, wb = rng.integers(1, 4, cut), rng.integers(1, 4, len(x) - cut)
    full = x @ x.T >= 0.9
    ca, cb, labels = covertree.block_links(a, wa[a.order], b, wb[b.order], False, 0.9)
    assert (ca == (full[:cut, cut:] @ wb)[a.order]).all() and (cb == (full[cut:, :cut] @ wa)[b.order]).all()
    own, _, _ = covertree.block_links(a, wa[a.order], a, wa[a.order], True, 0.9)
    assert (own == (full[:cut, :cut] @ wa - wa)[a.order]).all()
    for t in (a, b):
        for node, kids in enumerate(t.children):
            assert all(t.r[k] <= t.r[node] / 2 + 1e-9 for k in kids)
            s, e = t.range[node]
            assert covertree.distances(t.x[s:e], t.c[node][None]).max() <= t.r[node] + 1e-9


def test_bounds_prune_and_include():
    rng = np.random.default_rng(1)
    base = covertree.unit(rng.normal(size=(6, 16)))
    x = covertree.unit(np.repeat(base, 400, axis=0) + 0.01 * rng.normal(size=(2400, 16)))
    t = covertree.Tree(x)
    kinds = list(covertree.traverse(t, t, 0.9))
    compared = sum(len(r) for k, r, _ in kinds if k == "some")
    assert any(k == "all" for k, _, _ in kinds) and compared < 0.2 * 6 * 400**2


@pytest.mark.parametrize("size", [2048, 25])
def test_operator_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(covertree, "CELL", size)
    monkeypatch.setattr(covertree, "BLOCK", size)
    rows = sample(9)
    df = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<float>, node string")
    got = covertree.linked(df.repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert covertree.linked(df).collect() == []
    only = spark.createDataFrame([(4, None)], "vec_id long, embedding array<float>")
    assert list(map(tuple, covertree.linked(only).collect())) == [(4, 0, 4, True)]


def around(x, rng, angle):
    """Unit vectors at the angle from those of x."""
    y = rng.normal(size=x.shape)
    y = covertree.unit(y - (y * x).sum(axis=1, keepdims=True) * x)
    return np.cos(angle) * x + np.sin(angle) * y


@pytest.mark.parametrize("many", [0.0, 0.05, 1.0])
@pytest.mark.parametrize("rank", [64, 12])
def test_large_leaves_meet_by_cones_and_bounds(monkeypatch, many, rank):
    """Leaves of spread vectors, with pairs planted close to either side of the threshold."""
    monkeypatch.setattr(covertree, "MANY", many)
    rng = np.random.default_rng(5)
    spread = rng.normal(size=(900, 64)) * np.where(np.arange(64) < rank, 1, 0.05)
    x = covertree.unit(np.concatenate([spread, spread[:300] * 3, rng.normal(size=(40, 64)) * 0.1 + 1]))
    near = np.concatenate([around(x, rng, np.arccos(0.9) + d) for d in (-1e-6, 1e-6, -1e-3)])
    for basis in (None, covertree.basis_of(x, 0.9), np.eye(64)[:, :16]):
        a, b = covertree.Tree(x, basis), covertree.Tree(near, basis)
        wa, wb = np.ones(len(x), np.int64), rng.integers(1, 5, len(near))
        ca, cb, _ = covertree.block_links(a, wa, b, wb, False, 0.9)
        full = a.x @ b.x.T >= 0.9
        assert (ca == full @ wb).all() and (cb == full.sum(axis=0)).all() and full.sum() >= 2 * len(x)
        again = covertree.Tree.unpacked(b.x, **b.packed(), basis=basis)
        assert all((p == q).all() for p, q in zip(covertree.block_links(a, wa, again, wb, False, 0.9), (ca, cb, _)))


def test_bands_keep_all_vectors_of_a_cell_together():
    size = {0: 3, 1: 4, 2: 25, 3: 2, 4: 9}
    start, many = covertree.packed_cells([0, 1, 2, 3, 4], size, 10)
    assert start.tolist() == [0, 0, 1, 4, 5] and many.tolist() == [1, 1, 3, 1, 1]
    x = covertree.unit(np.random.default_rng(0).normal(size=(33, 5)))
    assert sorted(covertree.near_order(x)) == list(range(33))
    assert sorted(np.concatenate(list(covertree.cuts(x, 4))).tolist()) == list(range(33))


def test_widths_that_the_sample_misses(spark, monkeypatch):
    monkeypatch.setattr(covertree, "SAMPLE", 1)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=2 + i % 4).tolist()) for i in range(60)]
    rows += [(100 + i, [float(c) * 2 for c in v]) for i, v in rows[:20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, covertree.linked(df).collect()), key=repr) == brute(rows)


def held(tops):
    """Bytes of all files below."""
    total = 0
    for top in tops:
        for folder, _, names in os.walk(top):
            for name in names:
                with contextlib.suppress(FileNotFoundError):
                    total += os.lstat(os.path.join(folder, name)).st_size
    return total


def test_disk_follows_the_vectors_not_the_pairs_of_blocks(spark, monkeypatch):
    """Most that the session's own and its shared folder hold while the operator runs."""
    monkeypatch.setattr(covertree, "CELL", 50)
    monkeypatch.setattr(covertree, "BLOCK", 50)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(3000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    own = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    tops = [*map(str, own), shared_dir(spark).removeprefix("file:")]
    before, seen, over = held(tops), [], threading.Event()

    def look():
        while not over.wait(0.05):
            seen.append(held(tops) - before)

    watch = threading.Thread(target=look)
    watch.start()
    try:
        got = covertree.linked(df).collect()
    finally:
        over.set()
        watch.join()
    assert len(got) == 3000 and {r["n_links"] for r in got} == {0}
    assert max(seen) < 8 * vectors.nbytes

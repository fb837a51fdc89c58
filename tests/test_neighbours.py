from __future__ import annotations

import numpy as np
import pytest

from tidemark.operators import joins, neighbours


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>, label int, far double").repartition(3)


def clustered(n, cells, d=6, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(cells, d)) * 100
    return [(i, [float(c) for c in centres[i % cells] + rng.normal(size=d)], i % cells, 0.0) for i in range(n)]


def expected(test, train, k, leave):
    out = {}
    for i, v, *_ in test:
        gaps = sorted((sum((a - b) ** 2 for a, b in zip(v, u)), j) for j, u, *_ in train if not (leave and i == j))
        out[i] = [j for _, j in gaps[:k]]
    return out


def ranked(found):
    got: dict = {}
    for r in sorted(found.collect(), key=lambda r: (r.test_id, r.rank)):
        got.setdefault(r.test_id, []).append(r.train_id)
    return got


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 8)


@pytest.mark.parametrize("leave,blocks", [(False, 4096), (True, 16)])
def test_equals_brute_force(spark, small_cells, leave, blocks):
    rows = clustered(240, 9)
    hot = [float(x) for x in rows[3][1]]
    rows += [(1_000 + i, hot, i % 2, 0.0) for i in range(120)]  # a third of all rows are one vector
    rng = np.random.default_rng(5)
    rows += [(2_000 + i, [float(x) for x in rng.integers(-150, 150, 6)], 0, 0.0) for i in range(40)]
    test, train = (rows, rows) if leave else (rows[::3], rows[1::3])
    found = neighbours.nearest_neighbours(frame(spark, test), frame(spark, train), "id", "v", "label", 4, blocks, leave)
    assert ranked(found) == expected(test, train, 4, leave)


def test_few_cells_are_visited_on_clustered_data(spark, small_cells):
    rows = clustered(600, 20)
    df = frame(spark, rows)
    join = neighbours.Join(df, df, "id", "v", "label", 3, 4096, True)
    cells = len(join.pivots)
    assert cells > 30
    assert sum(join.sent.values()) < 0.2 * cells * 600  # of the meetings of rows with cells
    assert ranked(join.result()) == expected(rows, rows, 3, True)


def test_evenly_spread_rows_are_sent_a_bounded_number_of_times(spark, small_cells, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_BLOCKS", 3)
    monkeypatch.setattr(neighbours, "MOST_COPIES", 8)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=24)], i % 5, 0.0) for i in range(400)]
    df = frame(spark, rows)
    join = neighbours.Join(df, df, "id", "v", "label", 3, 64, True)
    assert join.sent == {0: 400} and join._shipped() <= 8 * 800
    assert ranked(join.result()) == expected(rows, rows, 3, True)


@pytest.mark.parametrize("far", [0.0, 1e6, 1e9])
@pytest.mark.parametrize("tile", [(512, 4_096), (7, 11)])
def test_single_precision_loses_no_neighbour(monkeypatch, far, tile):
    monkeypatch.setattr(neighbours, "TILE", tile)
    rng = np.random.default_rng(9)
    x = far + np.vstack([rng.normal(size=(60, 5)), rng.integers(-2, 3, (60, 5)), 1e-4 * rng.normal(size=(40, 5)), [[50.0] * 5] * 3])
    ids = rng.permutation(len(x)) * 3
    best = neighbours.nearest(x[::2], ids[::2], x, ids, 4, True)
    for i in range(len(x[::2])):
        exact = ((x - x[2 * i]) ** 2).sum(1)
        want = [j for j in np.lexsort((ids, exact)) if j != 2 * i][:4]
        assert list(best.column[best.row == i]) == want


def test_edges(spark):
    good = [(1, [0.0, 0.0], 1, 0.0), (2, [-0.0, 0.0], 2, 0.0), (3, [1.0, 0.0], 3, 0.0)]
    bad = [(4, None, 1, 0.0), (5, [], 1, 0.0), (6, [None, 1.0], 1, 0.0), (7, [float("nan"), 1.0], 1, 0.0), (8, [float("inf"), 0.0], 1, 0.0)]
    df = frame(spark, good + bad)
    found = neighbours.nearest_neighbours(df, df, "id", "v", "label", 5, leave_one_out=True)
    assert ranked(found) == {1: [2, 3], 2: [1, 3], 3: [1, 2]}
    none = frame(spark, [])
    assert neighbours.nearest_neighbours(df, none, "id", "v", "label").collect() == []
    assert neighbours.nearest_neighbours(none, df, "id", "v", "label").collect() == []


def test_class_shares(spark):
    rows = [(1, 5), (1, 2), (1, 5), (1, None), (2, 9)]
    got = joins.class_shares(spark.createDataFrame(rows, "test_id long, train_label long")).collect()
    assert {(r.test_id, r.train_label): r.share for r in got} == {(1, 5): 0.5, (1, 2): 0.25, (1, None): 0.25, (2, 9): 1.0}

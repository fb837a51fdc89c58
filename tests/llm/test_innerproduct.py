from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import innerproduct as ip

SCHEMA = "vec_id long, embedding array<double>, score int, width string"


def expected(rows, k, ask):
    good = []
    for i, v in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(64 * x) for x in v]))
    out = []
    for n, (q, u) in enumerate(good):
        if q is None or not ask(q):
            continue
        found = [(-sum(a * b for a, b in zip(u, v)), i is None, i or 0, m, i) for m, (i, v) in enumerate(good) if m != n and len(u) == len(v)]
        out += [(q, r + 1, f[4], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def vectors(seed, n=300, d=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.exp(rng.normal(size=(n, 1))) * np.linspace(3, 0.05, d)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    hot = rows[5][1]
    rows += [(1_000 + i, hot) for i in range(120)] + [(2_000, [0.0] * d), (2_020, [0.0] * d), (40, rows[3][1]), (40, rows[3][1])]
    rows += [(None, hot), (None, None), (60, None), (80, [None] + [1.0] * (d - 1)), (100, [float("nan")] * d), (120, [float("inf")] * d)]
    rows += [(140, []), (160, []), (181, [])] + [(3_000 + i, [float(i % 7), -0.3]) for i in range(45)]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block,ask", [(0, ip.BLOCK_BYTES, 32 << 20), (1, 6_000, 4_000), (2, 2_000, 1_000)])
def test_equals_brute_force(spark, seed, block, ask):
    rows = vectors(seed)
    df = frame(spark, rows).repartition(3)
    got = ip.top_k(df, F.col("id") % 20 == 0, k=7, block_bytes=block, query_bytes=ask)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows, 7, lambda i: i % 20 == 0)


def test_report_equals_the_twin(spark):
    df = frame(spark, vectors(4)).repartition(2)
    embeddings = df.select("vec_id", "embedding").toArrow()  # noqa: F841
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    theirs = sorted(con.execute(ip.TWIN).fetchall(), key=repr)
    assert sorted(map(tuple, ip.report(df).collect()), key=repr) == theirs


def test_large_components(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([1e9, -3e8, 2.5, 1e3]) * rng.random() for _ in range(4)]) for i in range(90)]
    rows += [(200, [1e300, 1.0, 1.0, 1.0]), (220, [1.7e308, 1.0, 1.0, 1.0])]
    got = ip.top_k(frame(spark, rows), F.col("id") % 20 == 0, k=5).collect()
    small = [r for r in rows if r[0] < 200]
    cut = 2**63 - 1
    want = {}
    for q, u in rows[:-1]:
        if q % 20 == 0:
            a = [math.floor(64 * x) for x in u]
            s = [(-max(-cut - 1, min(cut, sum(x * math.floor(64 * y) for x, y in zip(a, v)))), i) for i, v in [*small, rows[-2]] if i != q]
            want[q] = [(i, -x) for x, i in sorted(s)[:5]]
    mine: dict = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        mine.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert mine == want


def test_pruning_skips_most_pairs(monkeypatch):
    rng = np.random.default_rng(0)
    x = np.floor(64 * rng.normal(size=(4_000, 32)) * np.exp(rng.normal(size=(4_000, 1))) * np.linspace(2, 0.01, 32) ** 2)
    _, turn = np.linalg.eigh(x.T @ x)
    block = ip.Block(x, np.arange(4_000), np.arange(4_000), turn[:, ::-1].copy(), 5)
    assert block.lead < 32
    scored = []
    whole, pairs = ip.scores, ip.pair_scores
    monkeypatch.setattr(ip, "scores", lambda a, b, t: (scored.append(len(a) * len(b)), whole(a, b, t))[1])
    monkeypatch.setattr(ip, "pair_scores", lambda a, b, t: (scored.append(len(a)), pairs(a, b, t))[1])
    best = block.meet(x[:100], np.arange(100), np.full(100, -ip.LARGEST - 1), 5)
    full = x[:100] @ x.T
    full[np.arange(100), np.arange(100)] = -np.inf
    assert (best.score == -np.sort(-full, axis=1)[:, :5]).all()
    assert sum(scored) < 0.4 * 100 * 4_000


def test_empty_table(spark):
    assert ip.report(spark.createDataFrame([], SCHEMA)).collect() == []

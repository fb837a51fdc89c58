from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact

ROWS = (
    [(i, f"text {i % 7}") for i in range(40)]
    + [(100, None), (101, ""), (None, ""), (102, "x" * 50_000), (103, "x" * 50_000), (104, "é"), (105, "é")]
    + [(7, "text 0"), (7, "text 0"), (200, "only null"), (None, "alone"), (None, "alone"), (300, " text 0")]
)


def expected(rows):
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def check(df, rows):
    got = df.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected(rows)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert sorted(r.text_sha256 for r in kept) == sorted({r[3] for r in expected(rows)})


@pytest.mark.parametrize("capacity", [exact.BUCKET_BYTES, 64])
def test_groups(spark, capacity):
    df = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in ROWS], "doc_id long, text string, key string, sha string, page int")
    check(exact.exact_groups(df.repartition(5), capacity=capacity), ROWS)


def test_colliding_keys_are_told_apart_by_bytes(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)
    check(exact.exact_groups(df, key=F.lit(5).cast("long"), capacity=64), ROWS)
    check(exact.exact_groups(df, key=F.length("text").cast("long"), capacity=64), ROWS)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact.exact_groups(df).collect() == []
    assert exact.drop_copies(df).collect() == []


def test_drop_copies_keeps_columns_and_one_row_each(spark):
    rows = [(i, t, f"s{n}") for n, (i, t) in enumerate(ROWS)]
    got = exact.drop_copies(spark.createDataFrame(rows, "doc_id long, text string, sha string"))
    assert got.columns == ["doc_id", "text", "sha"]
    got = got.collect()
    assert sorted(r.text or "" for r in got) == sorted({t or "" for _, t in ROWS})
    keep = {(t or ""): max((x for x, u in ROWS if (u or "") == (t or "") and x is not None), default=None) for _, t in ROWS}
    assert all(keep[r.text or ""] == r.doc_id for r in got)


@pytest.mark.parametrize("seed", range(6))
def test_directory(seed):
    rng = np.random.default_rng(seed)
    weights = rng.integers(0, 50, 1 << 8)
    weights[rng.integers(0, 256)] += 5000  # a hot key
    d = exact.Directory(8, weights).grow(400)
    assert len(d.slots) == 1 << d.depth
    assert sum(d.weight(b) for b in range(len(d.local))) == weights.sum()
    for b, (prefix, depth) in enumerate(d.local):
        assert d.weight(b) <= 400 or depth == 8
        width = d.depth - depth
        assert [i for i, s in enumerate(d.slots) if s == b] == list(range(prefix << width, (prefix + 1) << width))

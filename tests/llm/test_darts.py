from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import darts
from tidemark.llm.components import components

U = np.uint64


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def runs(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_classes(rows, threshold=0.8):
    sets = [runs(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_run = {}
    for i, s in enumerate(sets):
        for r in s:
            by_run.setdefault(r, []).append(i)
    shared = {}
    for own in by_run.values():
        for n, i in enumerate(own):
            for j in own[n + 1 :]:
                shared[i, j] = shared.get((i, j), 0) + 1
    for (i, j), n in shared.items():
        if n / (len(sets[i]) + len(sets[j]) - n) >= threshold:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    out = []
    for g in groups.values():
        least = min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
        out += [(rows[i][0], least, len(g)) for i in g]
    return sorted(out, key=repr)


def check(df, rows):
    got = df.collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=repr) == brute_classes(rows)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.class_id for r in kept)
    sizes = {}
    for r in got:
        if words(dict(rows).get(r.doc_id)) or r.class_size > 1:
            sizes[r.class_id] = r.class_size
    return got


@pytest.mark.parametrize("window", [64, 1 << 18])
def test_word_hashes(monkeypatch, window):
    monkeypatch.setattr(darts, "WINDOW", window)
    texts = ["Some words, SOME more", "", "x" * 300, "é1 2", None, "a " * 500, "some"]
    h, owner = darts.word_hashes([(t or "").encode() for t in texts])
    want = [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert owner.tolist() == [i for i, _ in want]
    seen = {}
    for (_, w), value in zip(want, h.tolist()):
        assert seen.setdefault(w, value) == value
    assert len(set(seen.values())) == len(seen)


def test_shingles_follow_the_words():
    texts = ["one two three four five six", "one two", "", "two three four five six", "one two", "x y z w"]
    w, o = darts.word_hashes([t.encode() for t in texts])
    s, of = darts.shingles(w, o, len(texts))
    sets = [set(s[of == i].tolist()) for i in range(len(texts))]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(sets[i] & sets[j]) == len(runs(a) & runs(b))


@pytest.mark.parametrize("n", [1, 3, 40, 5000])
def test_darts_equal_a_plain_process(n):
    """Every coordinate holds the earliest dart, whatever the limit was."""
    e = darts.mix(np.arange(n, dtype=U))
    got = darts.throw(e, np.zeros(n, np.int64), 1)[0]
    assert (got != U(2**64 - 1)).all()
    both = darts.throw(np.concatenate([e, e[: n // 2 + 1]]), np.repeat([0, 1], [n, n // 2 + 1]), 2)
    assert (both[0] == got).all()
    assert (np.minimum(both[1], both[0]) == both[0]).all()  # a subset has no earlier dart


def test_agreement_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    hits, total, want = 0, 0, 0.0
    for _ in range(60):
        e = darts.mix(rng.integers(0, 2**62, 80).astype(U))
        a, b = rng.gamma(2, 1.5, 80), rng.gamma(2, 1.5, 80)
        a[:10], b[70:] = 0, 0
        l, s, o = darts.layered(np.concatenate([e, e]), np.concatenate([a, b]), np.repeat([0, 1], 80))
        sig = darts.throw(l, o, 2, s)
        hits += (sig[0] == sig[1]).sum()
        total += darts.COORDINATES
        want += np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs(hits / total - want / 60) < 0.03


def test_multiplicities():
    e, o = np.array([5, 5, 7, 5, 7], U), np.array([0, 0, 0, 1, 1])
    got = darts.multiplicities(e, o)
    assert len(set(got[:3])) == 3 and got[0] == got[3] and got[2] == got[4]


def family(rng, base, n, change):
    out = []
    for _ in range(n):
        w = list(base)
        for i in rng.choice(len(w), change, replace=False):
            w[i] = f"z{rng.integers(1e9)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    texts = []
    for size, n, change in ((300, 30, 2), (120, 25, 2), (80, 20, 2), (200, 15, 6), (40, 12, 1), (60, 12, 1)):
        base = [f"w{x}" for x in rng.integers(0, 400, size)]
        texts += family(rng, base, n, change)
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"q{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(20)]
    texts += [texts[0]] * 9 + [texts[3].upper() + "!!"] * 3 + ["a b c", "a b c", "A b, c", "a b", "", None, "...", ""]
    out = [(int(i), t) for i, t in zip(rng.permutation(len(texts)) + 10, texts)]
    return out + [(None, texts[40]), (None, "only null ids here now"), out[5], out[5]]


def test_groups_equal_brute_force(spark, rows):
    df = spark.createDataFrame([(i, t, "b", 3) for i, t in rows], "doc_id long, text string, bands string, node int")
    got = check(darts.near_groups(df.repartition(6)), rows)
    worded = {}
    for r in got:
        worded.setdefault((r.class_id, r.class_size), []).append(r.kept)
    assert all(sum(k) == 1 for (c, n), k in worded.items() if n > 1)


def test_pair_stages_are_exact_without_luck(spark, rows, monkeypatch):
    """With a single leader round and small chunks, comparing across components finds the same groups."""
    monkeypatch.setattr(darts, "LEADER_ROUNDS", 1)
    monkeypatch.setattr(darts, "CHUNK", 5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(darts.near_groups(df), rows)


def test_drop_near_and_empty(spark, rows):
    rows = [(i, t, f"s{n}") for n, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = darts.drop_near(df)
    assert got.columns == df.columns
    groups = {(c, n if c is not None else i) for n, (i, c, _) in enumerate(brute_classes([r[:2] for r in rows]))}
    assert got.count() >= len({c for c, _ in groups})
    assert darts.near_groups(df.limit(0)).collect() == []
    assert darts.drop_near(df.limit(0)).collect() == []


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 - i) for i in range(1, 40)]
    edges += [tuple(map(int, e)) for e in rng.integers(2000, 2200, (150, 2))] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    df = spark.createDataFrame(edges, "u long, v long").withColumn("u", F.col("u"))
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import repeats


def brute(words, least=6, power=4):
    """start, end, smallest period of every stretch that no neighbour extends."""
    found: dict = {}
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, power * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


def texts_of(rng):
    out = []
    for _ in range(rng.randint(1, 6)):
        w = [rng.randrange(rng.choice([1, 2, 3, 12])) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p, at = rng.randint(1, 7), rng.randint(0, len(w))
            unit = [rng.randrange(5) for _ in range(p)]
            w[at:at] = [unit[i % p] for i in range(rng.randint(1, 60))]
        out.append(w)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(120):
        texts, power, least = texts_of(rng), rng.choice([4, 4, 5, 6]), rng.choice([6, 1])
        ids = np.array([x for w in texts for x in w], np.int64)
        got = repeats.find_runs(ids, np.repeat(np.arange(len(texts)), [len(w) for w in texts]), least, power)
        want, at = [], 0
        for w in texts:
            want += [(s + at, e + at, q) for s, e, q in brute(w, least, power)]
            at += len(w)
        assert list(zip(*(x.tolist() for x in got))) == want


def test_nonterminals_are_searched_once_and_cover_all_copies():
    unit = list(range(40))
    words = np.array((unit + [1000] + unit + [1001] + unit) * 1)
    nodes = repeats.grammar(words, np.zeros(len(words), np.int64))
    left, cut, right, owner, places = nodes.columns()
    assert len(left) < len(places)  # copies share nodes
    for k in range(len(left)):
        own = words[left[k] : right[k]]
        for p in places[owner == k]:
            assert (words[p : p + len(own)] == own).all()
    assert (cut > left).all() and (right > cut).all()


@pytest.mark.parametrize("words", [[0] * 30_000, [i % 7 for i in range(30_000)], [i // 6 % 50 for i in range(30_000)]])
def test_long_texts(words):
    got = repeats.find_runs(np.array(words), np.zeros(len(words), np.int64))
    want = [(0, 30_000, 1)] if words[0] == words[1] == words[29] else [(0, 30_000, 7)] if words[1] == 1 else [(i, i + 6, 1) for i in range(0, 30_000, 6)]
    if words[0] == words[5] != words[6]:  # stretches of six, and the whole with period 300
        want = sorted([*want, (0, 30_000, 300)])
    assert list(zip(*(x.tolist() for x in got))) == want


def test_hash_collisions_only_cause_another_try(monkeypatch):
    tries = []
    equal = repeats.Matcher.equal

    def blind(self, low, high, n):
        return np.ones(len(low), bool) if len(tries) == 1 else equal(self, low, high, n)

    start = repeats.Matcher.__init__
    monkeypatch.setattr(repeats.Matcher, "__init__", lambda self, w, seed: (tries.append(seed), start(self, w, seed))[1])
    monkeypatch.setattr(repeats.Matcher, "equal", blind)
    words = np.array([9, 8] + [1, 2] * 5 + [7, 6, 1, 2, 3])
    got = repeats.find_runs(words, np.zeros(len(words), np.int64))
    assert [x.tolist() for x in got] == [[2], [12], [2]] and tries == [0, 1]


TEXTS = [
    None, "", " \t\n", "a", "x x x x x x", "x x x x x", "a b a b a b a b c", "pre a b c " * 4 + "end", "é é é é " * 7,
    "one two three four five six seven eight nine ten " * 3, "\x0bq\x0cq\rq\nq\tq q  q", "w " * 5_000 + "v", "A a A a A a A a", "long" * 30_000,
]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
    runs = brute(words)
    dropped = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    shown = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_report_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(TEXTS[:-3])] + [(None, TEXTS[4]), (4, TEXTS[4]), (4, TEXTS[4])]
    rows += [(100 + i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90)))) for i in range(250)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, runs string, start int")
    got = repeats.report(df.repartition(3))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(i, t) for i, t in rows), key=repr)


def test_scan_keeps_columns_and_collapses(spark):
    df = spark.createDataFrame([(t, 5, "k") for t in TEXTS], "text string, n_words int, collapsed string")
    got = repeats.scan(df, ["n_words", "collapsed"]).collect()
    assert [r[:2] for r in map(tuple, got)] == [(5, "k")] * len(TEXTS)
    by_size = {r[2]: r for r in map(tuple, got)}
    assert by_size[5_001][3][0] == (0, 5_000, 1) and by_size[5_001][4] == "w v"


def test_empty_table(spark):
    assert repeats.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []

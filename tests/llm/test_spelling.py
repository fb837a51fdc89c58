from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import spelling


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def counts_of(rows):
    n: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{word}".encode())
                if h % 31 == 0:
                    word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def expected(rows):
    n, form, near = counts_of(rows), {}, {}
    for w in n:
        near[w] = [v for v in n if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def edited(rng, word, letters):
    at, kind = rng.randrange(len(word)), rng.randrange(3)
    c = rng.choice(letters)
    return (word[:at] + c + word[at:], word[:at] + word[at + 1 :], word[:at] + c + word[at + 1 :])[kind]


@pytest.mark.parametrize("seed", range(4))
def test_pairs_equal_brute_force(spark, seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(spelling, "HOT", 5)
    rng = random.Random(seed)
    letters = "ab" if seed < 2 else "abcdefgé×"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(120)}
    for w in list(words):
        words |= {e for _ in range(3) if len(e := edited(rng, w, letters)) >= 4}
    words |= {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aabaaaaa", "x" * 3_000, "x" * 3_001, "x" * 1_500 + "y" + "x" * 1_499}
    words = sorted(words)
    got = spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    want = sorted((u, v) for u in words for v in words if one_edit(u, v))
    assert sorted(map(tuple, got)) == want


def test_pivots_share_no_letter_and_are_the_cheapest():
    rng = random.Random(0)
    for _ in range(500):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(4, 12)))
        grams = {word[i : i + 2] for i in range(len(word) - 1)}
        counts = {g: rng.randint(1, 50) for g in grams}
        rank = {g: i for i, g in enumerate(sorted(grams, key=lambda g: (counts[g], g)))}
        prefix, chosen, last = spelling.pivots(word, counts, rank)
        assert prefix == [i for i in range(len(word) - 1) if rank[word[i : i + 2]] <= last] and len(prefix) >= 3
        cost = [counts[word[i : i + 2]] for i in range(len(word) - 1)]
        assert cost[chosen[0]] <= cost[chosen[1]]
        best = min(cost[i] + cost[j] for i in prefix for j in prefix if j >= i + 2)
        assert abs(chosen[1] - chosen[0]) >= 2 and cost[chosen[0]] + cost[chosen[1]] == best


def test_report_equals_brute_force(spark):
    rng = random.Random(5)
    base = ["variant", "spelling", "Distance", "frequency", "élémentaire", "ÀBCDEFG×", "aaaaaaaa", "position", "petition"]
    rows = [(None, " ".join(["unnumbered"] * 25 + ["unumbered"] * 2)), (0, None), (1, ""), (2, "short wörds only 123 ££"), (3, "longest" + "x" * 5_000)]
    rows += [(3, "repeated repeated repeats."), (3, "repeated repeated repeats.")]
    for i in range(400):
        words = [rng.choice(base) for _ in range(rng.randint(0, 30))]
        words += [edited(rng, rng.choice(base), "abcdeé") for _ in range(rng.randint(0, 3))]
        words += [edited(rng, edited(rng, rng.choice(base), "ae"), "ae") for _ in range(2)]
        rows.append((10 + i, rng.choice([" ", ", ", "-", "1"]).join(words)))
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = spelling.report(df.repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got, want = sorted(map(tuple, got.collect())), expected(rows)
    assert got == want
    assert any(r[1] is not None for r in got)


def test_forms_lead_to_the_last(spark):
    counted = [("chained", 2), ("chaineds", 30), ("chainneds", 400), ("changed", 20), ("chaaneds", 400), ("another", 5)]
    got = spelling.variants(spark.createDataFrame(counted, "word string, n long")).collect()
    assert sorted(map(tuple, got)) == [
        ("another", None, "another", 5, 0, None), ("chaaneds", None, "chaaneds", 400, 1, None), ("chained", "chaineds", "chaaneds", 2, 1, 30),
        ("chaineds", "chaaneds", "chaaneds", 30, 3, 400), ("chainneds", None, "chainneds", 400, 1, None), ("changed", None, "changed", 20, 0, None),
    ]


def test_long_chains_of_forms(spark):
    forms = [(f"w{i:03}", f"w{i + 1:03}") for i in range(37)] + [("a", "w036")]
    got = spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()
    assert {r.word: r.root for r in got} == {w: "w037" for w, _ in forms}


def test_empty_table(spark):
    assert spelling.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []

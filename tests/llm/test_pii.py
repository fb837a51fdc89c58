from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    s = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (2 if i % 2 else 1)
        s += d if d < 10 else d - 9
    return s % 10 == 0


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), order, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


PIECES = st.lists(st.sampled_from(["a", "b.c", "@", ".", "x@y.z", "1", "255", "256", "1.2.3.4", "000001", "+", "-", " ", "(", "4465758382889437", "é", "_", "+1 (743) 555-3824", "%"]), max_size=14).map("".join)


@settings(max_examples=500, deadline=None)
@given(PIECES)
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_base_scans_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 60_000, "+1" + " " * 100_000, "+" * 50_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def field():
    return pii.trained(tuple(pii.LABELLED))


def test_viterbi_equals_all_paths(field):
    rng = np.random.default_rng(0)
    small = pii.Field(rng.normal(size=field.emit.shape), rng.normal(size=field.step.shape))
    rows = [rng.integers(0, pii._SHAPES * 2, n) for n in (1, 2, 3, 4, 3, 1)]
    for row, got in zip(rows, small.decode(rows, batch=4)):
        e = small.scores(pii._padded([row])[0])[0]

        def total(path):
            return sum(e[t, k] for t, k in enumerate(path)) + sum(small.step[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product(range(len(pii.LABELS)), repeat=len(row)), key=total)
        assert tuple(got) == best


def test_gradient():
    rng = np.random.default_rng(1)
    f = pii.Field(0.3 * rng.normal(size=(5, pii._SHAPES * 2, len(pii.LABELS))), 0.3 * rng.normal(size=(len(pii.LABELS),) * 2))
    xs, ys = pii.labelled_rows(pii.LABELLED[:5])
    padded, size = pii._padded(xs)
    gold = np.zeros((5, padded.shape[1] - 4), np.int64)
    for i, y in enumerate(ys):
        gold[i, : len(y)] = y
    base, emit, step = pii.likelihood(f, padded, size, gold)
    for p, g in ((f.emit, emit), (f.step, step)):
        for at in zip(*np.unravel_index(rng.choice(np.flatnonzero(g), 8), g.shape)):
            p[at] += 1e-5
            up = pii.likelihood(f, padded, size, gold)[0]
            p[at] -= 1e-5
            assert abs((up - base) / 1e-5 - g[at]) < 1e-3


def test_field_learns_the_table_and_unseen_lines(field):
    xs, ys = pii.labelled_rows(pii.LABELLED)
    assert np.mean([np.array_equal(a, b) for a, b in zip(field.decode(xs), ys)]) > 0.95
    unseen = {
        "please call (617) 555-0188 tomorrow": ["phone"], "tel 030 / 7654321 bitte": ["phone"], "ssn 321-54-9876 here": ["id"],
        "in 2011 there were 77 of them": [], "on 03-11-2020 it was 5.30": [], "words without any": [],
    }
    for text, want in unseen.items():
        assert [k for _, _, k in pii.field_spans(field, [text])[0]] == want, text


def test_clean_documents_are_left_alone(field):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    found = pii.combined(field, texts)
    extra = [(t[s:e], k) for t, spans in zip(texts, found) for s, e, k in spans if k.startswith("crf_")]
    assert len(extra) < 0.01 * len(texts), extra[:20]


def test_report(spark):
    texts = ["", None, "é a.b@c.de +1 (743) 555-3824 1.2.3.4 1.2.3.999", "call (617) 555-0188", "plain", "4465758382889437 x " * 3, "9 " * 9000]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, texts[2], "s"), (2, texts[2], "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.report(df).collect()
    want = []
    for i, t, _ in rows:
        spans = brute(t)
        text = ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        want.append((i, *(sum(k == x for *_, k in spans) for x in PATTERNS), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert next(r.spans for r in got if r.doc_id == 3) == "crf_phone:5:19"
    assert pii.report(df.limit(0)).collect() == []


def test_addresses_with_very_long_parts():
    assert pii.base_spans("1.2.3." + "0" * 5_000) == [(0, 5_006, "ip")]
    assert pii.base_spans("1.2.3." + "0" * 5_000 + "255 1.2.3." + "9" * 5_000) == [(0, 5_009, "ip")]

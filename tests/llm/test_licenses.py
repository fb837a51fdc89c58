from __future__ import annotations

import random
import re

from tidemark.llm import licenses

TEXTS = [
    "", None, "CC BY and cc-by, cc by-sa 4.0 ccby", "GNU General Public License, version 2 or later. All rights reserved.",
    "SPDX-License-Identifier: Apache-2.0\nLicensed under the Apache License, Version 2.0", "all  RIGHTS\n* reserved all rights reserved",
    "Permission is hereby granted, free of charge, to any\n * person obtaining a copy", "École cc by É cc by", "general public licenseé",
    "https://creativecommons.org/licenses/by-nc-sa/3.0/", "the gnu lesser general public license v2.1", "plain words only here " * 5000,
    "gnu general public\n * license version 3 or later", "permission is hereby\n granted, free of\n# charge, to any person", "copyright (c) 2019 someone",
    "released into the public\ndomain", "some rights\n reserved", "gnu general public\nlicense, version 3", "x" * 100_000 + " cc by", "İ cc by",
]


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_equals_brute_force(spark):
    rows = [(i, t, "q") for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], None), (3, TEXTS[3], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = licenses.report(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr) == sorted(((i, *brute(t)) for i, t, _ in rows), key=repr)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert r.labels == ",".join(sorted(set(r.labels.split(",")))) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert by[3].labels == "gpl,gpl-2.0-or-later,reserved"
    assert by[4].labels == "apache-2.0" and by[4].score == 1.0
    assert by[6].labels == "mit" and by[9].labels == "cc-by-nc-sa-3.0" and by[10].labels == "gpl,lgpl-2.1"
    assert by[0].labels == by[11].labels == "" and by[11].score == 0.0
    assert licenses.report(df.limit(0)).collect() == []


def test_every_rule_is_gated_by_a_keyword_it_needs():
    rules = licenses.rules()
    assert len(rules) > 250
    own = licenses.scanner()
    for r, pattern in zip(rules, own.compiled):
        plain = re.sub(r"\\(.)", r"\1", r.pattern)
        assert r.keyword, r
        assert pattern.groups == 0
        assert any(k in plain.replace(licenses.S, " ").replace(licenses.S.replace("\\", ""), " ") for k in (r.keyword, r.keyword.split()[0])), r


def test_gate_loses_nothing_and_suppression_is_by_containment():
    own = licenses.scanner()
    for t in TEXTS:
        low = licenses.fold(t)[:3000]
        every = [(r.priority, m.start() - m.end(), m.start(), i, m.end()) for i, (r, p) in enumerate(zip(own.rules, own.compiled)) for m in p.finditer(low)]
        kept = []
        for f in sorted(every):
            if not any(k[2] <= f[2] and f[4] <= k[4] for k in kept):
                kept.append(f)
        want = sorted((f[2], f[4], own.rules[f[3]].label) for f in kept)
        assert [(f.start, f.end, f.label) for f in own.detections(low)] == want


def test_wrapped_notices_are_found():
    own = licenses.scanner()
    for phrase in ("gnu general public license version 3 or later", "permission is hereby granted, free of charge, to any person obtaining a copy", "released into the public domain", "some rights reserved", "gnu general public license, version 3"):
        labels = {f.label for f in own.detections(phrase)}
        assert labels
        words = phrase.split(" ")
        for i in range(1, len(words)):
            for gap in ("\n", "\n * ", " \n# ", "\t"):
                assert {f.label for f in own.detections(" ".join(words[:i]) + gap + " ".join(words[i:]))} >= labels, (phrase, i)


def test_containment_equals_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        found = [(s, s + rng.randint(1, 12)) for s in (rng.randint(0, 25) for _ in range(rng.randint(0, 30)))]
        kept: list = []
        want = []
        for s, e in found:
            free = not any(a <= s and e <= b for a, b in kept)
            want.append(free)
            if free:
                kept.append((s, e))
        assert licenses.outermost(found) == want
    many = [(i, i + 2) for i in range(60_000)]
    assert all(licenses.outermost(many))

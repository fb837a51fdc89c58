"""License scans by ordered signature rules.

Hundreds of rules, each a regular expression over lower-cased text with a label, a priority and the
keyword it cannot match without. One pass of an Aho-Corasick machine over the keywords of all rules, on
the text with its gaps folded to blanks (so a notice may wrap anywhere), gates them; only rules whose keyword occurs are run. Detections are then resolved in order of priority
(then length, place and rule): one that lies inside a detection already accepted is suppressed. Base
phrases are found by their words and never suppressed.

Rules come from hand-written patterns, some of them written once for a family with its versions.

Texts are handled whole; null counts as empty and holds no word. A-Z is folded, nothing else. Ties are
broken by rule order. Repeated rows give one result each; an empty table gives an empty result. Only the
columns in ``keep`` and the text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

ROWS_AT_ONCE = 512
FOLD = {c: c + 32 for c in range(0x41, 0x5B)}

#: Fixed: base phrases and their labels.
BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
S = r"[\s*#/;-]{1,6}"  # between words of a notice, across line ends and comment marks
O = r"(?:\s?|[ \t]*\n[\s*#/;-]{0,6})"  # a blank or a wrapped line
V = rf"(?:,?{O}(?:version{O}|ver\.?{O}|v\.?{O})?)"


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str
    priority: int  # 0 is looked at first
    weight: float  # confidence


def _words(text: str) -> str:
    return S.join(map(re.escape, text.split()))


def rules() -> list[Rule]:
    """All signature rules in order."""
    out: list[Rule] = []

    def add(label: str, pattern: str, keyword: str, priority: int, weight: float) -> None:
        out.append(Rule(label, pattern, keyword, priority, weight))

    # 1. identifiers in a tag, for every identifier below
    ids = [f"{g}-{v}{e}" for g, vs in (("gpl", ("1.0", "2.0", "3.0")), ("lgpl", ("2.0", "2.1", "3.0")), ("agpl", ("1.0", "3.0")), ("gfdl", ("1.1", "1.2", "1.3"))) for v in vs for e in ("-only", "-or-later")]
    ids += [f"cc-{c}-{v}" for c in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")]
    ids += """mit apache-1.0 apache-1.1 apache-2.0 bsd-1-clause bsd-2-clause bsd-3-clause bsd-4-clause 0bsd isc zlib unlicense
        wtfpl mpl-1.0 mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 cddl-1.0 cddl-1.1 cpl-1.0 ipl-1.0 artistic-1.0
        artistic-2.0 bsl-1.0 busl-1.1 psf-2.0 python-2.0 ruby openssl openldap-2.8 ofl-1.1 odbl-1.0 odc-by-1.0 pddl-1.0 cc0-1.0
        ms-pl ms-rl afl-3.0 osl-3.0 ecl-2.0 ncsa postgresql vim x11 sspl-1.0 upl-1.0 unicode-dfs-2016 cecill-2.1 lppl-1.3c
        mulanpsl-2.0 apsl-2.0 curl json php-3.01 nasa-1.3 sleepycat w3c zpl-2.1 blueoak-1.0.0""".split()
    for i in ids:
        add(i, rf"spdx-license-identifier:\s*\(?{re.escape(i)}\b(?![.-]?\w)", "spdx-license-identifier", 0, 1.0)

    # 2. addresses of license texts
    sites = {"mit": "mit", "apache-2.0": r"apache-2\.0", "bsd-3-clause": "bsd-3-clause", "bsd-2-clause": "bsd-2-clause", "isc": r"isc(?:-license)?(?:\.txt)?",
             "mpl-2.0": r"mpl-2\.0", "epl-2.0": r"epl-2\.0", "gpl-3.0": r"gpl-3\.0", "lgpl-3.0": r"lgpl-3\.0", "agpl-3.0": r"agpl-3\.0", "unlicense": "unlicense", "zlib": "zlib"}
    for label, path in sites.items():
        add(label, rf"opensource\.org/licenses?/{path}\b", "opensource.org/license", 1, 0.95)
    for c in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            add(f"cc-{c}-{v}", rf"creativecommons\.org/licenses/{c}/{re.escape(v)}\b", "creativecommons.org/licenses/", 1, 0.95)
    add("cc0-1.0", r"creativecommons\.org/publicdomain/zero/1\.0\b", "creativecommons.org/publicdomain", 1, 0.95)
    add("public-domain", r"creativecommons\.org/publicdomain/mark/1\.0\b", "creativecommons.org/publicdomain", 1, 0.95)
    add("apache-2.0", r"apache\.org/licenses/license-2\.0\b", "apache.org/licenses", 1, 0.95)
    add("apache-1.1", r"apache\.org/licenses/license-1\.1\b", "apache.org/licenses", 1, 0.95)
    add("mpl-2.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0\b", "mozilla.org/", 1, 0.95)
    add("epl-2.0", r"eclipse\.org/legal/epl-(?:2\.0|v20)\b", "eclipse.org/legal", 1, 0.95)
    add("epl-1.0", r"eclipse\.org/legal/epl-v10\b", "eclipse.org/legal", 1, 0.95)
    add("bsl-1.0", r"boost\.org/license_1_0\.txt", "boost.org/license", 1, 0.95)
    add("unlicense", r"unlicense\.org\b", "unlicense.org", 1, 0.9)
    add("ofl-1.1", r"scripts\.sil\.org/ofl\b", "scripts.sil.org", 1, 0.9)
    for g in ("gpl", "lgpl", "agpl", "fdl"):
        for v in ("1.2", "1.3", "2.0", "2.1", "3.0"):
            add(f"{'gfdl' if g == 'fdl' else g}-{v}", rf"gnu\.org/licenses/(?:old-licenses/)?{g}-{re.escape(v)}\b", "gnu.org/licenses", 1, 0.95)
        add("gfdl" if g == "fdl" else g, rf"gnu\.org/(?:copyleft|licenses)/{g}\b", "gnu.org/", 2, 0.85)

    # 3. names with a version
    gnu = {"gpl": "general public licen[cs]e", "lgpl": "(?:lesser|library) general public licen[cs]e", "agpl": "affero general public licen[cs]e", "gfdl": "free documentation licen[cs]e"}
    for short, name in gnu.items():
        named = rf"(?:gnu{S})?" + name.replace(" ", S)
        for v in ("1", "1.1", "1.2", "1.3", "2", "2.1", "3"):
            number = re.escape(v) + (r"(?:\.0)?" if "." not in v else "")
            full = v if "." in v else f"{v}.0"
            add(f"{short}-{full}-or-later", rf"{named}{V}{number}(?![.\d]),?{S}or{S}(?:\(at your option\){S})?(?:any later|later)", "public licen" if short != "gfdl" else "documentation licen", 2, 0.95)
            add(f"{short}-{full}", rf"{named}{V}{number}(?![.\d])", "public licen" if short != "gfdl" else "documentation licen", 3, 0.9)
            add(f"{short}-{full}", rf"\b(?:gnu )?{short}\s?[ v-]\s?{number}(?![.\d])", short, 4, 0.85)
        add(short, named, "public licen" if short != "gfdl" else "documentation licen", 6, 0.7)
    for label, name, versions in (
        ("apache", "apache (?:software )?licen[cs]e", ("1.0", "1.1", "2.0")), ("mpl", "mozilla public licen[cs]e", ("1.0", "1.1", "2.0")),
        ("epl", "eclipse public licen[cs]e", ("1.0", "2.0")), ("cddl", "common development and distribution licen[cs]e", ("1.0", "1.1")),
        ("eupl", "european union public licen[cs]e", ("1.1", "1.2")), ("osl", "open software licen[cs]e", ("2.0", "2.1", "3.0")),
        ("afl", "academic free licen[cs]e", ("2.1", "3.0")), ("artistic", "artistic licen[cs]e", ("1.0", "2.0")),
        ("bsl", "boost software licen[cs]e", ("1.0",)), ("ofl", "(?:sil )?open font licen[cs]e", ("1.0", "1.1")),
        ("cpl", "common public licen[cs]e", ("1.0",)), ("sspl", "server side public licen[cs]e", ("1.0",)),
        ("busl", "business source licen[cs]e", ("1.0", "1.1")), ("odbl", "open (?:data commons open )?database licen[cs]e", ("1.0",)),
        ("ecl", "educational community licen[cs]e", ("1.0", "2.0")), ("upl", "universal permissive licen[cs]e", ("1.0",)),
        ("psf", "python software foundation licen[cs]e", ("2.0",)), ("cecill", "cecill free software licen[cs]e", ("1.0", "2.0", "2.1")),
        ("lppl", "latex project public licen[cs]e", ("1.2", "1.3")), ("mulanpsl", "mulan permissive software licen[cs]e", ("1.0", "2.0")),
        ("apsl", "apple public source licen[cs]e", ("1.0", "2.0")), ("zpl", "zope public licen[cs]e", ("2.0", "2.1")),
    ):
        named = re.sub(r" (?![^(]*\))", lambda m: S, name)
        keyword = max(re.findall(r"[a-z ]+", re.sub(r"\(.*?\)|licen.*", "", name)), key=len).strip().split()[-1]
        for v in versions:
            number = re.escape(v).replace(r"\.0", r"(?:\.0)?")
            add(f"{label}-{v}", rf"{named}{V}{number}(?![.\d])", keyword, 3, 0.9)
        add(label, named, keyword, 6, 0.7)
    kinds = {"by": "attribution", "by-sa": "attribution[- ]share-?alike", "by-nc": "attribution[- ]non-?commercial", "by-nd": "attribution[- ]no-?deriv(?:ative)?s(?: works)?",
             "by-nc-sa": "attribution[- ]non-?commercial[- ]share-?alike", "by-nc-nd": "attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s(?: works)?"}
    for c, name in kinds.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            add(f"cc-{c}-{v}", rf"creative{S}commons{S}{name}(?: licen[cs]e)?{V}{re.escape(v)}\b", "creative", 2, 0.95)
            add(f"cc-{c}-{v}", rf"\bcc[ -]{c}[ -]v?{re.escape(v)}\b", "cc", 3, 0.9)
        add(f"cc-{c}", rf"\bcc[ -]{c}\b(?![ -]?\w)", "cc", 6, 0.7)

    # 4. phrases of license texts and notices
    for label, text, keyword, weight in (
        ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy", "hereby granted", 0.95),
        ("mit", "the above copyright notice and this permission notice shall be included in all copies", "permission notice", 0.8),
        ("isc", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee", "permission to use", 0.95),
        ("bsd", "redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution", 0.9),
        ("bsd-3-clause", "may be used to endorse or promote products derived from this software", "endorse", 0.85),
        ("bsd-4-clause", "all advertising materials mentioning features or use of this software", "advertising materials", 0.95),
        ("zlib", "this software is provided 'as-is', without any express or implied warranty", "as-is", 0.9),
        ("zlib", "the origin of this software must not be misrepresented", "misrepresented", 0.95),
        ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 0.95),
        ("wtfpl", "do what the fuck you want to public license", "you want to public", 0.95),
        ("apache-2.0", "licensed under the apache license, version 2.0", "apache license", 0.95),
        ("gpl", "this program is free software: you can redistribute it and/or modify it", "free software", 0.8),
        ("gpl", "this program is free software; you can redistribute it and/or modify it", "free software", 0.8),
        ("lgpl", "this library is free software; you can redistribute it and/or modify it", "free software", 0.85),
        ("agpl", "remote network interaction; use with the gnu general public license", "remote network", 0.95),
        ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "source code form", 0.95),
        ("epl", "this program and the accompanying materials are made available under the terms of the eclipse", "accompanying materials", 0.9),
        ("bsl-1.0", "boost software license - version 1.0", "boost", 0.95),
        ("ofl-1.1", "this font software is licensed under the sil open font license", "font software", 0.95),
        ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain", "public domain", 0.95),
        ("public-domain", "released into the public domain", "public domain", 0.75),
        ("public-domain", "this work is in the public domain", "public domain", 0.75),
        ("public-domain", "no rights reserved", "rights reserved", 0.7),
        ("reserved", "some rights reserved", "rights reserved", 0.5),
        ("proprietary", "proprietary and confidential", "proprietary", 0.8),
        ("proprietary", "unauthorized copying of this file", "unauthorized copying", 0.8),
        ("proprietary", "unauthorised copying of this file", "unauthorised copying", 0.8),
        ("proprietary", "not for redistribution", "redistribution", 0.6),
        ("dual", "dual licensed under the mit and gpl licenses", "dual licensed", 0.85),
        ("free-use", "free for personal use", "personal use", 0.5),
        ("free-use", "free for non-commercial use", "commercial use", 0.5),
        ("php", "this source file is subject to version 3.01 of the php license", "php license", 0.95),
        ("ncsa", "university of illinois/ncsa open source license", "ncsa", 0.95),
        ("postgresql", "provided that the above copyright notice and this paragraph and the following two paragraphs appear", "two paragraphs", 0.9),
        ("curl", "copyright and permission notice", "permission notice", 0.5),
        ("json", "the software shall be used for good, not evil", "not evil", 0.95),
    ):
        add(label, _words(text), keyword, 2, weight)
    for label, pattern, keyword, weight in (
        ("mit", rf"\b(?:the )?mit{S}(?:\(expat\) )?licen[cs]e\b", "mit", 0.85),
        ("mit", rf"\blicen[cs]ed{S}under{S}(?:the )?mit\b", "mit", 0.85),
        ("isc", rf"\bisc{S}licen[cs]e\b", "isc", 0.85),
        ("bsd-2-clause", r"\b(?:simplified bsd|bsd 2-clause|2-clause bsd|freebsd licen[cs]e)\b", "bsd", 0.9),
        ("bsd-3-clause", r"\b(?:new bsd|modified bsd|bsd 3-clause|3-clause bsd)\b", "bsd", 0.9),
        ("bsd-4-clause", r"\b(?:original bsd|bsd 4-clause|4-clause bsd)\b", "bsd", 0.9),
        ("bsd", rf"\bbsd{S}licen[cs]ed?\b", "bsd", 0.75),
        ("zlib", rf"\bzlib(?:/libpng)?{S}licen[cs]e\b", "zlib", 0.85),
        ("wtfpl", r"\bwtfpl\b", "wtfpl", 0.9),
        ("ruby", rf"\bruby(?:'s)?{S}licen[cs]e\b", "ruby", 0.8),
        ("openssl", rf"\bopenssl{S}licen[cs]e\b", "openssl", 0.85),
        ("vim", rf"\bvim{S}licen[cs]e\b", "vim", 0.85),
        ("x11", rf"\bx11{S}licen[cs]e\b", "x11", 0.85),
        ("ms-pl", rf"\bmicrosoft{S}public{S}licen[cs]e\b", "microsoft", 0.9),
        ("ms-rl", rf"\bmicrosoft{S}reciprocal{S}licen[cs]e\b", "microsoft", 0.9),
        ("w3c", rf"\bw3c{S}software{S}(?:notice{S}and{S})?licen[cs]e\b", "w3c", 0.9),
        ("unicode", rf"\bunicode{S}(?:inc\.? )?licen[cs]e{S}agreement\b", "unicode", 0.9),
        ("copyright", r"\bcopyright\s{1,3}(?:\(c\)|©)?\s{0,3}(?:19|20)\d\d\b", "copyright", 0.4),
        ("copyright", r"(?:\(c\)|©)\s{0,3}(?:19|20)\d\d\b", "20", 0.35),
        ("copyright", r"(?:\(c\)|©)\s{0,3}19\d\d\b", "19", 0.35),
    ):
        add(label, pattern, keyword, 5, weight)
    return out


@dataclass(frozen=True)
class Found:
    start: int
    end: int
    label: str
    priority: int
    weight: float


def gate_text(text: str) -> str:
    """``text`` with one blank for every run of blanks, line ends and comment marks, as ``S`` allows between words."""
    return " ".join(text.translate(GAPS).split())


GAPS = dict.fromkeys(map(ord, "*#/;-"), " ")


def outermost(found: list[tuple[int, int]]) -> list[bool]:
    """Whether each interval (start, end) lies in none that was accepted before it.

    Largest accepted ends by start, in a tree of prefix maxima: logarithmic steps for an interval."""
    starts = sorted({s for s, _ in found})
    place = {s: i + 1 for i, s in enumerate(starts)}
    tree = [-1] * (len(starts) + 1)
    out = []
    for s, e in found:
        at, widest = place[s], -1
        while at:
            widest, at = max(widest, tree[at]), at & (at - 1)
        out.append(widest < e)
        if widest < e:
            at = place[s]
            while at < len(tree):
                tree[at], at = max(tree[at], e), at + (at & -at)
    return out


class Scanner:
    def __init__(self, own: list[Rule]):
        self.rules = own
        self.compiled = [re.compile(r.pattern) for r in own]
        self.machine = ahocorasick.Automaton()
        by_keyword: dict[str, list[int]] = {}
        for i, r in enumerate(own):
            by_keyword.setdefault(gate_text(r.keyword), []).append(i)
        # a keyword that holds a shorter one is found whenever the shorter one's rules are needed
        for keyword, numbers in by_keyword.items():
            self.machine.add_word(keyword, numbers)
        self.machine.make_automaton()
        self.base = [(re.compile(rf"(?<!{_WORD})" + _GAP.join(words) + rf"(?!{_WORD})"), label, words[0]) for words, label in BASE.items()]
        table = np.zeros(256, bool)
        table[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
        self.is_word = table

    def detections(self, text: str) -> list[Found]:
        """Detections left after suppression, by place; ``text`` is lower-cased."""
        gated = {i for _, numbers in self.machine.iter(gate_text(text)) for i in numbers}
        found = []
        for i in sorted(gated):
            r = self.rules[i]
            found += [(r.priority, m.start() - m.end(), m.start(), i, m.end()) for m in self.compiled[i].finditer(text)]
        found.sort()
        kept = [
            Found(start, end, self.rules[i].label, priority, self.rules[i].weight)
            for (priority, _, start, i, end), free in zip(found, outermost([(f[2], f[4]) for f in found]))
            if free
        ]
        return sorted(kept, key=lambda f: (f.start, f.end))

    def places(self, text: str) -> list[tuple[int, str]]:
        """Start and label of every base phrase."""
        out = []
        for pattern, label, first in self.base:
            if first in text:
                out += [(m.start(), label) for m in pattern.finditer(text)]
        return sorted(out)

    def words(self, text: str, at: list[int]) -> tuple[int, list[int]]:
        """Number of words, and the word index at each of the given characters."""
        data = np.frombuffer(text.encode(), np.uint8)
        inside = self.is_word[data]
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        if not at:
            return len(starts), []
        offsets = [len(text[:c].encode()) for c in at]
        return len(starts), np.searchsorted(starts, offsets).tolist()


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(rules())


def fold(text: str | None) -> str:
    return (text or "").translate(FOLD)


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("label", StringType()), StructField("weight", DoubleType())]))
OUT = [
    StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()),
    StructField("last_word", LongType()), StructField("base_labels", ArrayType(StringType())), StructField("detections", SPANS),
]
_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()),
          pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("weight", pa.float64())]))]


def scan(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, word counts, base places and the detections (spans in code points) of each text."""
    if clash := {f.name for f in OUT} & set(keep):
        raise ValueError(f"kept columns are named like outputs: {sorted(clash)}")
    slim = df.select(*keep, F.col(text).alias("__source"))

    def one(text: str | None) -> tuple:
        own, low = scanner(), fold(text)
        base = own.places(low)
        n, index = own.words(low, [p for p, _ in base])
        spans = [{"start": f.start, "end": f.end, "label": f.label, "weight": f.weight} for f in own.detections(low)]
        return n, len(base), min(index, default=None), max(index, default=None), sorted({x for _, x in base}), spans

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                made = list(zip(*map(one, b.column(b.num_columns - 1).to_pylist())))
                columns = [pa.array(list(c), kind) for c, kind in zip(made, _ARROW)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], [*keep, *(f.name for f in OUT)])

    kept = [f for f in slim.schema.fields if f.name != "__source"]
    return slim.mapInArrow(work, StructType([*kept, *OUT]))


BASE_WEIGHT = 0.9


def report(df: DataFrame) -> DataFrame:
    """Counts, labels and score (the most confident detection) of each document."""
    own = F.transform("detections", lambda d: d["label"])
    weights = F.transform("detections", lambda d: d["weight"])
    score = F.greatest(F.coalesce(F.array_max(weights), F.lit(0.0)), F.when(F.col("n_base") > 0, BASE_WEIGHT).otherwise(0.0))
    return scan(df.select("doc_id", "text"), ["doc_id"]).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", own)), ",").alias("labels"),
        score.alias("score"),
    )

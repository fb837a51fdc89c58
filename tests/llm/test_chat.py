from __future__ import annotations

import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat

PIECES = st.lists(st.sampled_from(["\\", "###", " ", ": ", ":", "</turn>", "\n", "a", "assistant", "é", "#", "</", "turn>"]), max_size=12).map("".join)


@settings(max_examples=600, deadline=None)
@given(PIECES, PIECES)
def test_round_trip(role, text):
    out, turn = chat.formatted(role, text)
    assert (turn.role, turn.text) == (role, text)
    strongest, _ = chat.parse(chat.render(role, text, 2))
    assert (strongest.role, strongest.text) == (role, text)
    two = chat.parse_all(out + chat.formatted("x", role)[0] + out)
    assert [(t.role, t.text) for t in two] == [(role, text), ("x", role), (role, text)]


def test_malformed_input_is_refused():
    for bad in ("### a b</turn>\n", "### a: b", "x", "### a: ### b: c</turn>\n", "### a: b</turn>x"):
        with pytest.raises(chat.NotATurn):
            chat.parse_all(bad)


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "ho ### x: </turn>"), (1, 2, "assistant", ""), (2, 0, None, None),
    (3, 1, "assistant", "b\\"), (3, 0, "assistant", "\\</turn>\\\\"), (3, 1, "assistant", "b\\"), (None, None, "user", "é🙂"),
    (None, 4, "assistant", "z"), (4, 0, "odd: role\\", "x" * 50_000), (5, 7, "system", "only"),
]


def expected(rows):
    groups: dict = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(loss), sha(loss), sum(len(chat.formatted(r, x)[0]) for *_, r, x in turns)))
    return sorted(out, key=repr)


def test_summaries_equal_brute_force_and_the_twin(spark):
    df = spark.createDataFrame([(*r, "n") for r in ROWS], "conv_id long, turn long, role string, text string, position string")
    hard = [(-7, 0, "user", chat.HARD[1]), (-7, 1, "assistant", chat.HARD[1])]
    got = chat.summaries(chat.with_hard_case(df)).collect()
    assert sorted(map(tuple, got), key=repr) == expected(ROWS + hard)
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toArrow())
    cur = con.execute(chat.twin())
    names = [d[0] for d in cur.description]
    assert sorted((tuple(dict(zip(names, r))[c] for c in got[0].asDict()) for r in cur.fetchall()), key=repr) == sorted(map(tuple, got), key=repr)


def test_segments_read_back_and_their_loss_spans(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").repartition(4)
    segments = chat.format_turns(df)
    back = {}
    for r in chat.read_back(segments).collect():
        back.setdefault(r.conv_id, []).append((r.position, r.role, r.text))
    texts, spans = {}, {}
    for s in sorted(segments.collect(), key=lambda s: s.position):
        assert s.start == len(texts.get(s.conv_id, ""))
        texts[s.conv_id] = texts.get(s.conv_id, "") + s.segment
        if s.loss_start is not None:
            spans.setdefault(s.conv_id, []).append((s.loss_start, s.loss_end))
    for c, text in texts.items():
        turns = chat.parse_all(text)
        assert [(t.role, t.text) for t in turns] == [x[1:] for x in sorted(back[c])]
        masked = [chat._unescaped(text[a:b]) for a, b in spans.get(c, [])]
        assert masked == [t.text for t in turns if t.role == "assistant"]
    assert chat.summaries(df.limit(0)).collect() == []

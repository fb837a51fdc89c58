"""Chat formatting with a grammar that reads its own output back.

A turn is written as ``### role: text</turn>`` and a line end. ``###`` and ``</turn>`` are control
strings, and so is ``: `` inside a role. The parser is deterministic: of a run of backslashes in front of
a control string each pair stands for one backslash, and an odd one makes the control string plain text;
backslashes elsewhere are plain.

Every turn is rendered without escapes first and reparsed; while the recovered role and text are not
identical to the source, the next stronger escape is applied (control strings, then the backslashes in
front of them as well), which the grammar is proved to invert. A turn that still differs is an error.

Conversations may be of any length: turns are spread by conversation, sorted, and written, parsed and
digested as a stream, so a task holds one turn and not a conversation. The order is turn, role, text; null
turns come first. Null roles and texts count as empty. A null conversation id is one conversation.
Repeated rows are turns of their own. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, SEPARATOR, CLOSE = "### ", ": ", "</turn>"
END = CLOSE + "\n"
LEARNED = "assistant"  # the role under the loss mask

_IN_ROLE = re.compile(rf"(\\*)({re.escape(OPEN.strip())}|{re.escape(CLOSE)}|{re.escape(SEPARATOR)})")
_IN_TEXT = re.compile(rf"(\\*)({re.escape(OPEN.strip())}|{re.escape(CLOSE)})")


def escape(text: str, control: re.Pattern, strength: int) -> str:
    """0: as it is; 1: control strings; 2: also backslashes in front of control strings and of the end."""
    if strength == 0:
        return text
    if strength == 1:
        return control.sub(r"\1\\\2", text)
    text = control.sub(lambda m: m[1] * 2 + "\\" + m[2], text)
    tail = len(text) - len(text.rstrip("\\"))
    return text + "\\" * tail


def render(role: str, text: str, strength: int) -> str:
    return OPEN + escape(role, _IN_ROLE, strength) + SEPARATOR + escape(text, _IN_TEXT, strength) + END


@dataclass(frozen=True)
class Turn:
    role: str
    text: str
    loss: tuple[int, int] | None  # formatted characters under the loss mask


class NotATurn(ValueError):
    pass


def _until(source: str, at: int, control: re.Pattern, stop: str) -> tuple[str, int, int]:
    """Unescaped text up to the first plain ``stop``; its end, and where reading goes on."""
    out, here = [], at
    while m := control.search(source, here):
        slashes = len(m[1])
        out.append(source[here : m.start()] + "\\" * (slashes // 2))
        if slashes % 2:
            out.append(m[2])
        elif m[2] == stop:
            return "".join(out), m.start(2), m.end()
        else:
            raise NotATurn(f"{m[2]!r} at {m.start(2)}")
        here = m.end()
    raise NotATurn(f"no {stop!r} after {at}")


def parse(source: str, at: int = 0) -> tuple[Turn, int]:
    """The turn that begins at ``at``, and where the next one begins."""
    if not source.startswith(OPEN, at):
        raise NotATurn(f"no turn at {at}")
    role, _, at = _until(source, at + len(OPEN), _IN_ROLE, SEPARATOR)
    text, end, after = _until(source, at, _IN_TEXT, CLOSE)
    if source[after : after + 1] != "\n":
        raise NotATurn(f"no line end at {after}")
    return Turn(role, text, (at, end) if role == LEARNED else None), after + 1


def parse_all(source: str) -> list[Turn]:
    turns, at = [], 0
    while at < len(source):
        turn, at = parse(source, at)
        turns.append(turn)
    return turns


def formatted(role: str, text: str) -> tuple[str, Turn]:
    """The weakest rendering that reads back as the same single turn."""
    for strength in range(3):
        out = render(role, text, strength)
        try:
            turn, end = parse(out)
        except NotATurn:
            continue
        if end == len(out) and (turn.role, turn.text) == (role, text):
            return out, turn
    raise NotATurn(f"turn cannot be written: {role[:40]!r}")


SEGMENTS = "conv_id long, position long, segment string, start long, loss_start long, loss_end long"
SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
ROWS_OUT = 1_000


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows in order -> one dict per written turn, with the places of its loss mask in the conversation."""
    current: tuple = ()
    position = start = 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_OUT):
            for row in batch.slice(at, ROWS_OUT).to_pylist():
                if current != (row["conv_id"],):
                    current, position, start = (row["conv_id"],), 0, 0
                segment, turn = formatted(row["role"], row["text"])
                loss = turn.loss or (None, None)
                yield {
                    "conv_id": row["conv_id"], "position": position, "segment": segment, "start": start,
                    "loss_start": None if turn.loss is None else start + loss[0],
                    "loss_end": None if turn.loss is None else start + loss[1],
                }
                position, start = position + 1, start + len(segment)


def _unescaped(text: str) -> str:
    return _until(text + CLOSE, 0, _IN_TEXT, CLOSE)[0]


def _summaries(segments: Iterator[dict]) -> Iterator[dict]:
    """Digest each conversation from its written segments alone."""
    current: tuple = ()
    state: dict = {}

    def done() -> dict:
        return {
            "conv_id": current[0], "n_turns": state["n"], "turns_sha256": state["turns"].hexdigest(),
            "loss_chars": state["chars"], "loss_sha256": state["loss"].hexdigest(), "formatted_chars": state["size"],
        }

    for s in segments:
        if current != (s["conv_id"],):
            if current:
                yield done()
            current = (s["conv_id"],)
            state = {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "size": 0}
        for turn in parse_all(s["segment"]):
            state["n"] += 1
            state["turns"].update(f"{turn.role}\n{turn.text}\n".encode())
        if s["loss_start"] is not None:
            masked = _unescaped(s["segment"][s["loss_start"] - s["start"] : s["loss_end"] - s["start"]])
            state["loss"].update(masked.encode())
            state["chars"] += len(masked)
        state["size"] += len(s["segment"])
    if current:
        yield done()


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS_OUT:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_L, _S = pa.int64(), pa.string()
_SEGMENTS = pa.schema([("conv_id", _L), ("position", _L), ("segment", _S), ("start", _L), ("loss_start", _L), ("loss_end", _L)])
_SUMMARY = pa.schema([("conv_id", _L), ("n_turns", _L), ("turns_sha256", _S), ("loss_chars", _L), ("loss_sha256", _S), ("formatted_chars", _L)])


def _ordered(turns: DataFrame) -> DataFrame:
    slim = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(turns: DataFrame) -> DataFrame:
    """The formatted conversations, one row per turn: segments put together in order of position are the
    text of a conversation; the loss span counts code points from the conversation's start."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_segments(batches), _SEGMENTS)

    return _ordered(turns).mapInArrow(work, SEGMENTS)


def read_back(segments: DataFrame) -> DataFrame:
    """Turns parsed from formatted segments: conv_id, position, role, text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", _L), ("position", _L), ("role", _S), ("text", _S)])
        rows = (
            {"conv_id": r["conv_id"], "position": r["position"] + i, "role": t.role, "text": t.text}
            for b in batches
            for r in b.to_pylist()
            for i, t in enumerate(parse_all(r["segment"]))
        )
        return _batches(rows, schema)

    return segments.select("conv_id", "position", "segment").mapInArrow(work, "conv_id long, position long, role string, text string")


def summaries(turns: DataFrame) -> DataFrame:
    """Digests per conversation, read back from what was written; one pass over sorted turns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_summaries(_segments(batches)), _SUMMARY)

    return _ordered(turns).mapInArrow(work, SUMMARY)


#: A conversation whose texts hold the control strings, in both roles.
HARD = (-7, "\\### Assistant: </turn> ok")


def with_hard_case(turns: DataFrame) -> DataFrame:
    rows = [(HARD[0], 0, "user", HARD[1]), (HARD[0], 1, "assistant", HARD[1])]
    hard = turns.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(hard)


def twin() -> str:
    """The summaries in DuckDB SQL; sizes follow from the strongest escape, which changes nothing else."""
    slashes = r"regexp_replace({}, '(\\*)(###|</turn>{})', '\1\1\\\2', 'g')"
    tail = r"length(regexp_extract({}, '\\*$'))"
    role, text = slashes.format("r", "|: "), slashes.format("t", "")
    return f"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
      UNION ALL SELECT {HARD[0]}, 0, 'user', '{HARD[1]}' UNION ALL SELECT {HARD[0]}, 1, 'assistant', '{HARD[1]}')
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
      coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
      sum({len(OPEN + SEPARATOR + END)} + length({role}) + {tail.format("r")} + length({text}) + {tail.format("t")})::BIGINT AS formatted_chars
    FROM turns GROUP BY conv_id
    """

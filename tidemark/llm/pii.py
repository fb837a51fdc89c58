"""Personal data: four base expressions, and a linear-chain conditional random field over word shapes.

**Base.** Leftmost, non-overlapping matches per kind; each kind is found by a scan that is linear in the
text. They are always reported.

**Field.** Tokens are runs of letters, runs of digits and single marks. A token's features are the
shapes (letter case, digit count, the mark, a cue word, a blank before it) of itself and its two
neighbours on each side. Weights and label transitions are fitted on a small labelled table by maximum
likelihood (forward-backward, batched), and stretches of text are decoded by Viterbi in numpy batches.
A stretch is what lies around digits and ``@``: up to ``CONTEXT`` tokens on each side, joined where they
meet. Every entity must hold a digit or ``@``, so nothing outside a stretch can be one. A decoded span is
added, as ``crf_<kind>``, unless it overlaps a base span.

Whole texts are handled; null counts as empty. Repeated rows give one result each; an empty table gives
an empty result. Only the columns in ``keep`` and the text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

ROWS_AT_ONCE = 256
CONTEXT = 4

#: Fixed: base kinds in order.
BASE = ["email", "ip", "card", "phone"]
KINDS = ["email", "ip", "card", "phone", "id"]
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        else:
            last = at + 1  # no match can reach back over this sign
        at = text.find("@", last)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _part(digits: str) -> bool:
    """Whether digits of any number, leading zeros among them, are 255 at most."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind."""
    out = [(s, e, "email") for s, e in _emails(text)]
    if "." in text:
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(_part(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


#: The labelled table: entities in brackets with their kind.
LABELLED = """
call me on [phone:(555) 123-4567] after six
phone: [phone:555-123-4567], ask for the office
Tel. [phone:0171 2345678] or by letter
mobile [phone:0049 171 2345678] anytime
fax [phone:(212) 555 0199] is out of order
my number is [phone:415.555.2671] thanks
reach us at [phone:1-800-555-0142] today
Telefon [phone:030 / 1234567] im Büro
tel [phone:089 / 998877] abends bitte
telefon [phone:0221 / 445566] heute
tel: [phone:01 42 68 53 00] le matin
contact [phone:+1 (743) 555-3824] for details
and the [phone:+44 20 7946 0958] of the
[phone:555-0123-456] is her phone
the line [phone:(771) 555-1655] was busy
SSN [id:123-45-6789] on file
ssn: [id:078-05-1120] was used
social security number [id:219-09-9999] in the form
his id [id:987-65-4321], see above
tax number [id:457-55-5462] and name
IBAN [id:DE44 5001 0517 5407 3249 31] bank
account [id:GB29 NWBK 6016 1331 9268 19] in London
iban [id:FR14 2004 1010 0505 0001 3] svp
passport no [id:C01X00T47] issued
write to [email:john.smith@mail] now
mail [email:anna@intranet] for access
the [email:first.last@example.com] address
email: [email:re.46@mail8.example.com] only
from [ip:10.20.30.40] to the host
server [ip:192.168.0.1] is down
the [ip:70.23.22.57] of the
card [card:4465 7583 8288 9437] expires
paid by [card:4111-1111-1111-1111] today
the [card:4465758382889437] number
in 2019 there were 123 cases and 45 deaths
on 12-05-2021 we met, and on 2021-05-12 again
version 1.2.3 of 2020 was released
pages 123-456 of volume 7
at 10:30 and 18:45 every day
a price of 1,234.50 or 12.99 each
the ratio is 3.14159 to 1
order 12345678 was shipped
chapter 12, section 3.4, figure 5
between 1914-1918 and 1939-1945
he scored 3-2 in 1998
room 101 on floor 3
20 % of 500 people, 7 of 10
call 3 of them in 5 minutes
see equation (12) and table (3)
the score was 21-19 and 15-21
article 15(2) of law 123/2004
a 1000-page book of 2005
isbn 978-3-16-148410-0 in print
Q3 2020 grew by 4.5 to 17.2
born 1980, died 2001
x = 100 + 200 - 300
items 1, 2, 3, 4 and 5
phone calls rose by 45 to 1,200 in 2018
number 5 is alive
the id of the row is 42
mail arrived 3 times
twitter @someone and @another
meet @ noon
a@b is a group
5 @ 10 each
over 9000 words, 555 lines
section 555 of code 1234
the 100-200-300 rule
1-2-3 and 4-5-6
on 555-12 street
""".strip().split("\n")

_ENTITY = re.compile(r"\[(email|ip|card|phone|id):([^\]]*)\]")

_CLASS = np.full(256, 3, np.int8)  # 0 blank, 1 letter, 2 digit, 3 mark
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[0x30:0x3A] = 2
_MARKS = b"@.-()+/:,#%"
_CUES = "phone tel telefon fax mobile number contact call ssn social security id tax iban account passport no mail email card address from to".split()
_LETTERS, _DIGITS, _OTHER = len(_MARKS) + 1, len(_MARKS) + 5, len(_MARKS)
_CUE = _DIGITS + 11
_SHAPES = _CUE + len(_CUES) + 1  # the last one stands beyond the ends
_OFFSETS = (-2, -1, 0, 1, 2)


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray  # shape * 2 + blank before
    trigger: np.ndarray


def tokens(data: np.ndarray) -> Tokens:
    """Tokens of UTF-8 bytes, offsets in bytes."""
    kind = _CLASS[data]
    edge = np.ones(len(data), bool)
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(data))
    solid = kind[starts] != 0
    blank = np.zeros(len(starts), bool)
    blank[1:] = ~solid[:-1]
    starts, ends, blank = starts[solid], ends[solid], blank[solid]
    k, size = kind[starts], ends - starts
    shape = np.full(len(starts), _OTHER)
    for i, c in enumerate(_MARKS):
        shape[(k == 3) & (data[starts] == c)] = i
    upper = (data >= 0x41) & (data <= 0x5A)
    ups = np.concatenate([[0], np.cumsum(upper)])
    count = ups[ends] - ups[starts]
    first = upper[starts]
    case = np.where(count == 0, 0, np.where(first & (count == 1), 1, np.where(count == size, 2, 3)))
    shape = np.where(k == 1, _LETTERS + case, shape)
    shape = np.where(k == 2, _DIGITS + np.minimum(size, 11) - 1, shape)
    return Tokens(starts, ends, shape * 2 + blank, (k == 2) | ((k == 3) & (data[starts] == 0x40)))


def stretches(t: Tokens) -> list[tuple[int, int]]:
    """Token ranges around the triggers."""
    at = np.flatnonzero(t.trigger)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 2 * CONTEXT)
    first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    return list(zip(np.maximum(0, first - CONTEXT).tolist(), np.minimum(len(t.start), last + CONTEXT + 1).tolist()))


def shapes(data: bytes, t: Tokens, a: int, b: int) -> np.ndarray:
    """Shapes of a stretch, with cue words told apart."""
    out = t.shape[a:b].copy()
    for i in range(a, b):
        if t.end[i] - t.start[i] <= 8 and _LETTERS * 2 <= t.shape[i] < _DIGITS * 2:
            word = data[t.start[i] : t.end[i]].decode("utf-8", "replace").lower()
            if word in _CUES:
                out[i - a] = (_CUE + _CUES.index(word)) * 2 + (out[i - a] & 1)
    return out


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shapes with two places beyond each end, and the lengths."""
    size = np.array([len(r) for r in rows])
    out = np.full((len(rows), size.max() + 4), (_SHAPES - 1) * 2)
    for i, r in enumerate(rows):
        out[i, 2 : 2 + len(r)] = r
    return out, size


@dataclass
class Field:
    emit: np.ndarray  # offset x shape x label
    step: np.ndarray  # label x label

    def scores(self, padded: np.ndarray) -> np.ndarray:
        n = padded.shape[1] - 4
        return sum(self.emit[i][padded[:, 2 + o : 2 + o + n]] for i, o in enumerate(_OFFSETS))

    def decode(self, rows: list[np.ndarray], batch: int = 512) -> list[np.ndarray]:
        """Viterbi labels, in batches of stretches of similar length."""
        out: list = [None] * len(rows)
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            padded, size = _padded([rows[i] for i in part])
            e = self.scores(padded)
            best = e[:, 0].copy()
            back = np.zeros(e.shape, np.int8)
            for t in range(1, e.shape[1]):
                through = best[:, :, None] + self.step[None]
                back[:, t] = through.argmax(axis=1)
                on = (t < size)[:, None]
                best = np.where(on, through.max(axis=1) + e[:, t], best)
            label = best.argmax(axis=1)
            path = np.zeros((len(part), e.shape[1]), np.int8)
            for t in range(e.shape[1] - 1, -1, -1):
                path[:, t] = label
                if t:
                    label = np.where(t < size, back[np.arange(len(part)), t, label], label)
            for n, i in enumerate(part):
                out[i] = path[n, : size[n]]
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def likelihood(field: Field, padded: np.ndarray, size: np.ndarray, gold: np.ndarray):
    """Log likelihood of the gold labels and its gradients (emission, step)."""
    e = field.scores(padded)
    n, length, k = e.shape
    live = np.arange(length)[None] < size[:, None]
    fore, aft = np.zeros(e.shape), np.zeros(e.shape)
    fore[:, 0] = e[:, 0]
    for t in range(1, length):
        new = _logsum(fore[:, t - 1, :, None] + field.step[None], 1) + e[:, t]
        fore[:, t] = np.where(live[:, t, None], new, fore[:, t - 1])
    for t in range(length - 2, -1, -1):
        new = _logsum(field.step[None] + (e[:, t + 1] + aft[:, t + 1])[:, None, :], 2)
        aft[:, t] = np.where(live[:, t + 1, None], new, 0.0)
    z = _logsum(fore[:, -1], 1)
    one = np.eye(k)[gold] * live[:, :, None]
    total = (one * e).sum() - z.sum()
    left = one - np.exp(fore + aft - z[:, None, None]) * live[:, :, None]
    step = np.zeros((k, k))
    for t in range(1, length):
        on = live[:, t]
        pair = np.exp(fore[on, t - 1, :, None] + field.step[None] + (e[on, t] + aft[on, t])[:, None, :] - z[on, None, None])
        step -= pair.sum(axis=0)
        np.add.at(step, (gold[on, t - 1], gold[on, t]), 1)
        total += field.step[gold[on, t - 1], gold[on, t]].sum()
    emit = np.zeros_like(field.emit)
    for i, o in enumerate(_OFFSETS):
        np.add.at(emit[i], padded[:, 2 + o : 2 + o + length], left)
    return total, emit, step


def labelled_rows(lines: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Shapes and label numbers of each line of a labelled table."""
    xs, ys = [], []
    for line in lines:
        text, spans, at = "", [], 0
        for m in _ENTITY.finditer(line):
            text += line[at : m.start()]
            spans.append((len(text.encode()), len((text + m[2]).encode()), m[1]))
            text, at = text + m[2], m.end()
        data = (text + line[at:]).encode()
        t = tokens(np.frombuffer(data, np.uint8))
        y = np.zeros(len(t.start), np.int64)
        for s, e, kind in spans:
            own = np.flatnonzero((t.start >= s) & (t.end <= e))
            y[own] = LABELS.index(f"I-{kind}")
            y[own[0]] = LABELS.index(f"B-{kind}")
        xs.append(shapes(data, t, 0, len(t.start)))
        ys.append(y)
    return xs, ys


def fit(lines: list[str], rounds: int = 150, rate: float = 0.15, decay: float = 0.05) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam; deterministic."""
    xs, ys = labelled_rows(lines)
    padded, size = _padded(xs)
    gold = np.zeros((len(ys), padded.shape[1] - 4), np.int64)
    for i, y in enumerate(ys):
        gold[i, : len(y)] = y
    k = len(LABELS)
    barred = np.array([[b.startswith("I-") and a[2:] != b[2:] for b in LABELS] for a in LABELS])
    field = Field(np.zeros((len(_OFFSETS), _SHAPES * 2, k)), np.where(barred, -30.0, 0.0))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (field.emit, field.step)]
    for n in range(1, rounds + 1):
        _, *grads = likelihood(field, padded, size, gold)
        for p, g, m in zip((field.emit, field.step), grads, moments):
            g = g - decay * p
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p += rate * (m[0] / (1 - 0.9**n)) / (np.sqrt(m[1] / (1 - 0.99**n)) + 1e-8)
        field.step[barred] = -30.0
    return field


@lru_cache(maxsize=2)
def trained(lines: tuple[str, ...]) -> Field:
    return fit(list(lines))


def field_spans(field: Field, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the decoded entities of each text, in code points."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    rows, places = [], []
    for n, text in enumerate(texts):
        if not any(c in text for c in "@0123456789"):
            continue
        data = text.encode()
        t = tokens(np.frombuffer(data, np.uint8))
        for a, b in stretches(t):
            rows.append(shapes(data, t, a, b))
            places.append((n, data, t.start[a:b], t.end[a:b], t.trigger[a:b]))
    for labels, (n, data, start, end, trigger) in zip(field.decode(rows) if rows else [], places):
        if not labels.any():
            continue
        i = 0
        while i < len(labels):
            j = i + 1
            if labels[i]:
                kind = LABELS[labels[i]][2:]
                inner = LABELS.index(f"I-{kind}")
                while j < len(labels) and labels[j] == inner:
                    j += 1
                if trigger[i:j].any():
                    s = len(data[: start[i]].decode())
                    out[n].append((s, s + len(data[start[i] : end[j - 1]].decode()), kind))
            i = j
    return out


def combined(field: Field, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """Base spans, and those of the field that touch none of them."""
    whole = [t or "" for t in texts]
    out = []
    for base, more in zip(map(base_spans, whole), field_spans(field, whole)):
        every = list(base)
        for s, e, kind in more:
            if not any(a < e and s < b for a, b, _ in base):
                every.append((s, e, f"crf_{kind}"))
        order = BASE + [f"crf_{k}" for k in KINDS]
        out.append(sorted(every, key=lambda x: (x[0], order.index(x[2]))))
    return out


SPAN = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("kind", StringType())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def find(df: DataFrame, keep: list[str], text: str = "text", labelled: list[str] | None = None) -> DataFrame:
    """``keep`` and spans of each text."""
    if "spans" in keep:
        raise ValueError("a kept column is named like the output: spans")
    lines = tuple(LABELLED if labelled is None else labelled)
    slim = df.select(*keep, F.col(text).alias("__source"))
    field = trained(lines)  # a few thousand weights, sent with the task

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                found = combined(field, b.column(b.num_columns - 1).to_pylist())
                made = [[{"start": s, "end": e, "kind": k} for s, e, k in spans] for spans in found]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, _SPANS)], [*keep, "spans"])

    kept = [f for f in slim.schema.fields if f.name != "__source"]
    return slim.mapInArrow(work, StructType([*kept, StructField("spans", ArrayType(SPAN))]))


def report(df: DataFrame) -> DataFrame:
    """Counts and digest of the base kinds and all spans of each document."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find(df.select("doc_id", "text"), ["doc_id"]).select(
        "doc_id",
        *map(count, BASE),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(BASE))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )

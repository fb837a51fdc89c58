"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoder.

**Lookahead.** Apply the merge list to a text and to a longer text with that prefix. Let p be the
leftmost boundary on which the two runs differ at some moment. A rule ``i = (L, R)`` that removed p in
one run only has the token L in front of p, so the next boundary to differ lies ``len(L)`` bytes
further left, and only a *later* rule ``j`` can make it differ: one whose right side is L (in the run
that kept p) or a token whose left spine holds ``LR`` (in the run that merged). The longest such
chain, weighted with the lengths of the L, plus one token for the first step, bounds how far left the
end of the input can reach. ``MergeTable.lookahead`` is that bound, found in one backward pass over the
merge list. A token that ends at least so many bytes before the end of the buffer is final.

**Encoding.** ``StreamEncoder`` takes a text in pieces and emits tokens once they are stable. It holds
the unsettled tail of the text (a few characters, or one window of a pretoken that does not end), never
the text. Whole short pretokens go through the same transducer and are remembered in a bounded table.

**Decoding.** Token bytes pass through an incremental UTF-8 machine; malformed bytes become U+FFFD, one
per maximal ill-formed part.

Null texts count as empty; an empty text has no tokens. Repeated rows are encoded each. Ids outside the
vocabulary decode to nothing. Only the columns named in ``keep`` are carried, so other columns cannot
clash; a kept column named like an output is an error.
"""

from __future__ import annotations

import codecs
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Fixed: the pretoken pattern of the byte-level vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECE = 1 << 15  # characters given to the scanner at once
LONG_RUN = 1 << 12  # a pretoken this long is passed on before its end is seen
KNOWN_WORDS = 200_000  # remembered pretokens of a worker, in each of two generations
KNOWN_CHARS = 64  # longer pretokens are not remembered
ROWS_AT_ONCE = 256
NO_MERGE = 1 << 62
SIDE_BY_SIDE = 24  # characters of a pretoken that is merged together with others
UNSETTLED = 3  # characters that decide a contraction or the end of white space


def byte_symbols() -> dict[str, int]:
    """Printable stand-in -> byte: visible Latin-1 bytes stand for themselves, the others follow 255."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeTable:
    """Tokens as bytes, ranked merges, and the lookahead that suffices for them."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.tokens = tokens
        self.special = special
        self.base = {t[0]: i for i, t in tokens.items() if len(t) == 1 and i not in special.values()}
        self.rank = {(a << 32) | b: (r, c) for r, (a, b, c) in reversed(list(enumerate(merges)))}
        self.code = {pair: (r << 32) | c for pair, (r, c) in self.rank.items()}  # of the pairs that merge, by rank
        self.pairs = np.array(sorted(self.code), np.int64)
        self.pair_codes = np.array([self.code[int(p)] for p in self.pairs], np.int64)
        self.bytes_to_ids = np.array([self.base.get(i, -1) for i in range(256)], np.int64)
        self.longest = max((len(tokens[c]) for _, _, c in merges), default=1)
        self.lookahead = self.longest + self._chain(merges)
        self.window = 2 * self.lookahead + self.longest

    def _chain(self, merges: list[tuple[int, int, int]]) -> int:
        made = {c: (a, b) for a, b, c in reversed(merges)}
        ending: dict[int, int] = {}  # token -> longest chain of a later rule with this right side
        spine: dict[int, int] = {}  # the same for right sides that begin with this token
        longest = 0
        for a, b, c in reversed(merges):
            after = max(ending.get(a, -1), spine.get(c, -1))
            here = len(self.tokens[a]) + after if after >= 0 else 0
            longest = max(longest, here)
            ending[b] = max(ending.get(b, -1), here)
            t: int | None = b
            while t is not None:
                spine[t] = max(spine.get(t, -1), here)
                t = made[t][0] if t in made else None
        return longest

    @classmethod
    def from_json(cls, text: str | bytes) -> MergeTable:
        """The table of a tokenizers file with a byte-level BPE model."""
        file = json.loads(text)
        to_byte = byte_symbols()
        vocab = file["model"]["vocab"]
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        tokens = {i: bytes(map(to_byte.__getitem__, t)) for t, i in vocab.items() if t not in special}
        merges = []
        for m in file["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            merges.append((vocab[a], vocab[b], vocab[a + b]))
        return cls(tokens | {i: t.encode() for t, i in special.items()}, merges, special)

    def merge(self, word: bytes) -> list[int]:
        """All merges of a bounded byte string: lowest rank first, leftmost first."""
        ids = list(map(self.base.__getitem__, word))
        if len(ids) > 48:
            return self._merge_long(ids)
        found = self.code.get
        codes = [found((a << 32) | b, NO_MERGE) for a, b in zip(ids, ids[1:])]
        while codes and (best := min(codes)) < NO_MERGE:
            i = codes.index(best)
            ids[i : i + 2] = (best & 0xFFFFFFFF,)
            del codes[i]
            if i:
                codes[i - 1] = found((ids[i - 1] << 32) | ids[i], NO_MERGE)
            if i < len(codes):
                codes[i] = found((ids[i] << 32) | ids[i + 1], NO_MERGE)
        return ids

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Codes of the pairs, NO_MERGE for those that do not merge (ids below 0 are no tokens)."""
        pair = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[at] == pair) & (a >= 0) & (b >= 0), self.pair_codes[at], NO_MERGE)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """``merge`` of short words side by side, as packed 32-bit ids: one merge of every word a round."""
        if not words or not len(self.pairs):
            return [array("i", self.merge(w)).tobytes() for w in words]
        size = np.array([len(w) for w in words])
        width = int(size.max(initial=1))
        ids = np.full((len(words), width), -1, np.int64)
        ids[np.arange(width) < size[:, None]] = self.bytes_to_ids[np.frombuffer(b"".join(words), np.uint8)]
        codes = self._lookup(ids[:, :-1], ids[:, 1:])
        done = np.empty(len(words), object)
        rows = np.arange(len(words))
        while len(rows):
            at = codes.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
            every = np.arange(len(rows))
            best = codes[every, at] if width > 1 else np.full(len(rows), NO_MERGE)
            over = best == NO_MERGE
            if over.any():
                ended = ids[over]
                ends = np.cumsum((ended >= 0).sum(axis=1)) * 4
                packed = ended[ended >= 0].astype(np.int32).tobytes()
                done[rows[over]] = [packed[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
                rows, ids, codes, at, best = rows[~over], ids[~over], codes[~over], at[~over], best[~over]
                every = np.arange(len(rows))
            if not len(rows):
                break
            # the merged pair becomes one place and what follows moves up by one
            ids[every, at] = best & 0xFFFFFFFF
            place = np.arange(width)
            source = np.minimum(place + (place > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, source, 1)
            ids[:, -1] = -1
            codes = np.take_along_axis(codes, np.minimum(place[:-1] + (place[:-1] >= at[:, None]), width - 2), 1)
            codes[:, -1] = NO_MERGE
            width = max(1, int((ids >= 0).any(axis=0).sum()))
            ids, codes = ids[:, :width], codes[:, : width - 1]
            if width == 1:
                continue
            left = np.maximum(at - 1, 0)
            before = self._lookup(ids[every, left], ids[every, left + 1])
            codes[every, left] = np.where(at > 0, before, codes[every, left])
            right = np.minimum(at, width - 2)
            after = self._lookup(ids[every, right], ids[every, right + 1])
            codes[every, right] = np.where(at <= width - 2, after, codes[every, right])
        return done.tolist()

    def _merge_long(self, ids: list[int | None]) -> list[int]:
        rank, n = self.rank, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n and (found := rank.get((ids[i] << 32) | ids[j])):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, c = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = c, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in ids if t is not None]


class WordTransducer:
    """Bytes of one pretoken in, stable tokens out; holds at most a window of bytes."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.held = b""

    def push(self, data: bytes, out: list[int]) -> None:
        t = self.table
        for at in range(0, len(data), t.window):
            self.held += data[at : at + t.window]
            if len(self.held) >= t.window:
                final = len(self.held) - t.lookahead
                end = 0
                for token in t.merge(self.held):
                    size = len(t.tokens[token])
                    if end + size > final:
                        break
                    out.append(token)
                    end += size
                self.held = self.held[end:]

    def close(self, out: list[int]) -> None:
        out.extend(self.table.merge(self.held))
        self.held = b""


class Words(dict):
    """Pretoken -> its tokens as packed 32-bit ids, made on demand and bounded.

    Two generations: a full one becomes the older one, whose words come back when they are met again, so
    frequent words outlive any number of rare ones."""

    def __init__(self, table: MergeTable):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.inner = WordTransducer(table)

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            out: list[int] = []
            self.inner.push(word.encode(), out)
            self.inner.close(out)
            packed = array("i", out).tobytes()
            if len(word) > KNOWN_CHARS:
                return packed
        self.keep(word, packed)
        return packed

    def keep(self, word: str, packed: bytes) -> None:
        if len(self) >= KNOWN_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = packed

    def learn(self, words: list[str]) -> None:
        """Merge the short ones of ``words`` that are not known, all together, in groups of like length."""
        older = self.older
        unseen: dict[int, list[str]] = {}
        for word in {w for w in words if w not in self}:
            if word in older:
                self.keep(word, older[word])
            elif len(word) <= SIDE_BY_SIDE:
                unseen.setdefault(len(word) // 6, []).append(word)
        for group in unseen.values():
            for word, packed in zip(group, self.inner.table.merge_many([w.encode() for w in group])):
                self.keep(word, packed)


class StreamEncoder:
    """Text pieces in, packed ids out, as soon as no further input can change them."""

    def __init__(self, table: MergeTable, words: Words | None = None):
        self.words = words if words is not None else Words(table)
        self.table = table
        self.scan = regex.compile(PRETOKEN)
        self.runs = {
            "L": regex.compile(r"\p{L}+"),
            "N": regex.compile(r"\p{N}+"),
            "P": regex.compile(r"[^\s\p{L}\p{N}]+"),
            "S": regex.compile(r"\s+"),
        }
        self.special = regex.compile("|".join(map(regex.escape, table.special)) or "(?!)")
        self.partial = max(map(len, table.special), default=1) - 1
        self.tail = ""  # text that may still become a special token
        self.pending = ""  # text whose pretokens are not settled
        self.run = ""  # class of the pretoken that is being passed on in parts
        self.inner = WordTransducer(table)

    def feed(self, text: str) -> bytes:
        self.tail += text
        out = bytearray()
        at = 0
        for m in self.special.finditer(self.tail):
            out += self._scan(self.tail[at : m.start()], last=True)
            out += self.table.special[m[0]].to_bytes(4, "little")
            at = m.end()
        settled = max(at, len(self.tail) - self.partial)
        out += self._scan(self.tail[at:settled], last=False)
        self.tail = self.tail[settled:]
        return bytes(out)

    def finish(self) -> bytes:
        out = self._scan(self.tail, last=True)
        self.tail = ""
        return out

    def _scan(self, text: str, last: bool) -> bytes:
        self.pending += text
        out: list[bytes] = []
        while self.pending:
            if self.run and not self._continue(out, last):
                break
            words = self.scan.findall(self.pending)
            if last:
                out.append(b"".join(map(self.words.__getitem__, words)))
                self.pending = ""
                break
            rest = 0
            while words and rest < UNSETTLED:
                rest += len(words.pop())
            out.append(b"".join(map(self.words.__getitem__, words)))
            self.pending = self.pending[len(self.pending) - rest :]
            if rest < LONG_RUN or not self._begin(out):
                break
        if last and self.run:
            self._close(out)
        return b"".join(out)

    def _begin(self, out: list[bytes]) -> bool:
        """Start to pass on a pretoken of unknown end; False if the pending text is not one."""
        body = self.pending[1:] if self.pending[0] == " " and not self.pending[1].isspace() else self.pending
        for kind, run in self.runs.items():
            m = run.match(body)
            if m and m.end() >= LONG_RUN - UNSETTLED - 1:
                if len(body) < len(self.pending):
                    self.inner.push(b" ", [])  # shorter than a window: nothing to emit yet
                    self.pending = body
                self.run = kind
                return True
        return False

    def _continue(self, out: list[bytes], last: bool) -> bool:
        """Pass on what belongs to the open pretoken; True if it ended and text is left."""
        m = self.runs[self.run].match(self.pending)
        end = m.end() if m else 0
        ended = end < len(self.pending)
        if self.run == "S" and not (last and not ended):
            end = max(0, end - 1)  # the last blank belongs to what follows
        ids: list[int] = []
        self.inner.push(self.pending[:end].encode(), ids)
        self.pending = self.pending[end:]
        out.append(b"".join(i.to_bytes(4, "little") for i in ids))
        if ended:
            self._close(out)
        return ended

    def _close(self, out: list[bytes]) -> None:
        ids: list[int] = []
        self.inner.close(ids)
        self.run = ""
        out.append(b"".join(i.to_bytes(4, "little") for i in ids))


class StreamDecoder:
    """Token ids in, text out; a character cut between tokens waits for its rest."""

    def __init__(self, table: MergeTable):
        self.tokens = table.tokens
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.machine.decode(b"".join([self.tokens.get(i, b"") for i in ids]))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


class Codec:
    """A worker's table with its remembered words."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.words = Words(table)
        self.scan = regex.compile(PRETOKEN)

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; new pretokens of all short texts are merged together."""
        cut = [None if self._streamed(t) else self.scan.findall(t or "") for t in texts]
        self.words.learn([w for words in cut if words for w in words])
        return [self._stream(t) if words is None else b"".join(map(self.words.__getitem__, words)) for t, words in zip(texts, cut)]

    def _streamed(self, text: str | None) -> bool:
        return bool(text) and (len(text) > PIECE or any(s in text for s in self.table.special))

    def _stream(self, text: str) -> bytes:
        encoder = StreamEncoder(self.table, self.words)
        out = [encoder.feed(text[at : at + PIECE]) for at in range(0, len(text), PIECE)]
        return b"".join(out) + encoder.finish()

    def decode(self, ids) -> str:
        decoder = StreamDecoder(self.table)
        out = [decoder.feed(ids[at : at + PIECE].tolist()) for at in range(0, len(ids), PIECE)]
        return "".join(out) + decoder.finish()


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(MergeTable.from_json(model))


def load_model(path: str) -> bytes:
    """The tokenizer file, read once on the driver and sent with the task (its size is fixed)."""
    with open(path, "rb") as f:
        return f.read()


def _mapped(df: DataFrame, keep: list[str], source: str, new: list[StructField], make) -> DataFrame:
    if clash := {f.name for f in new} & set(keep):
        raise ValueError(f"kept columns are named like outputs: {sorted(clash)}")
    slim = df.select(*keep, F.col(source).alias("__source"))
    kept = StructType([f for f in slim.schema.fields if f.name != "__source"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                made = make(batch.column(batch.num_columns - 1))
                columns = [*batch.columns[:-1], *made]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *(f.name for f in new)])

    return slim.mapInArrow(work, StructType([*kept.fields, *new]))


def _id_lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=ends[1:])
    values = np.frombuffer(b"".join(packed), np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


IDS = StructField("ids", ArrayType(IntegerType()))
DECODED = StructField("decoded", StringType())


def encode(df: DataFrame, model: bytes, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``ids``: the tokens of each whole text."""

    def make(texts: pa.Array) -> list[pa.Array]:
        own = codec(model)
        return [_id_lists(own.encode_all(texts.to_pylist()))]

    return _mapped(df, keep, text, [IDS], make)


def decode(df: DataFrame, model: bytes, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep`` and ``decoded``: the text of each id list; a null list decodes to an empty text."""
    def make(lists: pa.Array) -> list[pa.Array]:
        own = codec(model)
        texts = [own.decode(np.asarray([i for i in x or [] if i is not None], np.int64)) for x in lists.to_pylist()]
        return [pa.array(texts, pa.string())]

    return _mapped(df, keep, ids, [DECODED], make)


def round_trip(df: DataFrame, model: bytes, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``ids`` and ``decoded``: both transducers in one pass, decoding from the ids made."""
    def make(texts: pa.Array) -> list[pa.Array]:
        own = codec(model)
        packed = own.encode_all(texts.to_pylist())
        back = [own.decode(np.frombuffer(p, np.int32)) for p in packed]
        return [_id_lists(packed), pa.array(back, pa.string())]

    return _mapped(df, keep, text, [IDS, DECODED], make)


def digests(df: DataFrame, model: bytes) -> DataFrame:
    """Token count and digests of ids and decoded text for each document."""
    both = round_trip(df.select("doc_id", "text"), model, ["doc_id"])
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

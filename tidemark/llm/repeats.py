"""Periodic runs of words, found on a Re-Pair grammar of the texts.

A run is a stretch of consecutive words with smallest period q, at least ``least`` words and ``power``
times q long, that no neighbouring word extends. A task takes its texts in slices, numbers their words
and builds one grammar for the slice: every round counts all pairs of neighbouring symbols (no pair
crosses two texts) and replaces those that outrank the pairs they overlap, most frequent first, until
rounds hardly shorten the sequence. What is left of each text becomes the leaves of a balanced tree.

A run lies whole in some node and crosses the boundary of that node's two parts. So each nonterminal is
searched once, in the first text that derives it, for stretches that cross its boundary: a stretch of
four periods has two of them on one side, which leaves as periods only distances at which the word next
to the boundary returns. Prefix hashes give how far a period reaches. Stretches are translated to all
positions that derive the nonterminal; those that a longer stretch of the same period contains are cut
parts of it and go. Every run is then compared word by word, so a hash collision can only cause a second
try with other hashes, not a wrong run.

There is no shuffle, and each text stays in one task; memory grows with a slice, which is 1.5 MB of text
or one longer text. Null and empty texts have no words. Null ids, repeated rows and an empty table are
nothing special: one row out for each row in. Only the kept and text columns are read, by position, so
other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

LEAST = 6
POWER = 4
SLICE = 3 << 19  # bytes of text searched at once
WORTH = 0.02  # a round that shortens the sequence by less is the last
TESTS = 1 << 20  # candidate periods tested at once
PRIME = (1 << 31) - 1
SPACE = r"[\x20\x09-\x0D]+"


def ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place (from 0) of every element of ranges of these sizes."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - first[owner]


class Nodes:
    """Nodes of the grammar: [left, cut) and [cut, right) of one derivation, and all places derived from it."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.total = 0

    def add(self, left, cut, right, owner, places) -> None:
        self.parts.append((left, cut, right, owner + self.total, places))
        self.total += len(left)

    def columns(self) -> list[np.ndarray]:
        if not self.parts:
            return [np.zeros(0, np.int64)] * 5
        return [np.concatenate(x) for x in zip(*self.parts)]


def alternate(same: np.ndarray) -> np.ndarray:
    """Places at odd offsets of stretches where ``same`` holds."""
    at = np.arange(len(same))
    begins = same & ~np.concatenate([[False], same[:-1]])
    return same & ((at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 1)


def grammar(words: np.ndarray, text: np.ndarray) -> Nodes:
    """Re-Pair of ``words``, whose texts are numbered in ascending order by ``text``."""
    nodes = Nodes()
    symbol, at, fresh = words.astype(np.int64), np.arange(len(words)), int(words.max(initial=0)) + 1
    end = at + 1
    while len(symbol) > 1:
        joined = text[at[:-1]] == text[at[1:]]
        place = np.flatnonzero(joined & ~alternate(joined & (symbol[:-1] == symbol[1:])))
        kinds, kind, count = np.unique(symbol[place] * fresh + symbol[place + 1], return_inverse=True, return_counts=True)
        again = count[kind] > 1
        place, kind = place[again], kind[again]
        rank = np.empty(len(kinds), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(kinds))
        height = np.full(len(symbol) + 1, -1)
        height[place + 1] = rank[kind]
        top = (height[place + 1] > height[place]) & (height[place + 1] > height[np.minimum(place + 2, len(symbol))])
        place, kind = place[top], kind[top]
        several = np.bincount(kind, minlength=len(kinds))[kind] > 1
        place, kind = place[several], kind[several]
        if not len(place):
            break
        by = np.argsort(kind, kind="stable")
        new, first, owner = np.unique(kind[by], return_index=True, return_inverse=True)
        shown = place[by][first]
        nodes.add(at[shown], end[shown], end[shown + 1], owner, at[place[by]])
        symbol[place[by]] = fresh + owner
        end[place] = end[place + 1]
        fresh += len(new)
        rest = np.ones(len(symbol), bool)
        rest[place + 1] = False
        symbol, at, end = symbol[rest], at[rest], end[rest]
        if len(place) < WORTH * len(rest):
            break
    while len(at) > 1:  # a balanced tree over what is left of each text
        joined = text[at[:-1]] == text[at[1:]]
        place = np.flatnonzero(joined & ~alternate(joined))
        if not len(place):
            break
        nodes.add(at[place], end[place], end[place + 1], np.arange(len(place)), at[place])
        end[place] = end[place + 1]
        rest = np.ones(len(at), bool)
        rest[place + 1] = False
        at, end = at[rest], end[rest]
    return nodes


class Matcher:
    """Prefix hashes of the words: how far two places agree forwards and backwards."""

    def __init__(self, words: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.tables = []
        for base in rng.integers(1 << 20, PRIME, 2):
            power = np.ones(len(words) + 1, np.int64)
            have = 1
            step = int(base)  # base ** have
            while have < len(power):
                more = min(have, len(power) - have)
                power[have : have + more] = power[:more] * step % PRIME
                have, step = have + more, step * step % PRIME
            value = (words.astype(np.int64) + 1) * 48_271 % PRIME
            sums = np.concatenate([[0], np.cumsum(value * power[:-1] % PRIME)]) % PRIME
            self.tables.append((power, sums))

    def equal(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        same = np.ones(len(low), bool)
        for power, sums in self.tables:
            a, b = (sums[low + n] - sums[low]) % PRIME, (sums[high + n] - sums[high]) % PRIME
            same &= a * power[high - low] % PRIME == b
        return same

    def reach(self, low: np.ndarray, high: np.ndarray, most: np.ndarray, forwards: bool) -> np.ndarray:
        """Most words, up to ``most``, that agree from (or up to) both places."""
        short, long = np.zeros(len(low), np.int64), most.copy()
        while (open_ := short < long).any():
            n = (short + long + 1) // 2
            back = 0 if forwards else n
            same = self.equal(low - back, high - back, n)
            short = np.where(open_ & same, n, short)
            long = np.where(open_ & ~same, n - 1, long)
        return short


def _crossing(words: np.ndarray, text: np.ndarray, nodes, match: Matcher, least: int, power: int):
    """node, start, end, period of stretches that cross the boundary of a node, within the node."""
    left, cut, right = nodes
    n = len(words)
    key = text * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    sorted_ = group[order] * (n + 1) + order
    before, after = np.full(n, -n, np.int64), np.full(n, 2 * n, np.int64)
    linked = group[order[1:]] == group[order[:-1]]
    before[order[1:][linked]] = order[:-1][linked]
    after[order[:-1][linked]] = order[1:][linked]
    sides = power // 2  # periods that one side of the boundary holds at least
    found = [[np.zeros(0, np.int64)] * 4]
    for leftward in (True, False):
        beside = cut - 1 if leftward else cut
        most = (cut - left if leftward else right - cut) // sides
        nearest = beside - before[beside] if leftward else after[beside] - beside
        use = np.flatnonzero((right - left >= least) & (most > 0) & (nearest <= most))
        if leftward:
            low = np.searchsorted(sorted_, group[beside[use]] * (n + 1) + np.maximum(beside[use] - most[use], 0))
            count = place[beside[use]] - low
        else:
            low = place[beside[use]] + 1
            count = np.searchsorted(sorted_, group[beside[use]] * (n + 1) + beside[use] + most[use], "right") - low
        done = np.cumsum(count)
        start = 0
        while start < len(use):
            stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + TESTS, "right")))
            owner, k = ranges(count[start:stop])
            node = use[start:stop][owner]
            q = np.abs(order[low[start:stop][owner] + k] - beside[node])
            c = cut[node]
            # two periods lie on this side: look at three more places
            for share in (0.5, 1, 0.75):
                probe = (share * (q - 1)).astype(np.int64)
                a = c - 1 - probe if leftward else c + probe
                ok = words[a] == words[a - q if leftward else a + q]
                node, q, c = node[ok], q[ok], c[ok]
            low_end, high_end = (c - q, c) if leftward else (c, c + q)
            back = match.reach(low_end, high_end, low_end - left[node], False)
            on = match.reach(low_end, high_end, right[node] - high_end, True)
            s, e = low_end - back, high_end + on
            long = (e - s >= np.maximum(least, power * q)) & (s < c) & (e > c)
            found.append((node[long], s[long], e[long], q[long]))
            start = stop
    return [np.concatenate(x) for x in zip(*found)]


def _distinct(*keys: np.ndarray) -> np.ndarray:
    """First row of each combination of all keys but the last, in the order of the keys."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([np.diff(k[order]) != 0 for k in keys[:-1]], axis=0)
    return order[new]


def _true(words: np.ndarray, first: np.ndarray, last: np.ndarray, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> bool:
    for a, b, p, low, high in zip(s.tolist(), e.tolist(), q.tolist(), first.tolist(), last.tolist()):
        if a > low and words[a - 1] == words[a - 1 + p] or b < high and words[b] == words[b - p]:
            return False
        if not (words[a : b - p] == words[a + p : b]).all():
            return False
    return True


def find_runs(words: np.ndarray, text: np.ndarray, least: int = LEAST, power: int = POWER):
    """start, end, period of all runs; ``text`` numbers the texts of the words, ascending; ``power`` at least 4."""
    if power < 4:
        raise ValueError("one side of a boundary must hold two periods: power must be 4 or more")
    if not len(words):
        return [np.zeros(0, np.int64)] * 3
    left, cut, right, owner, places = grammar(words, text).columns()
    by = np.argsort(owner, kind="stable")
    first_of = np.searchsorted(owner[by], np.arange(len(left) + 1))
    bounds = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1], [True]]))
    for seed in range(64):
        node, s, e, q = _crossing(words, text, (left, cut, right), Matcher(words, seed), least, power)
        keep = _distinct(node, s, e, q)  # the smallest period of a stretch
        node, s, e, q = node[keep], s[keep], e[keep], q[keep]
        copy, k = ranges(first_of[node + 1] - first_of[node])
        shift = places[by[first_of[node[copy]] + k]] - left[node[copy]]
        s, e, q = s[copy] + shift, e[copy] + shift, q[copy]
        keep = _distinct(s, e, q)
        s, e, q = s[keep], e[keep], q[keep]
        own = text[s] if len(s) else s
        order = np.lexsort((-e, s, q, own))
        own, s, e, q = own[order], s[order], e[order], q[order]
        # texts follow each other, so a stretch that ends no later than one before it lies inside it
        group = np.cumsum(np.concatenate([[0], (np.diff(own) != 0) | (np.diff(q) != 0)])) if len(s) else s
        span = len(words) + 1
        reached = np.maximum.accumulate(group * span + e) if len(s) else s
        whole = np.ones(len(s), bool)
        whole[1:] = (group[1:] != group[:-1]) | (e[1:] > reached[:-1] - group[1:] * span)
        s, e, q = s[whole], e[whole], q[whole]
        order = np.lexsort((q, s))
        s, e, q = s[order], e[order], q[order]
        here = np.searchsorted(bounds, s, "right") - 1
        if _true(words, bounds[here], bounds[here + 1], s, e, q):
            return [s, e, q]
    raise RuntimeError("prefix hashes collide again and again")


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= SLICE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _search(texts: list[bytes], least: int, power: int):
    """Words of each text, its runs (start, length, period) and the text without repeated periods."""
    split = [t.split() for t in texts]  # bytes split at exactly the six space characters
    sizes = np.array([len(w) for w in split], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = pa.array([w for own in split for w in own], pa.large_binary()).dictionary_encode()
    ids = flat.indices.to_numpy().astype(np.int64)
    s, e, q = find_runs(ids, np.repeat(np.arange(len(texts)), sizes), least, power)
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, s + q, 1)
    np.add.at(change, e, -1)
    dropped = np.cumsum(change[:-1]) > 0
    own = np.searchsorted(starts + sizes, s, "right")
    cuts = np.searchsorted(own, np.arange(len(texts) + 1))
    for i, words in enumerate(split):
        a, b = cuts[i], cuts[i + 1]
        runs = list(zip((s[a:b] - starts[i]).tolist(), (e[a:b] - s[a:b]).tolist(), q[a:b].tolist()))
        if runs:
            kept = ~dropped[starts[i] : starts[i] + sizes[i]]
            words = [words[j] for j in np.flatnonzero(kept).tolist()]
        yield int(sizes[i]), runs, b" ".join(words)


def scan(df: DataFrame, keep: list[str], text: str = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """``keep``, n_words, runs (start, length, period, by start and period) and collapsed: every run cut to one period."""
    inner = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    run = StructType([StructField(c, LongType(), False) for c in ("start", "length", "period")])
    own = [StructField("n_words", LongType()), StructField("runs", ArrayType(run, False)), StructField("collapsed", StringType())]
    schema = StructType([*inner.schema.fields[1:], *own])
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for a, b in _slices(texts):
                n, runs, rest = zip(*_search(texts[a:b], least, power))
                named = [[{"start": x, "length": y, "period": z} for x, y, z in own] for own in runs]
                made = [pa.array(n, pa.int64()), pa.array(named, runs_type), pa.array(rest, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[1:], *made], schema.names)

    return inner.mapInArrow(work, schema).toDF(*keep, "n_words", "runs", "collapsed")


def with_planted(id: Column, text: Column) -> Column:
    """``text``, made periodic from some word on for ids whose CRC-32 is divisible by 10."""
    h = F.crc32(id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, SPACE), lambda w: w != "")

    def repeated(bound: Column) -> Column:
        w = bound["w"]
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + F.pmod(i - a, p)))), " ")

    once = F.get(F.transform(F.array(F.struct(words.alias("w"))), repeated), F.lit(0))
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), once).otherwise(text)


def report(df: DataFrame) -> DataFrame:
    """Runs and digests of every document, after ``with_planted``."""
    found = scan(df.select("doc_id", with_planted(F.col("doc_id"), F.col("text")).alias("text")), ["doc_id"])
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.withColumn("best", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("-1000 * best.l DIV best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

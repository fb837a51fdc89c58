"""Spelling variants grouped by pivotal bigrams.

Words are counted over all texts; each batch sends one count per word. Bigrams of the vocabulary are
ranked by how many words hold them. A word's prefix is its three rarest bigrams, with all places of the
commonest of them. From the prefix a dynamic program picks two pivots that share no letter and have the
fewest words behind them. One edit cannot break both pivots, so of two words at distance one, the word
whose prefix ends at the rarer bigram has a pivot that stands unbroken in the other's prefix.

Cut the shorter word into thirds: an edit spares two of them. So a prefix bigram is indexed with each two
thirds of its word and the length they are thirds of: the word's own, or one less for its shorter
neighbours. Pivots are joined with prefixes on that index; a pivot that lies in the two thirds is unbroken,
so the cheaper one will do. A pair is kept if its bigram, where it stands once in both words, keeps its
place counted from the start or from the end, and the edit distance is exactly one. An index entry that
very many words share is cut into salts: its pivots are dealt out, its prefixes copied. No pair list is
built; pairs that fail are dropped inside the join.

A word's form is its near word of largest count (ties: smallest in code-point order) if that count is at
least ``ratio`` times the word's own. Forms are followed to a root by pointer jumping.

Null and empty texts hold no words; a null id counts its words unchanged. Repeated rows count again. An
empty table gives an empty result. A text is read in one task, whole; of it, its distinct words are held.
Only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import written

LETTERS = r"a-z\u00C0-\u00FF"  # what is left of A-Z, a-z and U+00C0 to U+00FF once A-Z is in lower case
SHORTEST = 7
FEWEST = 2
RATIO = 10
DELETE = 31
HOT = 2_000  # pivots or prefixes of an index entry in one salt
GRAM, EDITS = 2, 1
PREFIX = GRAM * EDITS + 1


def noisy(doc: bytes | None, word: str) -> str:
    """``word``, less one letter if the CRC-32 of ``doc`` (hashed ``id:``) and word is divisible by 31."""
    if doc is None:
        return word
    h = zlib.crc32(word.encode(), zlib.crc32(doc))
    if h % DELETE:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(df: DataFrame, id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, change=noisy) -> DataFrame:
    """word, n over all texts; ``change`` maps (id followed by a colon, word) to the word that counts."""
    runs = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter[str] = Counter()
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                own = Counter(runs.findall(raw.as_py().lower().decode()))  # lower() of bytes touches A-Z only
                head = None if doc is None else f"{doc}:".encode()
                for word, n in own.items():
                    word = change(head, word)
                    if len(word) >= shortest:
                        held[word] += n
            words = list(held)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])

    slim = df.select(F.col(id).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> dict[str, int]:
    """Words that hold each bigram; at most the square of the alphabet reaches the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter[str] = Counter()
            for word in batch.column(0).to_pylist():
                held.update({word[i : i + GRAM] for i in range(len(word) - GRAM + 1)})
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["gram", "n"])

    rows = words.select("word").mapInArrow(work, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r["gram"]: r["n"] for r in rows}


def pivots(word: str, counts: dict[str, int], rank: dict[str, int]) -> tuple[list[int], list[int], int]:
    """Places of the prefix bigrams, the two of them that are pivots (cheaper first), and the rank that ends the prefix."""
    if len(word) < PREFIX + GRAM - 1:
        raise ValueError(f"{word!r} is too short for pivots that share no letter")
    grams = [rank[word[i : i + GRAM]] for i in range(len(word) - GRAM + 1)]
    last = sorted(grams)[PREFIX - 1]
    prefix = [i for i, g in enumerate(grams) if g <= last]
    cost = [counts[word[i : i + GRAM]] for i in prefix]
    # best[k][j]: cheapest k + 1 pivots that share no letter, the last of them at or before prefix[j]
    best = [[(c, (i,)) for c, i in zip(cost, prefix)]]
    for j in range(1, len(prefix)):
        best[0][j] = min(best[0][j], best[0][j - 1])
    for k in range(EDITS):
        row, open_ = [], 0
        for j, at in enumerate(prefix):
            while open_ < j and prefix[open_] <= at - GRAM:
                open_ += 1
            held = best[k][open_ - 1] if open_ else None
            own = (held[0] + cost[j], (*held[1], at)) if held else None
            row.append(min((x for x in (own, row[-1] if row else None) if x), default=None))
        best.append(row)
    return prefix, sorted(best[-1][-1][1], key=lambda i: grams[i]), last


def _signatures(counts: dict[str, int]):
    """Rows (word, last, held, grams): the end of the prefix, a set of the word's letters, and its prefix bigrams."""
    rank = {g: i for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}
    gram = pa.struct([("gram", pa.int32()), ("place", pa.int32()), ("sent", pa.int32())])

    def grams(word: str) -> tuple[int, list[tuple]]:
        prefix, chosen, last = pivots(word, counts, rank)
        places: dict[str, int | None] = {}
        for p in prefix:
            own = word[p : p + GRAM]
            places[own] = None if own in places else p
        sent = dict.fromkeys(places, 0)  # a bit for each two thirds that the bigram is a pivot of
        size = len(word)
        for turn, n in enumerate((size, size - 1)):
            a, b = n // 3, 2 * n // 3
            for part, (low, high) in enumerate(((b, size), (0, size - n + a), (a, size - n + b))):
                inside = [p for p in chosen if p + GRAM <= low or p >= high]
                for p in inside[:1] or chosen:
                    sent[word[p : p + GRAM]] |= 1 << (3 * turn + part)
        return last, [(rank[g], place, sent[g]) for g, place in places.items()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            lasts, own = zip(*map(grams, words)) if words else ((), ())
            held = [sum({1 << ord(c) % 63 for c in w}) for w in words]
            own = [[{"gram": g, "place": p, "sent": s} for g, p, s in x] for x in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lasts, pa.int32()), pa.array(held, pa.int64()), pa.array(own, pa.list_(gram))], ["word", "last", "held", "grams"])

    return work


def _index(words: DataFrame) -> DataFrame:
    """key, pivot, place, last, held, word: each prefix bigram with all two thirds of both lengths."""
    rows = words.select("word").mapInArrow(_signatures(gram_counts(words)), "word string, last int, held long, grams array<struct<gram:int,place:int,sent:int>>")
    parts = []
    for less in (0, 1):
        n = F.length("word") - less
        a, b = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
        start = lambda k: F.substring("word", F.lit(1), k)
        end = lambda k: F.substring("word", F.length("word") - k + 1, k)
        letters = [start(b), end(n - a), F.concat_ws(" ", start(a), end(n - b))]
        parts += [F.xxhash64(n, F.lit(part), x) for part, x in enumerate(letters)]
    rows = rows.select(F.posexplode(F.array(*parts)).alias("part", "hash"), "word", "last", "held", "grams")
    rows = rows.select("part", "hash", "word", "last", "held", F.explode("grams").alias("g"))
    sent = F.expr("shiftright(g.sent, part) & 1 = 1")
    return rows.select(F.xxhash64("g.gram", "hash").alias("key"), sent.alias("pivot"), "g.place", "last", "held", "word")


def near_pairs(words: DataFrame) -> DataFrame:
    """u, v: all ordered pairs of ``words`` (word, each once, of at least four letters) at edit distance one."""
    index = written(_index(words), "spelling_index")
    sizes = index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT)
    sizes = written(sizes.select("key", F.ceil(F.col("n") / HOT).cast("int").alias("salts")), "spelling_hot")
    salted = index.join(sizes, "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    a = salted.filter("pivot").withColumn("salt", F.pmod(F.xxhash64("word"), "salts").cast("int"))
    b = salted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    a = a.select("key", "salt", F.col("place").alias("place_a"), F.col("last").alias("last_a"), F.col("held").alias("held_a"), F.col("word").alias("u"))
    b = b.select("key", "salt", F.col("place").alias("place_b"), F.col("last").alias("last_b"), F.col("held").alias("held_b"), F.col("word").alias("v"))
    longer, later = F.length("v") - F.length("u"), F.col("place_b") - F.col("place_a")
    may = (F.col("last_a") <= F.col("last_b")) & F.coalesce((later == 0) | (later == longer), F.lit(True)) & (F.abs(longer) <= 1)
    alike = F.bit_count(F.col("held_a").bitwiseXOR(F.col("held_b"))) <= 2 * EDITS
    found = a.join(b, ["key", "salt"]).filter(alike & may & (F.levenshtein("u", "v", EDITS) == 1))
    ends = found.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("p"))
    return ends.select("p.u", "p.v").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: ``forms`` (word, form; no cycles) followed to the last; every step doubles the way."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling_roots")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for ``counted`` (word, n)."""
    other = counted.select(F.col("word").alias("v"), F.col("n").alias("m"))
    # the largest count first, then the smallest word
    near = near_pairs(counted).join(other, "v").groupBy("u").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "v")).alias("best"))
    known = counted.join(near.withColumnRenamed("u", "word"), "word", "left")
    strong = -F.col("best.m") >= ratio * F.col("n")
    known = written(
        known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.v")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n")),
        "spelling_forms",
    )
    led = known.join(roots(known.filter("form IS NOT NULL")), "word", "left")
    return led.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(df: DataFrame) -> DataFrame:
    """Variants of all words of the documents that occur twice or more."""
    return variants(written(count_words(df).filter(F.col("n") >= FEWEST), "spelling_words"))

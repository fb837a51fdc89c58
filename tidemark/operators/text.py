"""Text corpus preparation: counts, n-grams, vocabulary, id sequences."""

from __future__ import annotations

from array import array
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as fn
from tidemark.operators.clean import fill_text
from tidemark.operators.ordered import hashed_split


def count_tokens(
    df: DataFrame, tokens: Column, by: Sequence[str] = (), out: str = "word"
) -> DataFrame:
    """Occurrences of each token. Counts are combined before the shuffle.

    The outer form of explode keeps Spark from adding a size filter below it, which
    would build the token arrays a second time.
    """
    exploded = df.select(*by, F.explode_outer(tokens).alias(out)).filter(F.col(out).isNotNull())
    return exploded.groupBy(*by, out).agg(F.count(F.lit(1)).alias("n"))


def word_count(df: DataFrame, text: str = "value", separator: str = " ") -> DataFrame:
    """Counts of the pieces between single separators; empty pieces count too."""
    pieces = F.split(F.col(text), "\\Q" + separator + "\\E", -1)
    return count_tokens(df, pieces)


def line_count(df: DataFrame, text: str = "value") -> DataFrame:
    """Frequency of whole lines."""
    return df.groupBy(F.col(text).alias("line")).agg(F.count(F.lit(1)).alias("n"))


def lines_of(df: DataFrame, text: str) -> DataFrame:
    """One row per line of the text."""
    return df.select(F.explode(F.split(text, "\n")).alias("value"))


def tokenize(
    df: DataFrame, text: str, out: str = "tokens", stop: Sequence[str] | None = fn.STOP_WORDS
) -> DataFrame:
    """Lower-case white-space tokens without stop words."""
    tokens = fn.lower_words(F.col(text))
    return df.withColumn(out, tokens if stop is None else fn.without(tokens, stop))


def top_with_percent(
    counts: DataFrame, k: int, by: Sequence[str] = (), word: str = "word"
) -> DataFrame:
    """The k most frequent words per group, with their percent among those k.

    Spark limits every input partition to k rows per group before the shuffle, so
    one big group does not gather in one task.
    """
    n = F.col("n")
    if not by:
        top = counts.orderBy(F.desc("n"), word).limit(k)
        # At most k rows are left here.
        return top.withColumn("percent", n * 100.0 / F.sum(n).over(Window.partitionBy()))
    ranked = Window.partitionBy(*by).orderBy(F.desc("n"), word)
    top = counts.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= k)
    share = n * 100.0 / F.sum(n).over(Window.partitionBy(*by))
    return top.withColumn("percent", share).drop("_rank")


def ngram_count(
    df: DataFrame, tokens: str, n: int = 3, by: Sequence[str] = ()
) -> DataFrame:
    """Counts of n-grams inside each document: the tokens zipped with themselves, moved on by 1 .. n-1."""
    shifted = [F.slice(tokens, i + 1, F.greatest(F.size(tokens) - i, F.lit(0))).alias(f"t{i}") for i in range(n)]
    grams = df.select(*by, F.explode_outer(F.arrays_zip(*shifted)).alias("_g"))
    grams = grams.filter(F.col(f"_g.t{n - 1}").isNotNull())  # the zip is as long as the tokens
    word = F.concat_ws(" ", *[F.col(f"_g.t{i}") for i in range(n)]).alias("word")
    return grams.groupBy(*by, word).agg(F.count(F.lit(1)).alias("n"))


def clean_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, fn.cleaned(F.col(column)))


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """White-space tokens of the corpus with their counts."""
    return count_tokens(df, fn.words(F.col(text)))


def word_index(df: DataFrame, text: str, num_words: int = 50_000) -> DataFrame:
    """Ids 1, 2, ... of the ``num_words - 1`` most frequent words, ties in word order.

    Only that many rows reach the numbering step, whatever the vocabulary size.
    """
    counts = count_tokens(df, fn.separated_words(F.col(text)))
    top = counts.orderBy(F.desc("n"), "word").limit(num_words - 1)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "word"))
    return top.select("word", rank.alias("id"))


def to_sequences(
    df: DataFrame, index: DataFrame, doc: str, text: str, out: str = "ids"
) -> DataFrame:
    """Ids of the known words of each document, in text order; unknown words go.

    The index is read once. If its words are within ``DICTIONARY_BYTES`` they go to every worker, which
    encodes whole texts in place: no token is shuffled. A larger index is joined to the tokens.
    """
    size = F.sum(F.octet_length("word") + 64)
    index = index.persist()
    try:
        if (index.agg(size.alias("n")).first()["n"] or 0) > DICTIONARY_BYTES:
            return _joined_sequences(df, index, doc, text, out)
        words = {r["word"]: r["id"] for r in index.select("word", "id").collect()}
    finally:
        index.unpersist()

    def encode(texts: pa.Array) -> pa.Array:
        get = words.get
        flat, ends = array("i"), array("q", [0])
        for t in texts.to_pylist():
            flat.extend(i for i in map(get, t.split(" ")) if i is not None)
            ends.append(len(flat))
        return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat, pa.int32())).cast(pa.list_(pa.int32()))

    ids = F.arrow_udf(encode, "array<int>")
    return df.select(doc, ids(F.coalesce(fn.separated(F.col(text)), F.lit(""))).alias(out))


#: Bytes of an index that is sent to the workers.
DICTIONARY_BYTES = 64 << 20


def _joined_sequences(df: DataFrame, index: DataFrame, doc: str, text: str, out: str) -> DataFrame:
    rows = df.select(F.monotonically_increasing_id().alias("_row"), doc, fn.separated_words(F.col(text)).alias("_words"))
    tokens = rows.select("_row", doc, F.posexplode_outer("_words").alias("_at", "word"))
    spotted = F.when(F.col("id").isNotNull(), F.struct("_at", "id"))
    found = tokens.join(index, "word", "left").groupBy("_row", doc).agg(
        F.array_sort(F.collect_list(spotted)).alias("_found")
    )
    return found.select(doc, F.transform("_found", lambda s: s["id"]).alias(out))


def pad(df: DataFrame, column: str = "ids", length: int = 100) -> DataFrame:
    return df.withColumn(column, fn.padded(F.col(column), length))


def prepare(
    df: DataFrame,
    doc: str,
    text: str,
    num_words: int = 50_000,
    length: int = 100,
    share: float = 0.1,
    seed: int = 2019,
) -> DataFrame:
    """Split, fill missing texts, index the training words, encode and pad all texts."""
    rows = hashed_split(fill_text(df, [text]), doc, share, seed)
    index = word_index(rows.filter("split = 'train'"), text, num_words)
    rows = rows.withColumn("_kept", F.struct(doc, "split"))
    ids = pad(to_sequences(rows, index, "_kept", text), "ids", length)
    return ids.select(F.col(f"_kept.{doc}"), "ids", "_kept.split")

"""Joins: positional attach, vocabulary lookup, forecast alignment, nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.neighbours import nearest_neighbours  # noqa: F401
from tidemark.operators.ordering import match


def attach_columns(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of ``other`` by the full row key (series, time, tie-breaker)."""
    return match(df, other, keys, "left")


def align(
    forecast: DataFrame, actual: DataFrame, keys: Sequence[str], target_ts: str, ts: str
) -> DataFrame:
    """Pair each forecast with the actual row of its target time."""
    right = actual.withColumnRenamed(ts, target_ts)
    return match(forecast, right, [*keys, target_ts], "inner")


def lookup(vocab: DataFrame, vectors: DataFrame, word: str = "word") -> DataFrame:
    """Vocabulary with a ``known`` flag. Words are unique on both sides."""
    known = vectors.select(word).distinct().withColumn("_hit", F.lit(True))
    joined = vocab.join(known, word, "left")
    return joined.withColumn("known", F.coalesce("_hit", F.lit(False))).drop("_hit")


def coverage(vocab: DataFrame, vectors: DataFrame, word: str = "word", n: str = "n") -> DataFrame:
    """Known and unknown words, percent of the vocabulary and of all text."""
    rows = lookup(vocab, vectors, word)
    known_n = F.sum(F.when(F.col("known"), F.col(n)).otherwise(0))
    return rows.agg(
        F.count_if(F.col("known")).alias("known_words"),
        F.count_if(~F.col("known")).alias("unknown_words"),
        (F.count_if(F.col("known")) * 100.0 / F.count(F.lit(1))).alias("percent_of_vocab"),
        (known_n * 100.0 / F.sum(n)).alias("percent_of_text"),
    )


def unknown_words(
    vocab: DataFrame, vectors: DataFrame, word: str = "word", n: str = "n"
) -> DataFrame:
    """Words without a vector, most frequent first."""
    return vocab.join(vectors.select(word), word, "left_anti").orderBy(F.desc(n), word)


def add_lower_case(
    vectors: DataFrame, vocab: DataFrame, word: str = "word", vector: str = "vector"
) -> DataFrame:
    """Give lower(word) the vector of a vocabulary word if it has none of its own.

    Of several spellings the alphabetically first one gives the vector.
    """
    used = vectors.join(vocab.select(word), word, "left_semi")
    lowered = used.groupBy(F.lower(word).alias("_low")).agg(
        F.min_by(F.col(vector), F.col(word)).alias(vector)
    )
    missing = lowered.join(
        vectors.select(F.col(word).alias("_low")), "_low", "left_anti"
    ).select(F.col("_low").alias(word), vector)
    return vectors.select(word, vector).unionByName(missing)


def class_shares(neighbours: DataFrame) -> DataFrame:
    """Rows ``(test_id, train_label, share)``: how much of the vote each label got. Labels without a vote have no row."""
    votes = neighbours.groupBy("test_id", "train_label").agg(F.count(F.lit(1)).alias("_votes"))
    every = neighbours.groupBy("test_id").agg(F.count(F.lit(1)).alias("_all"))
    return votes.join(every, "test_id").select(
        "test_id", "train_label", (F.col("_votes") / F.col("_all")).alias("share")
    )


def vote(neighbours: DataFrame) -> DataFrame:
    """Uniform vote per test row: the most frequent label, the smaller one on ties."""
    counts = neighbours.groupBy("test_id", "train_label").agg(F.count(F.lit(1)).alias("votes"))
    return counts.groupBy("test_id").agg(
        F.max_by("train_label", F.struct("votes", F.negative("train_label").alias("_low"))).alias(
            "predicted"
        )
    )

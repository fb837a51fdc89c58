"""A training corpus from ``documents``, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. ``run`` writes each
stage's rows as Parquet in the shared folder and reads them again as the next one's documents. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, darts, exact, language, mixing, queries
from tidemark.llm.components import written


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject."""
    model = language.fit(docs.filter(~language.held_out()))
    named = docs.withColumnsRenamed({c: f"__{i}" for i, c in enumerate(docs.columns)})
    at = docs.columns.index("text")
    judged = language.identify(named, model, named.columns, f"__{at}").filter("NOT rejected")
    return judged.drop("lang_pred", "score", "rejected").toDF(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return darts.drop_near(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by their rates."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mix(docs, mixing.quality_domains(labels), queries.MIX_WEIGHTS, queries.MIX_BUDGET)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and of the text decoded from them."""
    return bpe.digests(docs, bpe.load_model(queries.tokenizer_path()))


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("bpe", encode_texts),
]

#: The language model, the near-duplicate search and the mixing fit have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

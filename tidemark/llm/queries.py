"""Registered queries of the pipeline operators: opN_<name>(spark, folder), and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, chat, covertree, darts, exact, innerproduct, language, licenses, mixing, pii, repeats, secrets, spelling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[build.__name__] = build
        if sql is not None:
            TWINS[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op1_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Encode every document and decode the ids again."""
    return bpe.digests(table(spark, folder, "documents"), bpe.load_model(tokenizer_path()))


@query(chat.twin())
def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Format all conversations and one hard case, and digest what is read back."""
    return chat.summaries(chat.with_hard_case(table(spark, folder, "conversations")))


@query()
def op3_embedding_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.9 or more."""
    return covertree.linked(table(spark, folder, "embeddings"))


@query()
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and signature rules over every document."""
    return licenses.report(table(spark, folder, "documents"))


@query()
def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Base expressions and the shape field over every document."""
    return pii.report(table(spark, folder, "documents"))


@query(secrets.twin())
def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document, through a new ledger."""
    return secrets.report(table(spark, folder, "documents"))


@query(
    """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """
)
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Group equal texts through the extendible-hash index."""
    return exact.exact_groups(table(spark, folder, "documents"))


#: Target shares of the tokens, and tokens after mixing for each token before.
MIX_WEIGHTS = {"good": 0.85, "poor": 0.09, "toxic": 0.06}
MIX_BUDGET = 1.25


@query()
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of all documents that bring quality domains to their target weights."""
    labelled = mixing.quality_domains(table(spark, folder, "labels"))
    return mixing.rates_table(table(spark, folder, "documents"), labelled, MIX_WEIGHTS, MIX_BUDGET)


@query()
def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of all documents: five-word shingles, similarity 0.8 or more."""
    return darts.near_groups(table(spark, folder, "documents")).drop("text_key")


@query()
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predict the language of every document with centroids of those not held out."""
    return language.predictions(table(spark, folder, "documents"))


@query(innerproduct.TWIN)
def op11_top_products(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth vector with all others."""
    return innerproduct.report(table(spark, folder, "embeddings"))


@query()
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in every document, after the planted repeats."""
    return repeats.report(table(spark, folder, "documents"))


@query()
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling.report(table(spark, folder, "documents"))


def add_pipeline() -> None:
    """Register the pipeline, which lies at the top of the repository."""
    import corpus_pipeline

    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        TWINS["pipeline"] = corpus_pipeline.ORACLE_SQL

"""Stream sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def text_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None
                ) -> DataFrame:
    """Lines of the text files that arrive in a folder."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder)


def socket_stream(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a text server (this is the client side)."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def batch_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = 1
) -> DataFrame:
    """A queue of batches: each parquet file that arrives is one batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder, be it one file or a folder of files, as a stream.

    The path is a pattern that only the table matches: Spark lists a folder that a pattern finds, and does
    not take a file that it finds for the base of partition columns.
    """
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("basePath", folder).parquet(f"{path[:-1]}[t]")

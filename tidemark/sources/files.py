"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.clean import null_markers, parse_timestamp


#: Quotes are doubled inside quotes and blanks are kept, so that any text comes back as it was.
CSV_TEXT = {
    "escape": '"',
    "lineSep": "\n",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
#: What the reader takes a field without quotes and characters for; a quoted one is an empty text.
ABSENT = "\x01absent\x01"


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    header: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """CSV with a stated schema, so that no pass over the file is spent on inference.

    Texts may hold line ends; a file is then read by one task, so write many files. Without
    ``multi_line`` files are split, but no text may hold a line end. A field without any
    character is null, ``""`` an empty text. A row of one null column is an empty line, which is
    not read back.
    """
    reader = spark.read.schema(schema).options(**CSV_TEXT, nullValue=ABSENT, emptyValue="")
    return reader.csv(path, header=header, multiLine=multi_line)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """CSV that keeps microseconds, and texts with quotes, separators, line ends and blanks."""
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    df.write.options(**CSV_TEXT, timestampNTZFormat=stamp).csv(path, header=header)


def read_metrics(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    time_columns: Sequence[str],
    time_format: str,
    numbers: Sequence[str],
    markers: Sequence[str] = ("nan", "?"),
    header: bool = True,
    separator: str = ",",
) -> DataFrame:
    """Metric CSV: missing markers become null, ``time_columns`` become one ``ts``.

    ``columns`` names all columns of the file in order. The time columns are joined
    with one space before they are parsed by ``time_format``.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).csv(path, header=header, sep=separator)
    values = {c: null_markers(F.col(c), markers) for c in columns if c not in time_columns}
    values |= {c: values[c].try_cast("double") for c in numbers}
    joined = raw.withColumns({**values, "ts": F.concat_ws(" ", *time_columns)})
    rest = [c for c in columns if c not in time_columns]
    return parse_timestamp(joined, "ts", time_format).select("ts", *rest)


def read_labelled_series(spark: SparkSession, path: str, length: int) -> DataFrame:
    """Header-less numeric CSV: column 0 is the label, the rest one series."""
    names = ["label", *[f"v{i}" for i in range(length)]]
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in names])
    rows = spark.read.schema(schema).csv(path, header=False)
    return rows.select("label", F.array(*names[1:]).alias("series"))


def read_word_vectors(spark: SparkSession, path: str, min_chars: int = 0) -> DataFrame:
    """Lines ``word f f f ...``; lines of at most ``min_chars`` characters are dropped."""
    lines = spark.read.text(path)
    if min_chars:
        lines = lines.filter(F.length("value") > min_chars)
    parts = F.split("value", " ")
    return lines.select(
        F.get(parts, F.lit(0)).alias("word"),
        F.slice(parts, F.lit(2), F.size(parts)).cast("array<float>").alias("vector"),
    )


def write_word_vectors(df: DataFrame, path: str, word: str = "word", vector: str = "vector"
                       ) -> None:
    line = F.concat_ws(" ", F.col(word), F.col(vector).cast("array<string>"))
    df.select(line.alias("value")).write.text(path)


def alert_line(ts: str, value: str) -> Column:
    stamp = F.date_format(ts, "yyyy/MM/dd_HH:mm:ss")
    return F.concat(F.lit("["), stamp, F.lit("]"), F.col(value).cast("string"))


def append_alert_lines(df: DataFrame, path: str, ts: str, value: str) -> None:
    """Append lines ``[time]value`` to a text folder."""
    df.select(alert_line(ts, value).alias("value")).write.mode("append").text(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """CSV with header, one part file per partition."""
    df.write.mode("overwrite").csv(path, header=True)


def write_by_month(df: DataFrame, path: str, ts: str) -> None:
    """Parquet partitioned by calendar month, so that month slices prune folders.

    Rows of a month are brought together first (AQE splits the busy months), which
    keeps the number of files low.
    """
    monthly = df.withColumn("month", F.date_format(ts, "yyyy-MM"))
    monthly.hint("rebalance", "month").write.partitionBy("month").parquet(path)

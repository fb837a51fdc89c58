"""Queries: file sources and sinks. Each writes a given table and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.rounding import r as rd
from tidemark.operators.clean import rename_by_position
from tidemark.plans.registry import Tables, query, r
from tidemark.plans.texts import word_vectors, words_sql
from tidemark.session import scratch
from tidemark.sources import files


@query("csv_scan", "S1", "SELECT event_id, ts, user_id, event_type, value FROM events")
def csv_scan(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    path = scratch(t.spark, "events_csv")
    files.write_csv(rows, path)
    return files.read_csv(t.spark, path, rows.schema, multi_line=False)


@query("text_csv_scan", "S1", "SELECT doc_id, text, lang, source FROM documents")
def text_csv_scan(t: Tables) -> DataFrame:
    """Whole texts through CSV and back: line ends, quotes, commas, blanks and nulls."""
    rows = t.documents.select("doc_id", "text", "lang", "source")
    path = scratch(t.spark, "documents_csv")
    files.write_csv(rows, path)
    return files.read_csv(t.spark, path, rows.schema)


@query(
    "metric_csv_scan",
    "S2",
    """SELECT date_trunc('second', ts) AS ts, user_id::VARCHAR AS host,
        CASE WHEN event_type NOT IN ('error', 'click') THEN value END AS used FROM events""",
)
def metric_csv_scan(t: Tables) -> DataFrame:
    used = (
        F.when(F.col("event_type") == "error", "?")
        .when(F.col("event_type") == "click", "nan")
        .otherwise(F.col("value").cast("string"))
    )
    rows = t.events.select(
        F.date_format("ts", "yyyy/MM/dd").alias("Date"),
        F.date_format("ts", "HH:mm:ss").alias("time"),
        F.col("user_id").alias("host"),
        used.alias("used"),
    )
    path = scratch(t.spark, "metrics_csv")
    rows.write.csv(path, header=True)
    return files.read_metrics(
        t.spark, path, ["Date", "time", "host", "used"], ["Date", "time"],
        "yyyy/MM/dd HH:mm:ss", ["used"],
    )


@query(
    "labelled_series_scan",
    "S3",
    f"""SELECT label::DOUBLE AS label, len(embedding)::INT AS points,
        embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last,
        {r("list_sum(list_transform(embedding, lambda x: x::DOUBLE))")} AS total FROM embeddings""",
)
def labelled_series_scan(t: Tables) -> DataFrame:
    rows = t.embeddings.select("label", F.col("embedding").cast("array<double>").alias("e"))
    width = rows.agg(F.max(F.size("e"))).first()[0]
    path = scratch(t.spark, "series_csv")
    rows.select("label", *[F.get("e", F.lit(i)).alias(f"v{i}") for i in range(width)]).write.csv(
        path
    )
    series = files.read_labelled_series(t.spark, path, width)
    return series.select(
        "label",
        F.size("series").alias("points"),
        F.element_at("series", 1).alias("first"),
        F.element_at("series", -1).alias("last"),
        rd(F.aggregate("series", F.lit(0.0), lambda a, v: a + v)).alias("total"),
    )


@query(
    "rename_by_position",
    "S4",
    """SELECT o_orderkey AS "Transaction ID", o_totalprice AS "Price",
        o_orderpriority AS "Estate Type" FROM orders""",
)
def rename_columns(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority")
    path = scratch(t.spark, "orders_csv")
    rows.write.csv(path)
    unnamed = files.read_csv(t.spark, path, "_c0 long, _c1 double, _c2 string", header=False)
    return rename_by_position(unnamed, ["Transaction ID", "Price", "Estate Type"])


@query(
    "alert_lines",
    "S9 N4",
    """SELECT '[' || strftime(ts + INTERVAL 3 MINUTE, '%Y/%m/%d_%H:%M:%S') || ']'
        || value::VARCHAR AS value FROM events WHERE value >= 60""",
)
def alert_lines(t: Tables) -> DataFrame:
    high = t.events.filter("value >= 60").withColumn(
        "ts", F.col("ts") + F.expr("INTERVAL '3' MINUTE")
    )
    path = scratch(t.spark, "alerts_text")
    files.append_alert_lines(high.filter("user_id % 2 = 0"), path, "ts", "value")
    files.append_alert_lines(high.filter("user_id % 2 <> 0"), path, "ts", "value")
    return t.spark.read.text(path)


@query(
    "prediction_csv_sink",
    "S10",
    "SELECT doc_id AS qid, (n_chars > 500)::INT AS prediction FROM documents",
)
def prediction_csv_sink(t: Tables) -> DataFrame:
    rows = t.documents.select(
        F.col("doc_id").alias("qid"), (F.col("n_chars") > 500).cast("int").alias("prediction")
    )
    path = scratch(t.spark, "predictions_csv")
    files.write_predictions(rows, path)
    return files.read_csv(t.spark, path, "qid long, prediction int")


@query(
    "word_vector_scan",
    "S11",
    f"""WITH k AS (SELECT unnest({words_sql('text')}) AS word, count(*) AS n FROM conversations
        GROUP BY 1) SELECT word, n::DOUBLE AS first, length(word)::DOUBLE AS second FROM k
        WHERE length(word || ' ' || n || '.0 ' || length(word) || '.0') > 14""",
)
def word_vector_scan(t: Tables) -> DataFrame:
    path = scratch(t.spark, "vectors_text")
    files.write_word_vectors(word_vectors(t), path)
    rows = files.read_word_vectors(t.spark, path, min_chars=14)
    return rows.select(
        "word",
        F.get("vector", F.lit(0)).cast("double").alias("first"),
        F.get("vector", F.lit(1)).cast("double").alias("second"),
    )


@query(
    "month_folder_slice",
    "P16",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
       WHERE year(l_shipdate) = 1998 AND month(l_shipdate) = 3""",
)
def month_folder_slice(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    path = scratch(t.spark, "lineitem_by_month")
    files.write_by_month(rows, path, "l_shipdate")
    schema = T.StructType([*rows.schema.fields, T.StructField("month", T.StringType())])
    stored = t.spark.read.schema(schema).parquet(path)
    return stored.filter("month = '1998-03'").drop("month", "l_shipdate")

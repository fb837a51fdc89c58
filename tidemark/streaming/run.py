"""Running stream queries: sinks, triggers, stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def start_per_batch(
    stream: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Write ``compute(batch)`` of each micro-batch to ``out/batch_id=<id>``.

    No state passes from batch to batch. A batch that is run again overwrites its
    own folder, so results are exactly-once. ``every`` is a processing-time
    interval like ``"5 seconds"``; without it all available data is processed and
    the query ends.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        compute(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return _start(stream.writeStream.foreachBatch(write), checkpoint, every)


def start_append(stream: DataFrame, out: str, checkpoint: str, every: str | None = None
                 ) -> StreamingQuery:
    """Append result rows to a parquet folder as they become final."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", out)
    return _start(writer, checkpoint, every)


def start_text_append(stream: DataFrame, out: str, checkpoint: str, every: str | None = None
                      ) -> StreamingQuery:
    """Append one text column as lines."""
    writer = stream.writeStream.outputMode("append").format("text").option("path", out)
    return _start(writer, checkpoint, every)


def start_console(stream: DataFrame, every: str, rows: int = 10) -> StreamingQuery:
    """Print the first rows of each batch."""
    writer = stream.writeStream.format("console").option("numRows", rows)
    return writer.trigger(processingTime=every).start()


def _start(writer, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def drain(query: StreamingQuery) -> StreamingQuery:
    """Let the query finish what has arrived, then stop it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def finish(query: StreamingQuery) -> StreamingQuery:
    """Wait for a query that ends by itself and raise its error, if any."""
    query.awaitTermination()
    return query


def late_rows(query: StreamingQuery) -> int:
    """How many rows came too late for the watermark in the query's recent batches."""
    return sum(
        int(op["numRowsDroppedByWatermark"])
        for progress in query.recentProgress
        for op in progress["stateOperators"]
    )


def batches(spark, out: str, schema) -> DataFrame:
    """The per-batch results with their ``batch_id``."""
    rows = spark.read.schema(schema).parquet(f"{out}/batch_id=*")
    path = F.col("_metadata.file_path")
    found = F.regexp_extract(path, r"batch_id=(\d+)", 1).cast("long")
    return rows.withColumn("batch_id", found)

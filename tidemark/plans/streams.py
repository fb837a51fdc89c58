"""Queries: streams over the given tables.

Each one cuts a table into slices that arrive one after the other. The stream
query is started again from its checkpoint for every slice, so the slices are its
micro-batches whatever the number of files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.rounding import r as rd
from tidemark.functions.rounding import rounded
from tidemark.operators import anomaly, profile, text
from tidemark.operators.windows import next_step_time
from tidemark.plans.registry import Tables, query, r
from tidemark.plans.windowing import BY_USER, IN_TIME, SQL_ORDER
from tidemark.session import scratch
from tidemark.sources.files import alert_line
from tidemark.streaming import rows, run, sources, totals, windows


def replay(
    slices: Sequence[DataFrame], folder: str, start: Callable[[], StreamingQuery],
    as_text: bool = False,
) -> None:
    """Let the slices arrive in ``folder`` in turn and process each."""
    for part in slices:
        writer = part.write.mode("append")
        writer.text(folder) if as_text else writer.parquet(folder)
        run.finish(start())


def thirds_by_time(df: DataFrame, ts: str = "ts") -> list[DataFrame]:
    """Three slices of equal time spans, oldest first."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    ends = df.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    step = (ends["b"] - ends["a"]) // 3 + 1
    low = [ends["a"] + i * step for i in range(4)]
    return [df.filter((at >= low[i]) & (at < low[i + 1])) for i in range(3)]


def _places(t: Tables) -> tuple[str, str, str]:
    return tuple(scratch(t.spark, name) for name in ("arrivals", "out", "checkpoint"))


@query(
    "stream_word_count_per_batch",
    "R1 S5 T1 R2",
    """SELECT turn % 3 AS batch_id, unnest(string_split(text, ' ')) AS word, count(*) AS n
       FROM conversations GROUP BY 1, 2""",
)
def stream_word_count_per_batch(t: Tables) -> DataFrame:
    arrivals, out, checkpoint = _places(t)
    # A text file holds one line per row, so line breaks inside a message are kept apart.
    slices = [
        t.conversations.filter(F.col("turn") % 3 == i).select(
            F.regexp_replace("text", "[\r\n]", "\u0001").alias("value")
        )
        for i in range(3)
    ]

    def count(batch: DataFrame) -> DataFrame:
        lines = batch.select(F.regexp_replace("value", "\u0001", "\n").alias("value"))
        return text.word_count(lines, "value", " ")

    def start() -> StreamingQuery:
        return run.start_per_batch(
            sources.text_stream(t.spark, arrivals), count, out, checkpoint
        )

    replay(slices, arrivals, start, as_text=True)
    return run.batches(t.spark, out, "word string, n long")


@query(
    "stream_keyed_count_per_batch",
    "R3 R2 R5 S7 A12",
    """SELECT l_linenumber % 2 AS batch_id, l_partkey % 10 AS remainder, count(*) AS n
       FROM lineitem GROUP BY ALL""",
)
def stream_keyed_count_per_batch(t: Tables) -> DataFrame:
    arrivals, out, checkpoint = _places(t)
    items = t.lineitem.select("l_partkey", "l_linenumber")
    slices = [items.filter(F.col("l_linenumber") % 2 == i) for i in range(2)]

    def start() -> StreamingQuery:
        stream = sources.batch_stream(t.spark, arrivals, items.schema, files_per_batch=None)
        running = run.start_per_batch(
            stream,
            lambda b: profile.count_by_remainder(b, "l_partkey"),
            out,
            checkpoint,
            every="1 second",
        )
        return run.drain(running)

    replay(slices, arrivals, start)
    out_rows = run.batches(t.spark, out, "remainder long, n long")
    return out_rows.withColumn("batch_id", F.col("batch_id").cast("int"))


def _events(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", "ts", "value")


def _event_slices(t: Tables) -> list[DataFrame]:
    return thirds_by_time(_events(t))


def _event_stream(t: Tables, arrivals: str) -> DataFrame:
    return sources.batch_stream(t.spark, arrivals, _events(t).schema, files_per_batch=None)


def _windowed(t: Tables, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    arrivals, out, checkpoint = _places(t)

    def result() -> DataFrame:
        return build(_event_stream(t, arrivals))

    end = windows.end_marker(t.spark, _events(t).schema, "ts")
    replay([*_event_slices(t), end], arrivals, lambda: run.start_append(result(), out, checkpoint))
    emitted = t.spark.read.schema(result().schema).parquet(out)
    return emitted.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}
    )


@query(
    "stream_tumbling_mean",
    "R7 A2",
    f"""SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start,
        start + INTERVAL 6 HOURS AS "end", count(*) AS n, {r("avg(value)")} AS mean FROM events
        GROUP BY 1, 2""",
)
def stream_tumbling_mean(t: Tables) -> DataFrame:
    aggs = {"n": F.count(F.lit(1)), "mean": F.avg("value")}
    out = _windowed(
        t, lambda s: windows.windowed(s, ["event_type"], "ts", "6 hours", aggs, "10 minutes")
    )
    return rounded(out, "mean")


@query(
    "stream_sliding_count",
    "R8",
    """WITH w AS (SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')
            - unnest([0, 1]) * INTERVAL 6 HOURS AS start FROM events)
    SELECT event_type, start, start + INTERVAL 12 HOURS AS "end", count(*) AS n FROM w
        GROUP BY 1, 2""",
)
def stream_sliding_count(t: Tables) -> DataFrame:
    return _windowed(
        t,
        lambda s: windows.windowed(
            s, ["event_type"], "ts", "12 hours", {"n": F.count(F.lit(1))}, "10 minutes", "6 hours"
        ),
    )


@query(
    "stream_sessions",
    "R9",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOURS THEN 1
            ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM s
        GROUP BY user_id, session""",
)
def stream_sessions(t: Tables) -> DataFrame:
    return _windowed(
        t,
        lambda s: windows.sessions(
            s, ["user_id"], "ts", "6 hours", {"n": F.count(F.lit(1))}, "10 minutes"
        ),
    )


@query(
    "stream_deduplicated",
    "R10",
    "SELECT event_id, user_id, ts FROM events",
)
def stream_deduplicated(t: Tables) -> DataFrame:
    arrivals, out, checkpoint = _places(t)

    def result() -> DataFrame:
        stream = _event_stream(t, arrivals)
        once = windows.deduplicated(stream, ["event_id"], "ts", "20 days")
        return once.select("event_id", "user_id", "ts")

    first, second, third = _event_slices(t)
    replay([first, second, second, third], arrivals,
           lambda: run.start_append(result(), out, checkpoint))
    kept = t.spark.read.schema(result().schema).parquet(out)
    return kept.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _row_windows(
    t: Tables, before: int, compute: rows.Compute, made: str, shape: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``shape`` of every event with the columns ``made`` from the ``before`` events ahead of it."""
    arrivals, out, checkpoint = _places(t)

    def result() -> DataFrame:
        events = rows.in_micros(_event_stream(t, arrivals).drop("event_type"), "ts")
        return rows.row_windows(events, BY_USER, IN_TIME, before, compute, made, whole=True)

    def shaped(batch: DataFrame) -> DataFrame:
        return shape(rows.from_micros(batch, "ts"))

    replay(_event_slices(t), arrivals, lambda: rows.start_with_late(result(), out, checkpoint, shaped))
    empty = t.spark.createDataFrame([], f"event_id long, user_id long, ts timestamp_ntz, value double, {made}")
    return run.batches(t.spark, out, shape(empty).schema).drop("batch_id")


@query(
    "stream_sliding_rows",
    "R4 W5",
    f"""SELECT event_id, count(*) OVER w AS kept, {r("sum(value) OVER w")} AS total FROM events
        WINDOW w AS ({SQL_ORDER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def stream_sliding_rows(t: Tables) -> DataFrame:
    def compute(every: pd.DataFrame, place: np.ndarray) -> pd.DataFrame:
        total = rows.sliding(every["value"].to_numpy(float), 5, np.nansum, place)
        return pd.DataFrame({"kept": np.minimum(place + 1, 5), "total": total})

    return _row_windows(
        t, 4, compute, "kept long, total double", lambda df: df.select("event_id", "kept", rd("total").alias("total"))
    )


@query(
    "stream_next_step_alerts",
    "R6 N4",
    f"""WITH a AS (SELECT event_id, user_id, ts + INTERVAL 3 MINUTE AS alert_ts, value,
        {r(f"avg(value) OVER ({SQL_ORDER} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)")}
            AS predicted FROM events)
    SELECT event_id, user_id, alert_ts, value, predicted,
        CASE WHEN abs(value - predicted) >= 30 AND predicted >= 60 THEN 'gap+level'
            WHEN abs(value - predicted) >= 30 THEN 'gap' ELSE 'level' END AS rule
    FROM a WHERE abs(value - predicted) >= 30 OR predicted >= 60""",
)
def stream_next_step_alerts(t: Tables) -> DataFrame:
    def compute(every: pd.DataFrame, place: np.ndarray) -> pd.DataFrame:
        value = every["value"].to_numpy(float)
        total = rows.sliding(value, 12, np.nansum, place)
        n = rows.sliding(np.where(np.isnan(value), np.nan, 1.0), 12, np.nansum, place)
        mean = np.divide(total, n, out=np.full(len(n), np.nan), where=n > 0)
        return pd.DataFrame({"predicted": np.where(place > 0, np.concatenate([[np.nan], mean[:-1]]), np.nan)})

    def shape(df: DataFrame) -> DataFrame:
        alerts = anomaly.gap_or_level(df.withColumn("predicted", rd("predicted")), "value", "predicted")
        return next_step_time(alerts, "ts", 3, "alert_ts").select(
            "event_id", "user_id", "alert_ts", "value", "predicted", "rule"
        )

    return _row_windows(t, 12, compute, "predicted double", shape)


@query(
    "stream_neighbour_jump_alerts",
    "R6 N7",
    f"""SELECT event_id, value, {r("jump")} AS jump FROM (SELECT event_id, value,
        abs(value - lead(value) OVER ({SQL_ORDER})) AS jump FROM events)
        WHERE round(jump, 6) >= 30""",
)
def stream_neighbour_jump_alerts(t: Tables) -> DataFrame:
    """A row is alerted when its successor arrives, be it in a later batch."""

    def compute(every: pd.DataFrame, place: np.ndarray) -> pd.DataFrame:
        of = every["event_id"].astype("Int64").shift(1).where(place > 0)
        was = every["value"].shift(1).where(place > 0)
        return pd.DataFrame({"of": of, "was": was, "jump": (every["value"] - was).abs()})

    def shape(df: DataFrame) -> DataFrame:
        jumps = df.withColumn("jump", rd("jump")).filter("jump >= 30")
        return jumps.select(F.col("of").alias("event_id"), F.col("was").alias("value"), "jump")

    return _row_windows(t, 1, compute, "of long, was double, jump double", shape)


@query(
    "stream_alert_lines",
    "S9",
    """SELECT '[' || strftime(ts, '%Y/%m/%d_%H:%M:%S') || ']' || value::VARCHAR AS value
       FROM events WHERE value >= 60""",
)
def stream_alert_lines(t: Tables) -> DataFrame:
    arrivals, out, checkpoint = _places(t)

    def start() -> StreamingQuery:
        high = _event_stream(t, arrivals).filter("value >= 60")
        lines = high.select(alert_line("ts", "value").alias("value"))
        return run.start_text_append(lines, out, checkpoint)

    replay(_event_slices(t), arrivals, start)
    return t.spark.read.text(out)


@query(
    "stream_running_word_count",
    "S8 R1 T1",
    """SELECT unnest(string_split(text, ' ')) AS word, count(*) AS n FROM conversations GROUP BY 1""",
)
def stream_running_word_count(t: Tables) -> DataFrame:
    """Words of all messages so far, after five batches and two merges."""
    arrivals, out, checkpoint = _places(t)
    talks = t.conversations.select("turn", "text")
    sums = totals.RunningTotals(t.spark, out, ["word"], {"n": ("sum", F.count(F.lit(1)))}, merge_every=2)

    def start() -> StreamingQuery:
        stream = sources.batch_stream(t.spark, arrivals, talks.schema, files_per_batch=None)
        words = stream.select(F.explode(F.split("text", " ", -1)).alias("word"))
        return sums.start(words, checkpoint)

    replay([talks.filter(F.pmod("turn", F.lit(5)) == i) for i in range(5)], arrivals, start)
    return sums.read()


@query(
    "stream_table_role_count",
    "S8",
    "SELECT role, count(*) AS n FROM conversations GROUP BY role",
)
def stream_table_role_count(t: Tables) -> DataFrame:
    """Messages by role, of a stream read straight from the table's folder."""
    _, out, checkpoint = _places(t)
    stream = sources.table_stream(t.spark, t.folder, "conversations")
    sums = totals.RunningTotals(t.spark, out, ["role"], {"n": ("sum", F.count(F.lit(1)))})
    run.finish(sums.start(stream, checkpoint))
    return sums.read()

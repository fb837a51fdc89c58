import datetime as dt
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import minute
from tidemark.operators import profile, text
from tidemark.session import scratch
from tidemark.streaming import rows as row_state
from tidemark.streaming import run, sources, totals, windows

SCHEMA = "host string, ts timestamp_ntz, id long, value double"


@pytest.fixture
def places(spark):
    return tuple(scratch(spark, n) for n in ("in", "out", "checkpoint"))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_counts_restart_with_every_batch(spark, places):
    arrivals, out, checkpoint = places
    lines = [["a b  b", "a"], ["b c"]]
    for part in lines:
        spark.createDataFrame([(x,) for x in part], "value string").write.mode("append").text(
            arrivals
        )
        stream = sources.text_stream(spark, arrivals)
        run.finish(run.start_per_batch(stream, text.word_count, out, checkpoint))
    got = {(r.batch_id, r.word): r.n for r in
           run.batches(spark, out, "word string, n long").collect()}
    want = {(i, w): n for i, part in enumerate(lines)
            for w, n in Counter(w for x in part for w in x.split(" ")).items()}
    assert got == want


def test_queue_of_batches(spark, places):
    arrivals, out, checkpoint = places
    rows = spark.range(1, 41).withColumnRenamed("id", "x").coalesce(1)
    rows.write.mode("append").parquet(arrivals)
    rows.write.mode("append").parquet(arrivals)
    stream = sources.batch_stream(spark, arrivals, rows.schema, files_per_batch=1)
    query = run.start_per_batch(
        stream, lambda b: profile.count_by_remainder(b, "x"), out, checkpoint, every="1 second"
    )
    run.drain(query)
    assert not query.isActive
    got = run.batches(spark, out, "remainder long, n long").collect()
    assert {(r.batch_id, r.remainder): r.n for r in got} == {
        (b, k): 4 for b in (0, 1) for k in range(10)
    }


def test_table_stream_reads_files_and_folders(spark, places, tmp_path):
    _, out, checkpoint = places
    table = spark.range(30).selectExpr("id", "CAST(id % 3 AS int) AS part")
    table.repartition(4).write.parquet(str(tmp_path / "flat.parquet"))
    table.write.partitionBy("part").parquet(str(tmp_path / "parted.parquet"))
    table.coalesce(1).write.parquet(str(tmp_path / "made"))
    (file,) = (tmp_path / "made").glob("*.parquet")
    file.rename(tmp_path / "single.parquet")
    spark.range(5).write.parquet(str(tmp_path / "flat.parquet.old"))
    for name in ("flat", "parted", "single"):
        stream = sources.table_stream(spark, str(tmp_path), name)
        run.finish(run.start_append(stream, f"{out}/{name}", f"{checkpoint}/{name}"))
        got = spark.read.schema(stream.schema).parquet(f"{out}/{name}").collect()
        assert sorted((r.id, r.part) for r in got) == [(i, i % 3) for i in range(30)]


def test_socket_reader_is_a_stream_of_lines(spark):
    stream = sources.socket_stream(spark, "localhost", 9)
    assert stream.isStreaming and stream.columns == ["value"]


def slices(spark):
    """Ten-minute means: rows of the third slice are late for the watermark."""
    at = dt.datetime(2021, 3, 1)

    def rows(*minutes):
        return [("a", at + dt.timedelta(minutes=m), m, float(m)) for m in minutes]

    return [frame(spark, rows(1, 4, 12)), frame(spark, rows(31, 45)), frame(spark, rows(2, 66))]


def test_tumbling_windows_drop_late_rows(spark, places):
    arrivals, out, checkpoint = places
    late = 0
    for part in slices(spark):
        part.write.mode("append").parquet(arrivals)
        stream = sources.batch_stream(spark, arrivals, part.schema, None)
        means = windows.windowed(
            stream, ["host"], "ts", "10 minutes", {"n": F.count(F.lit(1))}, "5 minutes"
        )
        query = run.finish(run.start_append(means, out, checkpoint))
        late += run.late_rows(query)
    got = spark.read.schema(means.schema).parquet(out).collect()
    counts = {r.start.minute: r.n for r in got}
    assert counts == {0: 2, 10: 1, 30: 1, 40: 1}
    assert late == 1


def test_sessions(spark, places):
    arrivals, out, checkpoint = places
    for part in slices(spark)[:2]:
        part.write.mode("append").parquet(arrivals)
        stream = sources.batch_stream(spark, arrivals, part.schema, None)
        runs = windows.sessions(
            stream, ["host"], "ts", "10 minutes", {"n": F.count(F.lit(1))}, "1 minute"
        )
        run.finish(run.start_append(runs, out, checkpoint))
    got = spark.read.schema(runs.schema).parquet(out).collect()
    # Minutes 1, 4 and 12 are one session; 31 is another; 45 is still open.
    assert sorted(r.n for r in got) == [1, 3]


def test_deduplication(spark, places):
    arrivals, out, checkpoint = places
    first, second, _ = slices(spark)
    for part in (first, first, second):
        part.write.mode("append").parquet(arrivals)
        stream = sources.batch_stream(spark, arrivals, part.schema, None)
        once = windows.deduplicated(stream, ["id"], "ts", "1 day")
        run.finish(run.start_append(once, out, checkpoint))
    got = spark.read.schema(once.schema).parquet(out).collect()
    assert sorted(r.id for r in got) == [1, 4, 12, 31, 45]


def test_end_marker_closes_every_window(spark, places):
    arrivals, out, checkpoint = places
    first, second, _ = slices(spark)
    spread = [first, second, windows.end_marker(spark, first.schema, "ts")]
    for part in spread:
        part.write.mode("append").parquet(arrivals)
        stream = sources.batch_stream(spark, arrivals, first.schema, None)
        means = windows.windowed(stream, ["host"], "ts", "10 minutes", {"n": F.count(F.lit(1))}, "5 minutes")
        run.finish(run.start_append(means, f"{out}/w", f"{checkpoint}/w"))
        stream = sources.batch_stream(spark, arrivals, first.schema, None)
        runs = windows.sessions(stream, ["host"], "ts", "10 minutes", {"n": F.count(F.lit(1))}, "1 minute")
        run.finish(run.start_append(runs, f"{out}/s", f"{checkpoint}/s"))
    got = spark.read.schema(means.schema).parquet(f"{out}/w").collect()
    assert {(r.host, r.start.minute): r.n for r in got} == {("a", 0): 2, ("a", 10): 1, ("a", 30): 1, ("a", 40): 1}
    got = spark.read.schema(runs.schema).parquet(f"{out}/s").collect()
    assert sorted((r.host, r.n) for r in got) == [("a", 1), ("a", 1), ("a", 3)]


def last_three(every, known):
    mean = row_state.sliding(every["value"].to_numpy(float), 4, lambda v, axis: np.nansum(v[..., :-1], axis=axis))
    n = np.minimum(np.arange(len(every)), 3)
    return pd.DataFrame({"before": mean[known:], "n": n[known:]})


MADE = "host string, ts long, id long, value double, before double, n long"


def test_row_windows_over_batches_equal_batch(spark, places):
    """One busy series, a late row, arrival order unlike time order, a null key."""
    arrivals, out, checkpoint = places
    rows = [("a", minute(i), i, float(i * i % 7)) for i in range(24)]
    rows += [("b", minute(i), 100 + i, float(i)) for i in range(3)] + [(None, minute(5), 200 + i, 1.0) for i in range(5)]
    late = ("a", minute(1), 1000, 5.0)
    parts = [rows[9::-1] + rows[24:25], rows[10:17] + [late] + rows[27:29], rows[17:24][::-1] + rows[25:27] + rows[29:]]
    for part in parts:
        df = frame(spark, part)
        df.write.mode("append").parquet(arrivals)
        stream = row_state.in_micros(sources.batch_stream(spark, arrivals, df.schema, None), "ts")
        result = row_state.row_windows(stream, ["host"], ["ts", "id"], 3, last_three, "before double, n long")
        run.finish(row_state.start_with_late(result, out, checkpoint))
    got = sorted((r.id, r.before, r.n) for r in run.batches(spark, out, MADE).collect())
    want = []
    for host in ("a", "b", None):
        own = sorted(r for r in rows if r[0] == host)
        for i, r in enumerate(own):
            before = [x[3] for x in own[max(0, i - 3) : i]]
            want.append((r[2], float(sum(before)), len(before)))
    assert got == sorted(want)
    kept_late = run.batches(spark, f"{out}/late", MADE).collect()
    assert [(r.id, r.batch_id) for r in kept_late] == [(1000, 1)]


def test_many_series_are_computed_as_one_block(spark, places, monkeypatch):
    monkeypatch.setattr(row_state, "BUCKETS", 1)
    arrivals, out, checkpoint = places
    big = 2**60 + 1  # not exact as a double
    keys = [big, big + 1, 5, None]
    rows = [(keys[i % 4], minute(i), None if i % 7 == 0 else big + i, None if i % 5 == 0 else float(i)) for i in range(48)]

    def compute(every, place):
        total = row_state.sliding(every["value"].to_numpy(float), 3, np.nansum, place)
        return pd.DataFrame({"total": total, "block": len(every)})

    for part in (rows[30::-1], rows[31:]):
        df = spark.createDataFrame(part, "host long, ts timestamp_ntz, id long, value double")
        df.write.mode("append").parquet(arrivals)
        stream = row_state.in_micros(sources.batch_stream(spark, arrivals, df.schema, None), "ts")
        result = row_state.row_windows(stream, ["host"], ["ts", "id"], 2, compute, "total double, block long", whole=True)
        run.finish(row_state.start_with_late(result, out, checkpoint))
    found = run.batches(spark, out, "host long, ts long, id long, value double, total double, block long").collect()
    want = []
    for key in keys:
        own = [r for r in rows if r[0] == key]
        want += [(key, r[2], sum(x[3] or 0.0 for x in own[max(0, i - 2) : i + 1])) for i, r in enumerate(own)]
    assert sorted(map(str, want)) == sorted(str((r.host, r.id, r.total)) for r in found)
    # all series of a bucket at once; null keys have one of their own
    assert {(r.host is None, r.block) for r in found if r.batch_id == 0} == {(False, 24), (True, 7)}


def test_a_batch_touches_only_its_own_series(spark, places):
    arrivals, out, checkpoint = places
    hosts = [f"h{i}" for i in range(40)]
    for batch, own in enumerate((hosts, hosts[:2])):
        df = frame(spark, [(h, minute(batch), batch, 1.0) for h in own])
        df.write.mode("append").parquet(arrivals)
        stream = row_state.in_micros(sources.batch_stream(spark, arrivals, df.schema, None), "ts")
        result = row_state.row_windows(stream, ["host"], ["ts", "id"], 3, last_three, "before double, n long")
        query = run.finish(row_state.start_with_late(result, out, checkpoint))
        (state,) = query.lastProgress["stateOperators"] if query.lastProgress["numInputRows"] else query.recentProgress[0]["stateOperators"]
        assert state["numRowsUpdated"] <= 2 * len(own)
    got = run.batches(spark, out, MADE).filter("batch_id = 1").collect()
    assert sorted((r.host, r.n) for r in got) == [("h0", 1), ("h1", 1)]


def test_idle_series_lose_their_state(spark, places):
    arrivals, out, checkpoint = places
    at = dt.datetime(2021, 3, 1)
    parts = [[("a", at, 1, 1.0), ("b", at, 2, 1.0)], [("b", at + dt.timedelta(hours=5), 3, 1.0)], [("a", at + dt.timedelta(hours=6), 4, 1.0), ("b", at + dt.timedelta(hours=6), 5, 1.0)]]
    for part in parts:
        df = frame(spark, part)
        df.write.mode("append").parquet(arrivals)
        stream = sources.batch_stream(spark, arrivals, df.schema, None)
        stream = row_state.in_micros(stream.withColumn("at", F.col("ts").cast("timestamp")), "ts")
        result = row_state.row_windows(
            stream, ["host"], ["ts", "id"], 3, last_three, "before double, n long", ts="at", delay="1 minute", idle_ms=3_600_000
        )
        run.finish(row_state.start_with_late(result, out, checkpoint))
    got = {r.id: r.n for r in run.batches(spark, out, MADE).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0, 5: 2}  # "a" starts anew; the timer of "b" was put off


def test_running_totals_stay_bounded(spark, places, tmp_path):
    out = str(tmp_path / "totals")
    sums = totals.RunningTotals(
        spark, out, ["word"], {"n": ("sum", F.count(F.lit(1))), "least": ("min", F.min("x")), "most": ("max", F.max("x"))}, merge_every=2
    )
    seen: list = []
    sizes = []
    for batch in range(9):
        rows = [(None if i % 5 == 0 else f"w{i % 4}", batch * i) for i in range(10)]
        seen += rows
        df = spark.createDataFrame(rows, "word string, x long").coalesce(1)
        sums.process(df, batch)
        if batch in (3, 4):
            sums.process(df, batch)  # a repeated batch changes nothing
        want = {}
        for w in {w for w, _ in seen}:
            own = [x for v, x in seen if v == w]
            want[w] = (len(own), min(own), max(own))
        assert {r.word: (r.n, r.least, r.most) for r in sums.read().collect()} == want
        sizes.append(sum(1 for p in (tmp_path / "totals").rglob("*") if p.is_dir()))
    assert sizes[4] == sizes[8]


def test_running_totals_of_a_stream(spark, places):
    arrivals, out, checkpoint = places
    sums = totals.RunningTotals(spark, out, ["host"], {"n": ("sum", F.count(F.lit(1)))}, merge_every=3)
    for part in slices(spark):
        part.write.mode("append").parquet(arrivals)
        run.finish(sums.start(sources.batch_stream(spark, arrivals, part.schema, None), checkpoint))
    assert [tuple(r) for r in sums.read().collect()] == [("a", 7)]
    with pytest.raises(ValueError):
        totals.RunningTotals(spark, out, ["host"], {"n": ("mean", F.count(F.lit(1)))})

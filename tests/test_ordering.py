import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import by_series, values
from tidemark.operators.ordering import (
    Frames,
    attach,
    exact_quantiles,
    has_hot_group,
    largest_group,
    numbered,
    running_total,
)

KEYS, ORDER = ["host"], ["ts", "id"]


def test_hot_group_is_seen(hot, plan):
    assert largest_group(hot, KEYS, 7) == 61
    assert largest_group(hot, KEYS, 1000) == 90
    assert has_hot_group(hot, KEYS) == (plan == "chunked")


def test_positions(hot, plan):
    found = by_series(numbered(hot, KEYS, ORDER, "pos", "n"), "pos", "n")
    for host, rows in found.items():
        assert rows == [(i, len(rows)) for i in range(len(rows))], host


def test_position_of_whole_table(hot, plan):
    rows = numbered(hot, [], ORDER + ["host"]).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(90))
    keys = [(r.ts, r.id, r.host or "") for r in rows]
    assert keys == sorted(keys)


def test_descending_order(hot, plan):
    rows = numbered(hot, KEYS, [F.desc("ts"), F.desc("id")]).filter("host = 'a'").collect()
    assert all(r.pos == 60 - r.id for r in rows)


def test_running_total(hot, plan):
    df = hot.withColumn("w", F.col("id") % 3)
    found = by_series(running_total(df, KEYS, ORDER, "w"), "w", "before")
    for rows in found.values():
        total = 0
        for w, before in rows:
            assert before == total
            total += w


def test_frames_cross_chunks(hot, plan):
    frames = Frames(hot, KEYS, ORDER, before=10, after=9, position="pos")
    df = frames.df.withColumns(
        {
            "items": F.collect_list("value").over(frames.rows(-10, 9)),
            "prev": F.lag("value").over(frames.order),
            "next": F.lead("value", 9).over(frames.order),
        }
    )
    found = by_series(frames.finish(df), "pos", "value", "items", "prev", "next")
    assert sum(map(len, found.values())) == 90
    for rows in found.values():
        v = [r[1] for r in rows]
        for i, (pos, _, items, prev, ahead) in enumerate(rows):
            assert pos == i
            assert items == v[max(0, i - 10) : i + 10]
            assert prev == (v[i - 1] if i else None)
            assert ahead == (v[i + 9] if i + 9 < len(v) else None)


def test_frame_beyond_declared_rows(hot):
    with pytest.raises(ValueError):
        Frames(hot, KEYS, ORDER, before=2).rows(-3, 0)


def test_exact_quantiles(hot, plan):
    probs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    found = {r.host: r for r in exact_quantiles(hot, KEYS, "value", probs, names).collect()}
    for host, v in values(hot).items():
        want = np.quantile(v, probs)
        assert np.allclose([found[host][n] for n in names], want)


def test_quantiles_of_repeated_and_null_values(spark, plan):
    rows = [(v,) for v in [5.0] * 30 + [1.0] * 3 + [9.0] * 2] + [(None,)] * 5
    df = spark.createDataFrame(rows, "v double")
    row = exact_quantiles(df, [], "v", [0.05, 0.5, 0.97], ["a", "b", "c"]).first()
    assert np.allclose(list(row), np.quantile([5.0] * 30 + [1.0] * 3 + [9.0] * 2, [0.05, 0.5, 0.97]))


def test_attach_keeps_all_rows(hot, plan):
    stats = hot.groupBy("host").agg(F.max("value").alias("top"))
    rows = attach(hot, stats, KEYS)
    assert rows.count() == 90
    tops = {host: max(v) for host, v in values(hot).items()}
    assert all(r.top == tops[r.host] for r in rows.collect())
    whole = attach(hot, hot.agg(F.max("value").alias("top")), [])
    assert {r.top for r in whole.collect()} == {max(tops.values())}

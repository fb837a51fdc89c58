import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import by_series, minute, values
from tidemark.operators import anomaly

KEYS, ORDER = ["host"], ["ts", "id"]


def loop(v, w, sigmas=3.0, last=False, nan=False):
    """Brute force over numpy slices."""
    v = np.array([np.nan if x is None else x for x in v], dtype=float)
    median = np.nanmedian if nan else np.median
    flags = []
    for i in range(w, len(v) - w + (1 if last else 0)):
        part = v[i - w : i + w]
        m = median(part)
        if abs(v[i] - m) > sigmas * 1.4826 * median(np.abs(part - m)):
            flags.append(i)
    return flags


@pytest.mark.parametrize("last", [False, True])
@pytest.mark.parametrize("w", [2, 4])
def test_hampel_is_the_loop(hot, plan, last, w):
    df = hot.withColumn("value", F.when(F.col("id") % 13 == 5, 900.0).otherwise(F.col("value")))
    found = by_series(
        anomaly.hampel(df, KEYS, ORDER, "value", w, 2.0, include_last=last), "is_outlier", "cleaned"
    )
    for host, v in values(df).items():
        want = loop(v, w, 2.0, last)
        assert [i for i, (flag, _) in enumerate(found[host]) if flag] == want
        for i, (flag, cleaned) in enumerate(found[host]):
            assert np.isclose(cleaned, np.median(v[i - w : i + w]) if flag else v[i])


@pytest.mark.parametrize("last", [False, True])
def test_hampel_closed_on_both_sides(hot, plan, last):
    found = by_series(
        anomaly.hampel(hot, KEYS, ORDER, "value", 3, 1.0, include_last=last, closed="both"),
        "is_outlier",
    )
    for host, v in values(hot).items():
        want = []
        for i in range(3, len(v) - 3):
            part = np.array(v[i - 3 : i + 4])
            m = np.median(part)
            if abs(v[i] - m) > 1.4826 * np.median(np.abs(part - m)):
                want.append(i)
        assert [i for i, (f,) in enumerate(found[host]) if f] == want


def test_hampel_with_nulls(hot, plan):
    df = hot.withColumn("value", F.when(F.col("id") % 7 != 3, F.col("value") ** 3))
    tolerant = by_series(
        anomaly.hampel(df, KEYS, ORDER, "value", 3, 1.0, skip_nulls=True), "is_outlier"
    )
    strict = by_series(anomaly.hampel(df, KEYS, ORDER, "value", 3, 1.0), "is_outlier")
    for host, v in values(df).items():
        assert [i for i, (f,) in enumerate(tolerant[host]) if f] == loop(v, 3, 1.0, nan=True)
        assert [i for i, (f,) in enumerate(strict[host]) if f] == loop(v, 3, 1.0)


def test_hampel_leaves_constant_series(spark):
    rows = [("a", minute(i), i, 4.0) for i in range(30)]
    df = spark.createDataFrame(rows, "host string, ts timestamp_ntz, id long, value double")
    assert anomaly.hampel(df, KEYS, ORDER, "value", 5).filter("is_outlier").count() == 0


def test_three_spikes_are_found(spark):
    v = [10 + (i % 4) * 0.5 for i in range(60)]
    for i in (15, 30, 44):
        v[i] += 40
    rows = [("a", minute(i), i, x) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "host string, ts timestamp_ntz, id long, value double")
    found = anomaly.hampel(df, KEYS, ORDER, "value", 10).filter("is_outlier")
    true = spark.createDataFrame([(15,), (30,), (59,)], "id long")
    report = anomaly.detection_report(anomaly.detection_sets(true, found, ["id"])).first()
    assert (report.n_true, report.n_identified, report.n_correct) == (3, 3, 2)
    assert (report.n_false, report.n_missed) == (1, 1)
    assert np.isclose(report.percent_detected, 200 / 3)


def test_gap_or_level(spark):
    rows = [(10.0, 41.0), (10.0, 39.9), (59.0, 60.0), (10.0, None), (90.0, 60.0)]
    df = spark.createDataFrame(rows, "actual double, predicted double")
    found = {(r.actual, r.predicted): r.rule for r in
             anomaly.gap_or_level(df, "actual", "predicted").collect()}
    assert found == {(10.0, 41.0): "gap", (59.0, 60.0): "level", (90.0, 60.0): "gap+level"}


def test_peak_alert(hot, plan):
    df = hot.withColumn("ts", F.col("ts") + F.expr("make_dt_interval(0, 0, 0, id)"))
    found = anomaly.peak_alert(df, KEYS, ORDER, "ts", "value", 6, 60.0).collect()
    got = sorted((r.host or "", r.window_end, r.peak_ts, r.peak_value) for r in found)
    want = []
    for host, rows in by_series(df, "ts", "value").items():
        last = None
        for i in range(5, len(rows)):
            part = rows[i - 5 : i + 1]
            top = max(v for _, v in part)
            at = next(t for t, v in part if v == top)
            if top >= 60 and at != last:
                want.append((host or "", rows[i][0], at, top))
            last = at
    assert got == sorted(want) and got


def test_jumps_and_percentile_alerts(hot, plan):
    ahead = anomaly.neighbour_jump(hot, KEYS, ORDER, "value", 30.0)
    back = anomaly.prediction_jump(hot, KEYS, ORDER, "value", 30.0)
    n = sum(
        sum(abs(a - b) >= 30 for a, b in zip(v, v[1:])) for v in values(hot).values()
    )
    assert ahead.count() == back.count() == n
    high = anomaly.rolling_percentile_alert(hot, KEYS, ORDER, "value", 20, 90.0)
    want = sum(
        np.percentile(v[i : i + 20], 99, method="midpoint") >= 90
        for v in values(hot).values()
        for i in range(len(v))
    )
    assert high.count() == want


def test_level_label(spark):
    df = spark.createDataFrame([(59.9,), (60.0,)], "value double")
    assert [r.label for r in anomaly.label_level(df, "value").orderBy("value").collect()] == [
        "normal", "anomaly",
    ]

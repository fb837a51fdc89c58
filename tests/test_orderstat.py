from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import lcg, minute
from tidemark.operators import orderstat


def brute(x, first, last, before, after):
    out = []
    for i in range(len(x)):
        own = x[max(first[i], i - before) : min(last[i], i + after + 1)]
        own = own[~np.isnan(own)]
        middle = np.median(own) if len(own) else np.nan
        out.append((middle, np.median(np.abs(own - middle)) if len(own) else np.nan))
    return np.array(out).T


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("before,after", [(0, 0), (3, 2), (20, 20), (60, 60), (0, 90), (1000, 0)])
def test_equals_brute_force(seed, before, after):
    rng = np.random.default_rng(seed)
    x = rng.choice([rng.normal(size=400), rng.integers(0, 4, 400).astype(float)][seed % 2], 400)
    x[rng.random(400) < 0.2] = np.nan
    cuts = np.array([0, 1, 2, 150, 390, 400])
    first, last = np.repeat(cuts[:-1], np.diff(cuts)), np.repeat(cuts[1:], np.diff(cuts))
    want = brute(x, first, last, before, after)
    for form in (orderstat._narrow, orderstat._wide):
        np.testing.assert_allclose(form(x, first, last, before, after), want, rtol=1e-12)


def test_sorted_window():
    rng = random.Random(1)
    window, held = orderstat.SortedWindow(), []
    for _ in range(600):
        if held and rng.random() < 0.45:
            window.remove(held.pop(rng.randrange(len(held))))
        else:
            held.append(rng.choice([1.0, 2.5, rng.random() * 9, -rng.random()]))
            window.add(held[-1])
        if held:
            assert window.median() == np.median(held)
            assert window.mad() == pytest.approx(np.median(np.abs(np.array(held) - np.median(held))), abs=1e-15)
    assert np.isnan(orderstat.SortedWindow().mad())


def test_cost_of_wide_windows_is_that_of_narrow_ones():
    x = np.array(lcg(20_000))
    ends = np.zeros(20_000, int), np.full(20_000, 20_000)
    took = []
    for w in (100, 3_000):
        start = time.perf_counter()
        orderstat._wide(x, *ends, w, w)
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0]


def test_series_over_batch_ends(spark, plan):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rows = [(h, minute(i // 2), i, v) for h, n in (("a", 61), ("b", 1), (None, 9), ("c", 4)) for i, v in enumerate(lcg(n))]
        df = spark.createDataFrame(rows[::-1], "host string, ts timestamp_ntz, id long, value double")
        out = orderstat.rolling_median_mad(df, ["host"], ["ts", "id"], "value", 3, 2, 3)
        got = {(r.host, r.id): r for r in out.collect()}
        assert len(got) == len(rows)
        for host in ("a", "b", None, "c"):
            x = np.array([r[3] for r in rows if r[0] == host])
            want = brute(x, np.zeros(len(x), int), np.full(len(x), len(x)), 3, 2)
            for i in range(len(x)):
                r = got[host, i]
                assert (r.median, r.mad) == pytest.approx(tuple(want[:, i]))
                assert r.rows_in_window == min(len(x), i + 3) - max(0, i - 3) and r.nulls_in_window == 0
        some = out.filter((F.col("id") == 5) & (F.col("host") == "a")).collect()  # a filter behind changes no window
        assert some == [got["a", 5]]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

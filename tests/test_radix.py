from __future__ import annotations

import math

import numpy as np
import pytest

from tidemark.operators import clean, profile, radix, scaling


def test_keys_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, np.inf, np.nan])
    keys = radix.ordered_keys(x)
    assert (np.diff(keys.astype(object)) >= 0).all() and keys[4] == keys[5] and len(set(keys.tolist())) == 11
    for a, k in zip(x, keys.tolist()):
        assert radix.from_key(k) == a or math.isnan(a)


@pytest.mark.parametrize("seed", range(3))
def test_equals_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=501) * 10.0 ** rng.integers(-5, 9, 501)
    b = rng.integers(-3, 4, 501).astype(float)
    rows = [(float(x), None if i % 5 == 0 else int(y), 7.25, None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b long, c float, d double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.777, 1.0]
    got = radix.table_quantiles(df, ["a", "b", "c", "d"], probs)
    np.testing.assert_allclose(got[0], np.quantile(a, probs), rtol=1e-12)
    np.testing.assert_allclose(got[1], np.quantile([y for i, y in enumerate(b) if i % 5], probs), rtol=1e-12)
    assert got[2] == [7.25] * 6 and got[3] == [None] * 6


def test_extremes(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (-0.0,), (1e-320,)], "x double")
    (got,) = radix.table_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0])
    assert got[:4] == [float("-inf"), 0.0, 1e-320, float("inf")] and math.isnan(got[4])
    assert radix.table_quantiles(df.limit(0), ["x"], [0.5]) == [[None]]


def test_scans_do_not_grow_with_the_columns(spark):
    df = spark.createDataFrame([tuple(float((i * k) % 17) for k in range(1, 9)) for i in range(60)], [f"c{k}" for k in range(8)])
    tracker = spark.sparkContext.statusTracker()

    def jobs(group, work):
        spark.sparkContext.setJobGroup(group, group)
        work()
        return len(tracker.getJobIdsForGroup(group))

    try:
        few = jobs("few", lambda: radix.table_quantiles(df, ["c1"], [0.5]))
        many = jobs("many", lambda: radix.table_quantiles(df, [f"c{k}" for k in range(8)], [0.1, 0.5, 0.9]))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert many <= few + radix.PASSES


def test_users_of_table_quantiles(spark):
    x = [float(i * 7 % 31) for i in range(31)]
    df = spark.createDataFrame([(v, v * 2, "k") for v in x], "x double, y double, k string")
    row = {r.column: r for r in profile.describe(df, ["x", "y"]).collect()}
    assert (row["x"].q25, row["x"].q50, row["y"].q75, row["y"]["count"]) == (7.5, 15.0, 45.0, 31)
    by_key = profile.describe(df, ["x", "y"], ["k"]).collect()
    assert {(r.column, r.q50, r.min, r.max) for r in by_key} == {("x", 15.0, 0.0, 30.0), ("y", 30.0, 0.0, 60.0)}
    stats = scaling.fit(df, [], ["x", "y"], "robust").first()
    assert (stats.x_center, stats.x_scale, stats.y_scale) == (15.0, 15.0, 30.0)
    bins = clean.decile_bins(df, ["x"]).collect()
    assert all(r.x_bin == sum(e < r.x for e in np.quantile(x, [i / 10 for i in range(1, 10)])) for r in bins)

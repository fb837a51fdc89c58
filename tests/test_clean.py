import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import lcg
from tidemark.operators import clean, ordered, profile, resample, scaling


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(1, 2.0, None, 3.0), (2, None, 5.0, None), (3, 4.0, 7.0, 1.0), (4, None, None, 2.0)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double")


def test_impute(gaps):
    out = clean.impute(gaps, {"a": "mean", "b": "default", "c": "customize"}, value=-1.0)
    rows = {r.id: (r.a, r.b, r.c) for r in out.collect()}
    assert rows == {1: (2.0, 5.0, 3.0), 2: (3.0, 5.0, -1.0), 3: (4.0, 7.0, 1.0), 4: (3.0, 5.0, 2.0)}


def test_impute_rejects_mistakes(gaps):
    with pytest.raises(ValueError):
        clean.impute(gaps, {"zzz": "mean"})
    with pytest.raises(ValueError):
        clean.impute(gaps, {"a": "median"})


def test_null_profile_and_duplicates(gaps):
    found = {r.column: r.nulls for r in clean.null_profile(gaps).collect()}
    assert found == {"id": 0, "a": 2, "b": 2, "c": 1}
    assert clean.duplicate_keys(gaps, ["id"]).count() == 0
    twice = gaps.unionByName(gaps.filter("id = 2"))
    assert [(r.id, r.n) for r in clean.duplicate_keys(twice, ["id"]).collect()] == [(2, 2)]


def test_non_finite_rows(spark):
    rows = [(1.0,), (float("inf"),), (float("-inf"),), (float("nan"),), (None,), (-2.0,)]
    df = spark.createDataFrame(rows, "x double")
    assert sorted(r.x for r in clean.drop_non_finite(df, ["x"]).collect()) == [-2.0, 1.0]


def test_sentinel_and_one_hot(spark):
    df = spark.createDataFrame([(-9999.0, 0), (3.5, 1), (None, 1)], "v double, k int")
    assert [r.v for r in clean.repair_sentinel(df, ["v"]).collect()] == [0.0, 3.5, None]
    hot = clean.one_hot(df, "k", [0, 1], "is_").collect()
    assert [(r.is_0, r.is_1) for r in hot] == [(1, 0), (0, 1), (0, 1)]


def test_timestamps(spark):
    df = spark.createDataFrame([("2020/10/01_00:03:00",), ("rubbish",)], "t string")
    out = clean.parse_timestamp(df, "t", "yyyy/MM/dd_HH:mm:ss").collect()
    assert [r.t for r in out] == [dt.datetime(2020, 10, 1, 0, 3), None]


def test_subsample_and_range(hot, plan):
    every = clean.every_nth(hot, ["host"], ["ts", "id"], 6, 5)
    assert sorted(r.id for r in every.filter("host = 'a'").collect()) == list(range(5, 61, 6))
    some = clean.position_range(hot, ["host"], ["ts", "id"], 3, 6)
    assert sorted(r.id for r in some.filter("host = 'b'").collect()) == [3, 4, 5, 6]


def test_chronological_split(hot, plan):
    out = ordered.chronological_split(
        hot, ["host"], ["ts", "id"], {"train": 0.7, "val": 0.9}, "test"
    )
    rows = out.filter("host = 'b'").orderBy("id").collect()
    assert [r.split for r in rows] == ["train"] * int(9 * 0.7) + ["val"] * 2 + ["test"]


def test_hashed_split_is_stable(spark):
    df = spark.range(5000)
    out = ordered.hashed_split(df, "id", 0.1, 2019)
    again = ordered.hashed_split(df.repartition(7), "id", 0.1, 2019)
    test = {r.id for r in out.filter("split = 'test'").collect()}
    assert test == {r.id for r in again.filter("split = 'test'").collect()}
    assert 400 < len(test) < 600
    assert out.filter("split = 'train'").count() == 5000 - len(test)


def test_deciles(spark, plan):
    v = lcg(40, 5)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id int, x double")
    edges = np.percentile(v, range(10, 100, 10))
    rows = clean.decile_bins(df, ["x"]).orderBy("id").collect()
    assert [r.x_bin for r in rows] == np.searchsorted(edges, v).tolist()


def test_resample_fills_gaps(spark, plan):
    at = dt.datetime(2021, 2, 1)
    rows = [("a", at + dt.timedelta(hours=h, minutes=m), v) for h, m, v in
            [(0, 5, 1.0), (0, 50, 3.0), (3, 0, 10.0), (4, 59, 2.0)]]
    df = spark.createDataFrame(rows + [("b", at, 7.0)], "host string, ts timestamp_ntz, v double")
    out = resample.resample(
        df, ["host"], "ts", "hour", {"mean": F.avg("v"), "total": F.sum("v")}, {"total": 0.0}
    )
    got = sorted((r.host, r.bucket.hour, r["mean"], r.total) for r in out.collect())
    assert [g[:3] for g in got if g[2] is not None] == [
        ("a", 0, 2.0), ("a", 3, 10.0), ("a", 4, 2.0), ("b", 0, 7.0),
    ]
    assert [(g[1], g[3]) for g in got if g[2] is None] == [(1, 0.0), (2, 0.0)]


def test_month_gap(spark):
    rows = [(dt.datetime(2020, 11, 3), 1.0), (dt.datetime(2021, 2, 9), 2.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    out = resample.resample(df, [], "ts", "month", {"v": F.sum("v")}, {"v": 0.0})
    assert sorted((r.bucket.year, r.bucket.month, r.v) for r in out.collect()) == [
        (2020, 11, 1.0), (2020, 12, 0.0), (2021, 1, 0.0), (2021, 2, 2.0),
    ]


def test_thirty_days_distinct(spark, plan):
    base = dt.datetime(1970, 1, 1)
    prices = {0: [10.0, 10.0, 40.0, 70.0], 31: [5.0], 65: [1.0, 2.0, 2.0, None]}
    rows = [(base + dt.timedelta(days=d), p) for d, ps in prices.items() for p in ps]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, price double")
    out = {r.start: r for r in resample.tumbling_center(df, [], "ts", "price", "30 days").collect()}
    first = out[base]
    assert (first.rows, first["mean"], first["median"]) == (4, 40.0, 40.0)
    third = out[base + dt.timedelta(days=60)]
    assert (third.rows, third["mean"], third["median"]) == (4, 1.5, 1.5)
    plain = resample.tumbling_center(df, [], "ts", "price", "30 days", distinct=False)
    first = {r.start: r for r in plain.collect()}[base]
    assert (first["mean"], first["median"]) == (32.5, 25.0)


@pytest.mark.parametrize("mode", scaling.MODES)
def test_scaling_inverts(hot, plan, mode):
    stats = scaling.fit(hot, ["host"], ["value"], mode, low=-1.0, high=1.0)
    rows = scaling.transform(hot, stats, ["host"], ["value"])
    rows = scaling.invert(rows.withColumn("back", F.col("value_scaled")), {"back": "value"})
    found = rows.collect()
    assert len(found) == 90
    assert np.allclose([r.back for r in found], [r.value for r in found])
    if mode == "minmax":
        assert min(r.value_scaled for r in found) == -1.0
        assert max(r.value_scaled for r in found) == 1.0


def test_constant_column_scales_to_low(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 3.0)], "host string, v double")
    for mode, low in (("minmax", -1.0), ("robust", 0.0), ("standard", 0.0)):
        stats = scaling.fit(df, ["host"], ["v"], mode, low=-1.0, high=1.0)
        out = scaling.transform(df, stats, ["host"], ["v"]).collect()
        assert {r.v_scaled for r in out} == {low}
    with pytest.raises(ValueError):
        scaling.fit(df, ["host"], ["v"], "median")


def test_scale_on_train_only(spark):
    rows = [("a", "train", 0.0), ("a", "train", 10.0), ("a", "test", 20.0), ("a", "test", 40.0)]
    df = spark.createDataFrame(rows, "host string, split string, v double")
    train = scaling.scale(df, ["host"], ["v"], "minmax")
    assert sorted(r.v_scaled for r in train.collect()) == [0.0, 1.0, 2.0, 4.0]
    split = scaling.scale(df, ["host"], ["v"], "minmax", fit_scope="split")
    assert sorted(r.v_scaled for r in split.collect()) == [0.0, 0.0, 1.0, 1.0]


@pytest.mark.parametrize("mode", ["minmax", "robust"])
def test_window_scaling(hot, plan, mode):
    rows = scaling.scale_in_window(hot, ["host"], ["ts", "id"], "value", 8, mode)
    series = {}
    for r in rows.collect():
        series.setdefault(r.host, {})[r.id] = r
    for found in series.values():
        v = [found[i].value for i in range(len(found))]
        for i in range(len(v)):
            part = np.array(v[max(0, i - 7) : i + 1])
            if i < 7:
                assert found[i].value_scaled is None
            elif mode == "minmax":
                assert np.isclose(
                    found[i].value_scaled, (v[i] - part.min()) / (part.max() - part.min())
                )
            else:
                q1, q2, q3 = np.percentile(part, [25, 50, 75])
                assert np.isclose(found[i].value_scaled, (v[i] - q2) / (q3 - q1))


def test_spearman(spark, plan):
    rows = [(float(i % 7), x, float(round(x) % 4)) for i, x in enumerate(lcg(50, 9))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    want = df.toPandas().corr(method="spearman")
    for r in profile.spearman(df, ["a", "b", "c"]).collect():
        assert np.isclose(r.rho, want.loc[r.x, r.y])


def test_describe(spark, plan):
    v = lcg(41, 4)
    df = spark.createDataFrame([(x, i) for i, x in enumerate(v)], "x double, y int")
    want = df.toPandas().describe().T
    for r in profile.describe(df, ["x", "y"]).collect():
        got = [r["count"], r["mean"], r["std"], r["min"], r.q25, r.q50, r.q75, r["max"]]
        assert np.allclose(got, want.loc[r.column].to_numpy())


def test_density_of_distinct_values(spark):
    v = np.array(lcg(60, 8))
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    h = v.std(ddof=1) * len(v) ** -0.2
    for r in profile.density(df, "x", points=20, bins=None).collect():
        z = (r.x - v) / h
        want = np.exp(-0.5 * z * z).sum() / (len(v) * h * np.sqrt(2 * np.pi))
        assert np.isclose(r.density, want)


def test_box_and_histogram(spark):
    df = spark.createDataFrame([(float(x), 0.0) for x in [1, 2, 3, 4, 100]], "x double, y double")
    box = profile.box_stats(df, "x", whisker=1.5).first()
    assert (box.q1, box["median"], box.q3, box.whisker_low, box.whisker_high, box.fliers) == (
        2.0, 3.0, 4.0, 1.0, 4.0, 1,
    )
    assert [r.x for r in profile.fliers(df, "x", whisker=1.5).collect()] == [100.0]
    grid = {(r.bx, r.by): r.n for r in profile.histogram_2d(df, "x", "y", 10).collect()}
    assert grid == {(0, 0): 4, (9, 0): 1}

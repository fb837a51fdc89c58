import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tests.conftest import by_series, minute, values
from tidemark.operators import explain, forecast, joins, models, spectral
from tidemark.session import scratch

KEYS, ORDER = ["host"], ["ts", "id"]


def test_baselines(hot, plan):
    one = by_series(forecast.persistence(hot, KEYS, ORDER, "value"), "predicted")
    many = by_series(forecast.repeat_previous(hot, KEYS, ORDER, "value", 5), "predicted")
    ahead = forecast.last_value(hot, KEYS, ORDER, "value", 3).collect()
    for host, v in values(hot).items():
        assert [p for (p,) in one[host]] == [None, *v[:-1]]
        assert [p for (p,) in many[host]] == [None] * 5 + v[:-5]
        got = {(r.origin, r.h): (r.actual, r.predicted) for r in ahead if r.host == host}
        assert got == {
            (i, h): (v[i + h], v[i])
            for i in range(len(v)) for h in (1, 2, 3) if i + h < len(v)
        }


def test_least_squares(hot, plan):
    rows = forecast.lag_table(hot, KEYS, ORDER, "value", 3)
    found = {r.host: r for r in
             forecast.least_squares(rows, KEYS, ["lag_1", "lag_2", "lag_3"], "value").collect()}
    for host, v in values(hot).items():
        v = np.array(v)
        x = np.column_stack([np.ones(len(v) - 3), v[2:-1], v[1:-2], v[:-3]])
        w, *_ = np.linalg.lstsq(x, v[3:], rcond=None)
        assert np.allclose(found[host].weights, w)
        assert np.isclose(found[host].sse, ((v[3:] - x @ w) ** 2).sum())
        assert found[host].rows == len(v) - 3


def test_ar1_recursion(hot, plan):
    model = forecast.fit_ar1(hot, KEYS, ORDER, "value")
    out = forecast.forecast_ar1(hot, model, KEYS, ORDER, "value", 4)
    got = {}
    for r in out.orderBy("h").collect():
        got.setdefault(r.host, []).append(r.predicted)
    for host in ("a", "b"):
        v = values(hot)[host]
        slope, intercept = np.polyfit(v[:-1], v[1:], 1)
        x = v[-1]
        for p in got[host]:
            x = intercept + slope * x
            assert np.isclose(p, x)


def test_direct_horizons(hot, plan):
    out = forecast.direct_multi_horizon(hot.filter("host = 'a'"), KEYS, ORDER, "value", 2, 3)
    v = np.array(values(hot)["a"])
    for r in out.collect():
        rows = [(1.0, v[i], v[i - 1]) for i in range(1, len(v) - r.h)]
        w, *_ = np.linalg.lstsq(np.array(rows), v[1 + r.h :], rcond=None)
        assert np.isclose(r.predicted, w @ [1.0, v[-1], v[-2]])


def test_drift(hot, plan):
    got = by_series(forecast.predict_drift(hot, KEYS, ORDER, "value"), "predicted")
    for host, v in values(hot).items():
        drift = np.mean(np.diff(v))
        assert np.allclose([p for (p,) in got[host]][1:], np.array(v[:-1]) + drift)


def test_spectrum(hot, plan):
    got = {}
    for r in spectral.spectrum(hot, KEYS, ORDER, "value").orderBy("k").collect():
        got.setdefault(r.host, []).append(r.magnitude)
    some = {(r.host, r.k): r.magnitude for r in
            spectral.dft_bins(hot, KEYS, ORDER, "value", [1, 3]).collect()}
    for host, v in values(hot).items():
        want = np.abs(np.fft.rfft(v))
        assert np.allclose(got[host], want)
        assert np.isclose(some[host, 3], want[3])


def test_spectrum_one_series_at_a_time(spark, hot):
    out = spectral.spectrum(hot, KEYS, ORDER, "value", packed_rows=10)
    got = {(r.host, r.k): r.magnitude for r in out.collect()}
    for host, v in values(hot).items():
        want = np.abs(np.fft.rfft(v))
        assert np.allclose([got[host, k] for k in range(len(want))], want)


def leveled(spark, level):
    """Two features and a target around a level, and white noise around it."""
    rng = np.random.default_rng(4)
    x = level + rng.uniform(size=(400, 2))
    y = 2 * x[:, 0] - 3 * x[:, 1] + 1 + 0.01 * rng.normal(size=400)
    rows = [("a", minute(i), i, *map(float, (a, b, c))) for i, ((a, b), c) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "host string, ts timestamp_ntz, id long, x1 double, x2 double, y double")


@pytest.mark.parametrize("level", [0.0, 1e4, 1e8])
def test_fits_do_not_depend_on_the_level(spark, level):
    x, y, df = leveled(spark, level)
    off = x - x.mean(axis=0)
    want = np.linalg.lstsq(off, y - y.mean(), rcond=None)[0]
    for weight in (None, "w"):
        got = forecast.least_squares(df.withColumn("w", F.lit(2.0)), ["host"], ["x1", "x2"], "y", weight=weight).first()
        assert np.allclose(got.weights[1:], want, rtol=1e-6, atol=1e-6) and not got.singular
    near = spectral.dickey_fuller(df, ["host"], ["ts", "id"], "x1", 1).first()
    zero = spectral.dickey_fuller(leveled(spark, 0.0)[2], ["host"], ["ts", "id"], "x1", 1).first()
    assert np.isclose(near.statistic, zero.statistic, rtol=1e-5) and near.statistic < -10


def test_dependent_features_are_flagged(spark):
    _, _, df = leveled(spark, 1e4)
    got = forecast.least_squares(df.withColumn("x3", F.col("x1") + F.col("x2")), ["host"], ["x1", "x2", "x3"], "y").first()
    assert got.singular and got.weights is None and got.sse is None


@pytest.mark.parametrize("max_lags", [0, 3])
def test_dickey_fuller(hot, plan, max_lags):
    found = {r.host: r for r in
             spectral.dickey_fuller(hot, KEYS, ORDER, "value", max_lags).collect()}

    def fit(v, lags, skip):
        d = np.diff(v)
        rows = range(skip, len(d))
        x = np.array([[1.0, v[t], *[d[t - i] for i in range(1, lags + 1)]] for t in rows])
        y = d[skip:]
        w, *_ = np.linalg.lstsq(x, y, rcond=None)
        sse = ((y - x @ w) ** 2).sum()
        n, k = x.shape
        se = np.sqrt(np.linalg.inv(x.T @ x)[1, 1] * sse / (n - k))
        return w[1] / se, n * (np.log(2 * np.pi * sse / n) + 1) + 2 * k, n

    for host in ("a", None):
        v = np.array(values(hot)[host])
        lags = min(range(max_lags + 1), key=lambda i: fit(v, i, max_lags)[1])
        stat, _, n = fit(v, lags, lags)
        row = found[host]
        assert (row.lags, row.rows) == (lags, n)
        assert np.isclose(row.statistic, stat)
        assert 0 <= row.p_value <= 1 and row.critical_1 < row.critical_5 < row.critical_10


def test_p_value_at_critical_value():
    assert abs(spectral._p_value(-2.86) - 0.05) < 0.002
    assert abs(spectral._p_value(-3.43) - 0.01) < 0.001


def test_stages_survive_saving(spark):
    df = spark.createDataFrame(
        [(1, None, "The cat, a hat"), (2, 4.0, "dogs!"), (3, 8.0, "x")],
        "id int, v double, text string",
    )
    chain = Pipeline(stages=[
        models.ImputeStage(inputCols=["v"], modes=["mean"]),
        models.RobustScaleStage(inputCol="v", outputCol="scaled"),
        models.TokenStage(inputCol="text", outputCol="tokens", stopWords=["the", "a"]),
        models.FeatureStage(inputCols=["id", "scaled", "tokens"]),
    ]).fit(df)
    path = scratch(spark, "chain")
    models.save_model(chain, path)
    loaded = PipelineModel.load(path)
    want = [(1, 0.0, ["cat", ",", "hat"]), (2, -1.0, ["dogs", "!"]), (3, 1.0, ["x"])]
    for fitted in (chain, loaded):
        assert [tuple(r) for r in fitted.transform(df).orderBy("id").collect()] == want


def test_linear_pipeline_and_search(spark):
    rows = [(float(i), float(i % 5), 3.0 * i - 2.0 * (i % 5) + 1) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    model = models.linear_model(["a", "b"], "y").fit(df)
    weights = {r.feature: r.weight for r in models.feature_weights(spark, model).collect()}
    assert np.allclose([weights["a"], weights["b"], weights["(intercept)"]], [3, -2, 1])
    pipeline = models.linear_model(["a", "b"], "y")
    linear = pipeline.getStages()[-1]
    path = scratch(spark, "best")
    report, tuned = models.search(
        df, pipeline, [{linear.regParam: 0.0}, {linear.regParam: 1000.0}], "y", 0.9, save_to=path
    )
    found = {r.fit: r for r in report.collect()}
    assert found[0].best and found[0].kept and not found[1].kept
    assert np.isclose(models.load_model(path).transform(df).first().predicted, rows[0][2])


def test_batch_inference_loads_on_the_executor(spark):
    def load():
        return np.array([[1.0, 0.0], [0.0, 1.0]])

    def predict(model, batch):
        x = np.stack(batch["v"].to_numpy())
        return batch[["id"]].assign(predicted=(x @ model).argmax(1))

    df = spark.createDataFrame([(1, [2.0, 1.0]), (2, [0.0, 5.0])], "id int, v array<double>")
    out = models.batch_inference(df, load, predict, "id int, predicted long")
    assert {r.id: r.predicted for r in out.collect()} == {1: 0, 2: 1}


@pytest.mark.parametrize("replacement", ["total_mean", "noise"])
def test_attribution_finds_the_slice_that_matters(spark, replacement):
    rows = [(1, [0.0] * 8 + [9.0] * 4 + [0.0] * 8), (2, [float(i % 3) for i in range(20)])]
    df = spark.createDataFrame(rows, "id long, v array<double>")

    def score(d):
        return d.withColumn("score", F.get("v", F.lit(9)))

    out = explain.slice_weights(df, "id", "v", score, slices=5, samples=200, top=3,
                                replacement=replacement)
    again = explain.slice_weights(df.repartition(3), "id", "v", score, slices=5, samples=200,
                                  top=3, replacement=replacement)
    best = {r.id: r.slice for r in out.filter("rank = 1").collect()}
    assert best[1] == 2
    assert out.count() == 6
    assert {(r.id, r.rank, r.slice) for r in out.collect()} == {
        (r.id, r.rank, r.slice) for r in again.collect()
    }


def test_attribution_with_neighbours(spark):
    """The score may be a join: here the vote share of the nearest neighbours."""
    rows = [(i, [float(i % 2 * 5)] * 4 + [-5.0] * 4, i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")

    def score(d):
        keyed = d.withColumn("row", F.col("id") * 1000 + F.col("sample"))
        near = joins.nearest_neighbours(
            keyed.select(F.col("row").alias("id"), "v"), df, "id", "v", "label", 3
        )
        share = near.groupBy("test_id").agg(F.avg("train_label").alias("score"))
        return keyed.join(share, keyed.row == share.test_id).drop("test_id", "row")

    one = df.filter("id = 1")
    out = explain.slice_weights(one, "id", "v", score, slices=2, samples=40, top=1)
    assert out.first().slice == 0


def test_windowed_scoring(hot, plan):
    model = forecast.fit_ar1(hot, KEYS, ORDER, "value").withColumn("slope", F.lit(0.0)).withColumn(
        "intercept", F.lit(0.5)
    )
    out = by_series(
        forecast.score_windows_ar1(hot, model, KEYS, ORDER, "value", 6), "id", "predicted"
    )
    for host, v in values(hot).items():
        for i, p in out[host]:
            part = v[i - 5 : i + 1]
            assert np.isclose(p, (min(part) + max(part)) / 2)


def test_minute_helper_orders():
    assert minute(1) > minute(0)

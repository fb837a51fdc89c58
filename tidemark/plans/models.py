"""Queries: fitted models, batch inference, spectrum, unit-root test, attribution."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as fn
from tidemark.functions.arrays import squared_distance
from tidemark.functions.rounding import rounded
from tidemark.operators import (
    explain,
    forecast,
    models,
    ordered,
    profile,
    score,
    spectral,
    text,
    windows,
)
from tidemark.operators.ordering import Frames
from tidemark.plans.forecasting import _LAGGED, THREE_FIT, THREE_SUMS, THREE_WEIGHTS
from tidemark.plans.registry import Tables, query, r
from tidemark.plans.texts import SQL_STOP, _WORD_PUNCT
from tidemark.plans.windowing import BY_USER, IN_TIME, SQL_ORDER, SQL_POS, SQL_SPLIT, series, split_series
from tidemark.session import scratch

LAGS = ["lag_1", "lag_2", "lag_3"]

_POOLED = f"""{_LAGGED}, q AS (SELECT regr_intercept(value, l1) AS a, regr_slope(value, l1) AS b
    FROM l WHERE split = 'train')"""


def _lags(t: Tables, lags: int) -> DataFrame:
    return forecast.lag_table(split_series(t), BY_USER, IN_TIME, "value", lags)


@query(
    "linear_model_weights",
    "F9 F4",
    f"""{_POOLED} SELECT 'lag_1' AS feature, {r("b", 5)} AS weight FROM q
        UNION ALL SELECT '(intercept)', {r("a", 5)} FROM q""",
)
def linear_model_weights(t: Tables) -> DataFrame:
    rows = _lags(t, 1)
    model = models.linear_model(["lag_1"], "value").fit(rows.filter("split = 'train'"))
    return rounded(models.feature_weights(t.spark, model), "weight", digits=5)


@query(
    "linear_model_forecast",
    "F4 S12 F11",
    f"""{_POOLED} SELECT event_id, {r("a + b * l1", 5)} AS predicted FROM l, q
        WHERE split = 'test' AND l1 IS NOT NULL""",
)
def linear_model_forecast(t: Tables) -> DataFrame:
    """Fit, save, load and apply a pipeline."""
    rows = _lags(t, 1)
    model = models.linear_model(["lag_1"], "value").fit(rows.filter("split = 'train'"))
    path = scratch(t.spark, "linear_model")
    models.save_model(model, path)
    out = models.load_model(path).transform(rows.filter("split = 'test'"))
    return rounded(out.select("event_id", "predicted"), "predicted", digits=5)


@query(
    "multivariate_linear_forecast",
    "F4 F5",
    f"""WITH {SQL_SPLIT}, l AS (SELECT event_id, split, value, value AS z,
        lag(value, 1) OVER o AS x1, lag(value, 2) OVER o AS x2, lag(value, 3) OVER o AS x3
        FROM d WINDOW o AS ({SQL_ORDER})),
    g AS (SELECT {THREE_SUMS} FROM l WHERE split = 'train' AND x3 IS NOT NULL),
    k AS (SELECT *, {THREE_WEIGHTS} FROM g)
    SELECT event_id, value, {r(THREE_FIT, 5)} AS predicted FROM l, k
        WHERE split = 'test' AND x3 IS NOT NULL""",
)
def multivariate_linear_forecast(t: Tables) -> DataFrame:
    rows = _lags(t, 3)
    model = models.linear_model(LAGS, "value").fit(rows.filter("split = 'train'"))
    out = model.transform(rows.filter("split = 'test'")).select("event_id", "value", "predicted")
    return rounded(out, "predicted", digits=5)


@query("boosted_forecast", "F5")
def boosted_forecast(t: Tables) -> DataFrame:
    rows = _lags(t, 3)
    fitted = models.boosted_model(LAGS, "value", maxIter=10, maxDepth=3, seed=7).fit(
        rows.filter("split = 'train'")
    )
    return fitted.transform(rows.filter("split = 'test'")).select(
        "event_id", "value", "predicted"
    )


@query("model_search", "F13 S12")
def model_search(t: Tables) -> DataFrame:
    rows = _lags(t, 3).filter("split = 'train'")
    pipeline = models.linear_model(LAGS, "value")
    linear = pipeline.getStages()[-1]
    grid = (
        ParamGridBuilder()
        .addGrid(linear.regParam, [0.0, 0.1, 1.0])
        .addGrid(linear.elasticNetParam, [0.0, 0.5])
        .build()
    )
    report, _ = models.search(rows, pipeline, grid, "value",
                              save_to=scratch(t.spark, "good_model"))
    return report


@query("rising_classifier", "F14 W4 E8")
def rising_classifier(t: Tables) -> DataFrame:
    """Is the next value higher? From 12 rows of the value and its change."""
    change = windows.difference(split_series(t), BY_USER, IN_TIME, "value", first=0.0)
    frames = Frames(change, BY_USER, IN_TIME, before=12)
    past = F.collect_list(F.array("value", "diff")).over(frames.rows(-12, -1))
    rows = frames.df.withColumns({"past": past, "_prev": F.lag("value").over(frames.order)})
    rows = frames.finish(rows).filter(F.size("past") == 12)
    rows = rows.select(
        "event_id",
        "split",
        (F.col("value") > F.col("_prev")).cast("int").alias("rising"),
        array_to_vector(F.flatten("past")).alias("features"),
    )
    fit = LogisticRegression(labelCol="rising", predictionCol="predicted", maxIter=20).fit(
        rows.filter("split = 'train'")
    )
    found = fit.transform(rows.filter("split = 'test'"))
    found = found.withColumn("predicted", F.col("predicted").cast("int"))
    return score.classification_report(found, "rising", "predicted")


@query("text_classifier", "F15 X7 E9")
def text_classifier(t: Tables) -> DataFrame:
    """Class probability of each test document and the threshold of the best F1."""
    docs = text.fill_text(t.documents.select("doc_id", "text"), ["text"])
    rows = ordered.hashed_split(docs.join(t.labels, "doc_id"), "doc_id", 0.3, 2019)
    model = models.text_model("text", "toxic", maxIter=10).fit(rows.filter("split = 'train'"))
    found = model.transform(rows.filter("split = 'test'")).select(
        "doc_id", "toxic", F.get(vector_to_array("probability"), F.lit(1)).alias("p")
    )
    return score.f1_by_threshold(found, "toxic", "p")


_CENTRES = """p AS (SELECT label, unnest(embedding)::DOUBLE AS v,
        generate_subscripts(embedding, 1) AS pos FROM embeddings),
    c AS (SELECT label, list(m ORDER BY pos) AS centre FROM
        (SELECT label, pos, avg(v) AS m FROM p GROUP BY ALL) GROUP BY label)"""


@query(
    "batch_inference",
    "F12",
    f"""WITH {_CENTRES}, d AS (SELECT vec_id, c.label, list_sum(list_transform(
        list_zip(embedding, centre), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))
        AS d2 FROM embeddings, c)
    SELECT vec_id, arg_min(label, d2)::BIGINT AS predicted FROM d GROUP BY vec_id""",
)
def batch_inference(t: Tables) -> DataFrame:
    """A model file (class centres) is shipped to the executors and loaded there."""
    means = profile.mean_series(t.embeddings, "label", "embedding")
    centres = profile.as_arrays(means, ["label"], "pos", "mean", "centre").orderBy("label")
    # One row per class: this is the model, not data.
    rows = centres.collect()
    file = io.BytesIO()
    np.savez(file, labels=[c["label"] for c in rows], centres=[c["centre"] for c in rows])
    model_bytes = file.getvalue()

    def load() -> dict[str, np.ndarray]:
        return dict(np.load(io.BytesIO(model_bytes)))

    def predict(model: dict[str, np.ndarray], batch: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(batch["embedding"].to_numpy()).astype(float)
        gaps = ((x[:, None, :] - model["centres"][None, :, :]) ** 2).sum(2)
        best = model["labels"][gaps.argmin(1)]
        return pd.DataFrame({"vec_id": batch["vec_id"], "predicted": best})

    rows_in = t.embeddings.select("vec_id", "embedding")
    return models.batch_inference(rows_in, load, predict, "vec_id long, predicted long")


@query(
    "token_stage",
    "F11 U4 T6",
    f"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '{_WORD_PUNCT}'),
        lambda w: lower(w) NOT IN {SQL_STOP}))::INT AS tokens,
        array_to_string(list_filter(regexp_extract_all(text, '{_WORD_PUNCT}'),
        lambda w: lower(w) NOT IN {SQL_STOP}), ' ') AS joined FROM documents""",
)
def token_stage(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    stage = models.TokenStage(inputCol="text", outputCol="words", stopWords=list(fn.STOP_WORDS))
    out = Pipeline(stages=[stage]).fit(docs).transform(docs)
    return out.select(
        "doc_id", F.size("words").alias("tokens"), F.array_join("words", " ").alias("joined")
    )


@query(
    "stage_chain",
    "F11 U4 P8 C2 P1",
    f"""WITH g AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS v
        FROM events), f AS (SELECT event_id, coalesce(v, (SELECT avg(v) FROM g)) AS value FROM g),
    q AS (SELECT quantile_cont(value, 0.5) AS m,
        quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM f)
    SELECT event_id, {r("value")} AS value, {r("(value - m) / iqr")} AS scaled FROM f, q""",
)
def stage_chain(t: Tables) -> DataFrame:
    gaps = t.events.withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    chain = Pipeline(
        stages=[
            models.FeatureStage(inputCols=["event_id", "value"]),
            models.ImputeStage(inputCols=["value"], modes=["mean"]),
            models.RobustScaleStage(inputCol="value", outputCol="scaled"),
        ]
    )
    return rounded(chain.fit(gaps).transform(gaps), "value", "scaled")


def _bins_sql(ks: str) -> str:
    return f"""WITH {SQL_POS}, k AS (SELECT unnest({ks}) AS k)
    SELECT user_id, any_value(n) AS n, k::INT AS k,
        {r("sqrt(pow(sum(value * cos(2 * pi() * k * pos / n)), 2)"
           " + pow(sum(value * sin(2 * pi() * k * pos / n)), 2))", 5)} AS magnitude
    FROM p, k WHERE k <= n // 2 GROUP BY user_id, k"""


@query("spectrum_bins", "F16", _bins_sql("[1, 2, 4, 8, 16]"))
def spectrum_bins(t: Tables) -> DataFrame:
    out = spectral.dft_bins(series(t), BY_USER, IN_TIME, "value", [1, 2, 4, 8, 16])
    return rounded(out, "magnitude", digits=5)


@query("full_spectrum", "F16", _bins_sql("range(0, 100)").replace("k::INT", "k::BIGINT"))
def full_spectrum(t: Tables) -> DataFrame:
    return rounded(spectral.spectrum(series(t), BY_USER, IN_TIME, "value"), "magnitude", digits=5)


@query(
    "spectrum_per_year",
    "F16",
    f"""WITH b AS (SELECT date_trunc('day', o_orderdate) AS day, sum(o_totalprice) AS v
        FROM orders GROUP BY 1),
    p AS (SELECT v, row_number() OVER (ORDER BY day) - 1 AS pos, count(*) OVER () AS n FROM b),
    k AS (SELECT unnest([1, 3, 6, 12]) AS k)
    SELECT any_value(n) AS n, k::INT AS k,
        {r("sqrt(pow(sum(v * cos(2 * pi() * k * pos / n)), 2)"
           " + pow(sum(v * sin(2 * pi() * k * pos / n)), 2))", 2)} AS magnitude,
        {r("k / (any_value(n) * 24.0::DOUBLE / (24 * 365.2425::DOUBLE))")} AS per_year
    FROM p, k GROUP BY k""",
)
def spectrum_per_year(t: Tables) -> DataFrame:
    days = t.orders.groupBy(
        F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day")
    ).agg(F.sum("o_totalprice").alias("v"))
    out = spectral.per_year(spectral.dft_bins(days, [], ["day"], "v", [1, 3, 6, 12]), 24.0)
    return rounded(rounded(out, "per_year"), "magnitude", digits=2)


@query(
    "unit_root_statistic",
    "F17",
    f"""WITH l AS (SELECT user_id, lag(value) OVER w AS x, value - lag(value) OVER w AS d
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, count(*) AS n, regr_slope(d, x) AS b, regr_sxx(d, x) AS sxx,
        regr_syy(d, x) AS syy, regr_sxy(d, x) AS sxy FROM l WHERE x IS NOT NULL GROUP BY 1)
    SELECT user_id, n AS rows, {r("b / sqrt((syy - b * sxy) / (n - 2) / sxx)", 5)} AS statistic,
        {r("-2.86154::DOUBLE - 2.8903::DOUBLE / n - 4.234::DOUBLE / (n * n)"
           " - 40.040::DOUBLE / (n * n * n)")} AS critical_5 FROM s""",
)
def unit_root_statistic(t: Tables) -> DataFrame:
    out = spectral.dickey_fuller(series(t), BY_USER, IN_TIME, "value")
    out = out.select("user_id", "rows", "statistic", "critical_5")
    return rounded(rounded(out, "statistic", digits=5), "critical_5")


@query("unit_root_test", "F17")
def unit_root_test(t: Tables) -> DataFrame:
    return spectral.dickey_fuller(series(t), BY_USER, IN_TIME, "value", max_lags=4)


def _attribution(t: Tables, **how) -> DataFrame:
    """Slices of each vector that hold it near the mean of its class."""
    means = profile.mean_series(t.embeddings, "label", "embedding")
    centres = profile.as_arrays(means, ["label"], "pos", "mean", "centre")
    rows = t.embeddings.select("vec_id", "label", "embedding").join(centres, "label")

    def closeness(df: DataFrame) -> DataFrame:
        gap = squared_distance(F.col("embedding"), F.col("centre"))
        return df.withColumn("score", F.exp(-gap))

    return explain.slice_weights(rows, "vec_id", "embedding", closeness, seed=3, **how)


@query("slice_attribution", "F18")
def slice_attribution(t: Tables) -> DataFrame:
    return _attribution(t, slices=8, samples=64, top=5)


@query(
    "whole_series_attribution",
    "F18",
    f"""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
        generate_subscripts(embedding, 1) AS pos FROM embeddings),
    c AS (SELECT label, pos, avg(x) AS c FROM e GROUP BY 1, 2),
    m AS (SELECT vec_id, avg(x) AS mu FROM e GROUP BY 1),
    s AS (SELECT vec_id, exp(-sum((x - c) * (x - c))) AS s1, exp(-sum((mu - c) * (mu - c))) AS s0,
        63 * exp(-8.0::DOUBLE) AS v FROM e JOIN c USING (label, pos) JOIN m USING (vec_id) GROUP BY 1)
    SELECT vec_id, 1 AS rank, 0 AS slice,
        {r("(s1 - (s1 + v * s0) / (1 + v)) / (1 - 1 / (1 + v) + 1)", 9)} AS weight FROM s""",
)
def whole_series_attribution(t: Tables) -> DataFrame:
    """One slice only: its weight has a closed form over the series itself and 63 variants without it."""
    return rounded(_attribution(t, slices=1, samples=64, top=1), "weight", digits=9)

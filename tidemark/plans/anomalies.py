"""Queries: anomaly rules, forecast alignment and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rounding import r as rd
from tidemark.functions.rounding import rounded
from tidemark.operators import anomaly, forecast, joins, ordered, resample, scaling, score, windows
from tidemark.operators.ordering import Frames
from tidemark.plans.registry import Tables, query, r
from tidemark.plans.windowing import (
    BY_USER,
    IN_TIME,
    SQL_AHEAD,
    SQL_ORDER,
    SQL_SPLIT,
    midpoint_sql,
    series,
    split_series,
)


def _hampel_sql(extra_rows: str = "", last: bool = False, columns: bool = True) -> str:
    around = f"({SQL_ORDER} ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)"
    wide = f"({SQL_ORDER} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)"
    full = "c = 20" if last else "wide = 21"
    source = extra_rows or "SELECT event_id, user_id, ts, value FROM events"
    return f"""e AS ({source}),
    i AS (SELECT event_id, value, count(*) OVER {around} AS c, count(*) OVER {wide} AS wide,
        list(value) FILTER (value IS NOT NULL) OVER {around} AS items FROM e),
    m AS (SELECT *, list_aggregate(items, 'median') AS med FROM i),
    d AS (SELECT *, list_aggregate(list_transform(items, lambda x: abs(x - med)), 'median') AS mad
        FROM m),
    h AS (SELECT event_id, value, med,
        coalesce({full} AND abs(value - med) > 3.0::DOUBLE * (1.4826::DOUBLE * mad), false)
            AS is_outlier FROM d)"""


_HAMPEL_OUT = f"""SELECT event_id, is_outlier,
    {r("CASE WHEN is_outlier THEN med ELSE value END")} AS cleaned FROM h"""


def _hampel(df: DataFrame) -> DataFrame:
    return df.select("event_id", "is_outlier", rd("cleaned").alias("cleaned"))


@query("hampel_filter", "N1", f"WITH {_hampel_sql()} {_HAMPEL_OUT}")
def hampel_filter(t: Tables) -> DataFrame:
    return _hampel(anomaly.hampel(series(t), BY_USER, IN_TIME, "value", 10))


@query("hampel_filter_rolling", "N2 U5", f"WITH {_hampel_sql(last=True)} {_HAMPEL_OUT}")
def hampel_filter_rolling(t: Tables) -> DataFrame:
    return _hampel(anomaly.hampel(series(t), BY_USER, IN_TIME, "value", 10, include_last=True))


@query(
    "hampel_filter_with_gaps",
    "N3",
    "WITH "
    + _hampel_sql(
        """SELECT event_id, user_id, ts,
           CASE WHEN event_type <> 'signup' THEN value END AS value FROM events"""
    )
    + _HAMPEL_OUT,
)
def hampel_filter_with_gaps(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id",
        "user_id",
        "ts",
        F.when(F.col("event_type") != "signup", F.col("value")).alias("value"),
    )
    return _hampel(anomaly.hampel(rows, BY_USER, IN_TIME, "value", 10, skip_nulls=True))


SQL_HOURS = """b AS (SELECT user_id, date_trunc('hour', ts) AS hour, avg(value) AS v FROM events
        GROUP BY ALL),
    p AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n,
        lag(v) OVER w AS prev FROM b WINDOW w AS (PARTITION BY user_id ORDER BY hour)),
    d AS (SELECT *, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split
        FROM p)"""


def hours(t: Tables) -> DataFrame:
    return resample.resample(
        t.events, BY_USER, "ts", "hour", {"v": F.avg("value")}, out="hour", fill_gaps=False
    )


@query(
    "forecast_alerts",
    "A1 X6 C2 F1 N4",
    f"""WITH {SQL_HOURS}, a AS (SELECT user_id, hour, v AS actual, prev AS predicted,
        abs(v - prev) >= 30 AS missed, prev >= 60 AS high FROM d
        WHERE split = 'test' AND prev IS NOT NULL)
    SELECT user_id, hour AS target_ts, {r("actual")} AS actual, {r("predicted")} AS predicted,
        CASE WHEN missed AND high THEN 'gap+level' WHEN missed THEN 'gap' ELSE 'level' END AS rule
    FROM a WHERE missed OR high""",
)
def forecast_alerts(t: Tables) -> DataFrame:
    """The flagship chain: hourly mean, split, scale on train, forecast, invert, alert."""
    rows = ordered.chronological_split(hours(t), BY_USER, ["hour"], {"train": 0.8}, "test")
    rows = scaling.scale(rows, BY_USER, ["v"], "robust")
    rows = forecast.persistence(rows, BY_USER, ["hour"], "v_scaled")
    rows = scaling.invert(rows, {"predicted": "v"}).filter("split = 'test'")
    rows = rows.withColumns({"actual": rd("v"), "predicted": rd("predicted")})
    alerts = anomaly.gap_or_level(rows, "actual", "predicted")
    return alerts.select(
        "user_id", F.col("hour").alias("target_ts"), "actual", "predicted", "rule"
    )


@query(
    "next_step_alerts",
    "N4 W13",
    f"""WITH a AS (SELECT event_id, user_id, ts + INTERVAL 3 MINUTE AS alert_ts, value,
        {r(f"avg(value) OVER ({SQL_ORDER} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)")}
            AS predicted FROM events)
    SELECT event_id, user_id, alert_ts, value, predicted,
        CASE WHEN abs(value - predicted) >= 30 AND predicted >= 60 THEN 'gap+level'
            WHEN abs(value - predicted) >= 30 THEN 'gap' ELSE 'level' END AS rule
    FROM a WHERE abs(value - predicted) >= 30 OR predicted >= 60""",
)
def next_step_alerts(t: Tables) -> DataFrame:


    frames = Frames(series(t), BY_USER, IN_TIME, before=12)
    mean = F.avg("value").over(frames.rows(-12, -1))
    rows = frames.finish(frames.df.withColumn("predicted", rd(mean)))
    rows = windows.next_step_time(anomaly.gap_or_level(rows, "value", "predicted"), "ts", 3,
                                  "alert_ts")
    return rows.select("event_id", "user_id", "alert_ts", "value", "predicted", "rule")


@query(
    "forecast_jump_alerts",
    "N5 W10",
    f"""WITH f AS (SELECT event_id, user_id, ts,
        {r(f"avg(value) OVER ({SQL_ORDER} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")}
            AS predicted FROM events),
    j AS (SELECT event_id, predicted,
        abs(predicted - lag(predicted) OVER ({SQL_ORDER})) AS jump FROM f)
    SELECT event_id, predicted, {r("jump")} AS jump FROM j WHERE jump >= 1""",
)
def forecast_jump_alerts(t: Tables) -> DataFrame:


    frames = Frames(series(t), BY_USER, IN_TIME, before=5)
    mean = F.avg("value").over(frames.rows(-5, 0))
    rows = frames.finish(frames.df.withColumn("predicted", rd(mean)))
    rows = anomaly.prediction_jump(rows, BY_USER, IN_TIME, "predicted", 1.0)
    return rounded(rows.select("event_id", "predicted", "jump"), "jump")


@query(
    "peak_alerts",
    "N6",
    f"""WITH w AS (SELECT user_id, ts, event_id, max(value) OVER f AS peak_value,
        arg_max(ts, value) OVER f AS unsafe, count(*) OVER f AS c,
        list(struct_pack(v := value, t := -epoch_us(ts), at := ts)) OVER f AS items
        FROM events WINDOW f AS ({SQL_ORDER} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
    k AS (SELECT user_id, ts, event_id, c, list_max(items) AS peak FROM w),
    l AS (SELECT *, lag(c) OVER o AS had, lag(peak) OVER o AS last FROM k
        WINDOW o AS ({SQL_ORDER}))
    SELECT user_id, ts AS window_end, peak['at'] AS peak_ts, peak['v'] AS peak_value FROM l
    WHERE c = 12 AND peak['v'] >= 150 AND (had IS DISTINCT FROM 12 OR peak['at'] <> last['at'])""",
)
def peak_alerts(t: Tables) -> DataFrame:
    return anomaly.peak_alert(series(t), BY_USER, IN_TIME, "ts", "value", 12, 150.0)


@query(
    "neighbour_jump_alerts",
    "N7 W11",
    f"""SELECT event_id, value, {r("jump")} AS jump FROM (SELECT event_id, value,
        abs(value - lead(value) OVER ({SQL_ORDER})) AS jump FROM events)
        WHERE round(jump, 6) >= 30""",
)
def neighbour_jump_alerts(t: Tables) -> DataFrame:
    rows = windows.difference(series(t), BY_USER, IN_TIME, "value", "ahead", out="jump")
    rows = rounded(rows, "jump").filter("jump >= 30")
    return rows.select("event_id", "value", "jump")


@query(
    "percentile_alerts",
    "N8",
    f"""WITH {SQL_AHEAD}, g AS (SELECT event_id, more, {r(midpoint_sql(0.99))} AS peak FROM f)
    SELECT event_id, peak, 'any' AS windows FROM g WHERE peak >= 30
    UNION ALL SELECT event_id, peak, 'full' FROM g WHERE peak >= 30 AND more IS NOT NULL""",
)
def percentile_alerts(t: Tables) -> DataFrame:
    parts = []
    for name, tail in (("any", True), ("full", False)):
        rows = anomaly.rolling_percentile_alert(
            series(t), BY_USER, IN_TIME, "value", 20, 30.0, short_tail=tail
        )
        parts.append(rows.select("event_id", rd("peak").alias("peak"), F.lit(name).alias("windows")))
    return ordered.concat(*parts)


@query(
    "level_labels",
    "N9",
    """SELECT event_id, value, CASE WHEN value >= 60 THEN 'anomaly' ELSE 'normal' END AS label
       FROM events""",
)
def level_labels(t: Tables) -> DataFrame:
    return anomaly.label_level(t.events.select("event_id", "value"), "value", 60.0)


_TRUE = "t AS (SELECT event_id FROM events WHERE value >= 200)"
_SETS = f"""WITH {_hampel_sql()}, {_TRUE}, s AS (
    SELECT coalesce(t.event_id, f.event_id) AS event_id, CASE WHEN t.event_id IS NULL THEN 'fp'
        WHEN f.event_id IS NULL THEN 'fn' ELSE 'tp' END AS outcome
    FROM t FULL JOIN (SELECT event_id FROM h WHERE is_outlier) f ON t.event_id = f.event_id)"""


def _sets(t: Tables) -> DataFrame:
    found = anomaly.hampel(series(t), BY_USER, IN_TIME, "value", 10).filter("is_outlier")
    true = t.events.filter("value >= 200")
    return anomaly.detection_sets(true, found, ["event_id"])


@query("detection_sets", "J5", f"{_SETS} SELECT event_id, outcome FROM s")
def detection_sets(t: Tables) -> DataFrame:
    return _sets(t)


@query(
    "detection_report",
    "N10",
    f"""{_SETS} SELECT count(*) FILTER (outcome <> 'fp') AS n_true,
        count(*) FILTER (outcome <> 'fn') AS n_identified,
        count(*) FILTER (outcome = 'tp') AS n_correct,
        count(*) FILTER (outcome = 'fp') AS n_false,
        count(*) FILTER (outcome = 'fn') AS n_missed,
        {r("count(*) FILTER (outcome = 'tp') * 100.0::DOUBLE / count(*) FILTER (outcome <> 'fp')")}
            AS percent_detected FROM s""",
)
def detection_report(t: Tables) -> DataFrame:
    return rounded(anomaly.detection_report(_sets(t)), "percent_detected")


@query(
    "attach_scaled_column",
    "J1",
    f"""WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
    SELECT event_id, user_id, ts, value, {r("(value - lo) / (hi - lo)")} AS value_scaled
    FROM events, m""",
)
def attach_scaled_column(t: Tables) -> DataFrame:
    rows = series(t)
    stats = scaling.fit(rows, [], ["value"], "minmax")
    scaled_rows = scaling.transform(rows, stats, [], ["value"])
    key = ["user_id", "ts", "event_id"]
    out = joins.attach_columns(rows, scaled_rows.select(*key, "value_scaled"), key)
    return rounded(out, "value_scaled")


@query(
    "align_forecast",
    "J6",
    f"""WITH b AS (SELECT user_id, date_trunc('hour', ts) AS hour, avg(value) AS v FROM events
        GROUP BY ALL)
    SELECT f.user_id, f.hour + INTERVAL 1 HOUR AS target_ts, {r("f.v")} AS predicted,
        {r("a.v")} AS actual FROM b f JOIN b a
        ON a.user_id = f.user_id AND a.hour = f.hour + INTERVAL 1 HOUR""",
)
def align_forecast(t: Tables) -> DataFrame:
    rows = hours(t)
    ahead = rows.select(
        "user_id",
        (F.col("hour") + F.expr("INTERVAL '1' HOUR")).alias("target_ts"),
        F.col("v").alias("predicted"),
    )
    actual = rows.select("user_id", "hour", F.col("v").alias("actual"))
    return rounded(joins.align(ahead, actual, BY_USER, "target_ts", "hour"), "predicted", "actual")


_SCORES = f"""{r("avg(abs(y - p))")} AS mae, {r("avg((y - p) * (y - p))")} AS mse,
    {r("sqrt(avg((y - p) * (y - p)))")} AS rmse,
    {r("avg(abs((y - p) / nullif(y, 0))) * 100")} AS mape,
    {r("CASE WHEN var_pop(y) > 0 THEN 1 - avg((y - p) * (y - p)) / var_pop(y) END")} AS r2"""


def _score_sql(source: str, by: str) -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""{source} SELECT {keys}count(*) AS rows, count(*) FILTER (y = 0) AS zero_actuals,
        {_SCORES} FROM f WHERE y IS NOT NULL AND p IS NOT NULL {group}"""


_MODELS = f"""WITH {SQL_SPLIT}, l AS (SELECT *, lag(value) OVER w AS l1, lag(value, 3) OVER w AS l3
        FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT user_id, avg(value - l1) AS drift FROM l WHERE split = 'train' GROUP BY 1),
    f AS (SELECT user_id, split, 'persistence' AS model, value AS y, l1 AS p FROM l
        UNION ALL SELECT user_id, split, 'repeat', value, l3 FROM l
        UNION ALL SELECT user_id, split, 'drift', value, l1 + drift FROM l JOIN g USING (user_id))"""

_SCORE_COLUMNS = ["mae", "mse", "rmse", "mape", "r2"]


def _models(t: Tables) -> DataFrame:
    rows = split_series(t)
    made = {
        "persistence": forecast.persistence(rows, BY_USER, IN_TIME, "value"),
        "repeat": forecast.repeat_previous(rows, BY_USER, IN_TIME, "value", 3),
        "drift": forecast.predict_drift(
            rows, BY_USER, IN_TIME, "value", where=F.col("split") == "train"
        ),
    }
    return ordered.concat(
        *[df.withColumn("model", F.lit(name)) for name, df in made.items()]
    )


@query(
    "forecast_scores",
    "E1 E2 E3",
    _score_sql(
        f"""WITH f AS (SELECT user_id, value AS y, lag(value) OVER ({SQL_ORDER}) AS p
            FROM events)""",
        "user_id",
    ),
)
def forecast_scores(t: Tables) -> DataFrame:
    rows = forecast.persistence(series(t), BY_USER, IN_TIME, "value")
    scores = score.regression_scores(rows, "value", "predicted", BY_USER)
    return rounded(scores, *_SCORE_COLUMNS)


@query("compare_models", "E4", _score_sql(_MODELS, "model, split"))
def compare_models(t: Tables) -> DataFrame:
    scores = score.regression_scores(_models(t), "value", "predicted", ["model", "split"])
    return rounded(scores, *_SCORE_COLUMNS)


@query(
    "scores_on_anomalies",
    "E5 E6 P13",
    _score_sql(
        f"""WITH f AS (SELECT y, trunc(p) AS p FROM (SELECT value AS y,
            lag(value) OVER ({SQL_ORDER}) AS p FROM events) WHERE y >= 60)""",
        "",
    ),
)
def scores_on_anomalies(t: Tables) -> DataFrame:
    rows = forecast.persistence(series(t), BY_USER, IN_TIME, "value")
    rows = score.truncated(rows, "predicted").filter("value >= 60")
    return rounded(score.regression_scores(rows, "value", "predicted"), *_SCORE_COLUMNS)


@query(
    "truncate_predictions",
    "E6",
    """SELECT event_id, trunc(value - 50)::BIGINT AS value FROM events""",
)
def truncate_predictions(t: Tables) -> DataFrame:
    return score.truncated(t.events.select("event_id", (F.col("value") - 50).alias("value")),
                           "value")


_GUESS = """g AS (SELECT doc_id, toxic, quality, (doc_id * 37 % 100) / 100.0::DOUBLE AS p,
    CASE WHEN doc_id * 37 % 100 > 70 THEN 1 ELSE 0 END AS guess FROM labels)"""


def _guesses(t: Tables) -> DataFrame:
    draw = F.col("doc_id") * 37 % 100
    return t.labels.withColumns(
        {"p": draw / F.lit(100.0), "guess": F.when(draw > 70, 1).otherwise(0)}
    )


@query(
    "label_accuracy",
    "E7",
    f"""WITH {_GUESS} SELECT quality, count(*) AS rows,
        {r("avg((toxic = guess)::INT)")} AS accuracy FROM g GROUP BY quality""",
)
def label_accuracy(t: Tables) -> DataFrame:
    return rounded(score.accuracy(_guesses(t), "toxic", "guess", ["quality"]), "accuracy")


@query(
    "classification_report",
    "E8",
    f"""WITH {_GUESS}, c AS (SELECT unnest([0, 1]) AS class),
    s AS (SELECT class, count(*) FILTER (toxic = class AND guess = class) AS hits,
        count(*) FILTER (guess = class) AS found, count(*) FILTER (toxic = class) AS support
        FROM g, c GROUP BY class)
    SELECT class, {r("CASE WHEN found > 0 THEN hits / found ELSE 0.0::DOUBLE END")} AS precision,
        {r("CASE WHEN support > 0 THEN hits / support ELSE 0.0::DOUBLE END")} AS recall,
        {r("CASE WHEN found + support > 0 THEN 2.0::DOUBLE * hits / (found + support)"
           " ELSE 0.0::DOUBLE END")} AS f1, support FROM s""",
)
def classification_report(t: Tables) -> DataFrame:
    report = score.classification_report(_guesses(t), "toxic", "guess")
    return rounded(report, "precision", "recall", "f1")


_F1 = f"""WITH {_GUESS}, t AS (SELECT unnest(range(10, 51)) / 100.0::DOUBLE AS threshold),
    s AS (SELECT threshold, count(*) FILTER (p > threshold AND toxic = 1) AS tp,
        count(*) FILTER (p > threshold AND toxic <> 1) AS fp,
        count(*) FILTER (p <= threshold AND toxic = 1) AS fn FROM g, t GROUP BY threshold),
    f AS (SELECT threshold, {r("2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0)", 9)} AS f1 FROM s)"""


@query("f1_by_threshold", "E9", f"{_F1} SELECT * FROM f")
def f1_by_threshold(t: Tables) -> DataFrame:
    return rounded(score.f1_by_threshold(_guesses(t), "toxic", "p"), "f1", digits=9)


@query(
    "best_f1_threshold",
    "E9",
    f"{_F1} SELECT threshold, f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1",
)
def best_f1_threshold(t: Tables) -> DataFrame:
    return rounded(score.best_f1_threshold(_guesses(t), "toxic", "p"), "f1", digits=9)


@query(
    "knn_neighbours",
    "J7",
    f"""WITH d AS (SELECT a.vec_id AS test_id, b.vec_id AS train_id, b.label AS train_label,
        list_sum(list_transform(list_zip(a.embedding, b.embedding),
            lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d2
        FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)
    SELECT test_id, rank::INT AS rank, train_id, {r("d2")} AS distance2,
        train_label::BIGINT AS train_label FROM (SELECT *,
        row_number() OVER (PARTITION BY test_id ORDER BY d2, train_id) AS rank FROM d)
    WHERE rank <= 5""",
)
def knn_neighbours(t: Tables) -> DataFrame:
    return rounded(_neighbours(t), "distance2")


def _neighbours(t: Tables) -> DataFrame:
    """Every vector against all others."""
    return joins.nearest_neighbours(
        t.embeddings, t.embeddings, "vec_id", "embedding", "label", 5, leave_one_out=True
    )


@query(
    "knn_class_shares",
    "J7 E7",
    f"""WITH d AS (SELECT a.vec_id, b.label, b.vec_id AS other,
        list_sum(list_transform(list_zip(a.embedding, b.embedding),
            lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d2
        FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
    k AS (SELECT * FROM d
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, other) <= 5)
    SELECT vec_id AS test_id, label::BIGINT AS train_label, {r("count(*) / 5.0::DOUBLE")} AS share
        FROM k GROUP BY 1, 2""",
)
def knn_class_shares(t: Tables) -> DataFrame:
    """The share of each class in the vote of the neighbours."""
    return rounded(joins.class_shares(_neighbours(t)), "share")


@query(
    "knn_accuracy",
    "J7 E7",
    f"""WITH d AS (SELECT a.vec_id, a.label, b.label AS guess, b.vec_id AS other,
        list_sum(list_transform(list_zip(a.embedding, b.embedding),
            lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d2
        FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
    k AS (SELECT * FROM d
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, other) <= 5),
    v AS (SELECT vec_id, label, guess, count(*) AS votes FROM k GROUP BY ALL),
    w AS (SELECT * FROM v
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, guess) = 1)
    SELECT count(*) AS rows, {r("avg((label = guess)::INT)")} AS accuracy FROM w""",
)
def knn_accuracy(t: Tables) -> DataFrame:
    votes = joins.vote(_neighbours(t))
    truth = t.embeddings.select(F.col("vec_id").alias("test_id"), "label")
    return rounded(score.accuracy(votes.join(truth, "test_id"), "label", "predicted"), "accuracy")

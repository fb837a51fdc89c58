"""Queries: baselines and linear forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rounding import rounded
from tidemark.operators import forecast, horizons, resample, scaling
from tidemark.plans.registry import Tables, query, r
from tidemark.plans.windowing import (
    BY_USER,
    IN_TIME,
    SQL_ORDER,
    SQL_SPLIT,
    series,
    split_series,
)



def _out(df: DataFrame) -> DataFrame:
    return rounded(df.select("event_id", "predicted"), "predicted")


@query(
    "persistence_forecast",
    "F1",
    f"SELECT event_id, {r(f'lag(value) OVER ({SQL_ORDER})')} AS predicted FROM events",
)
def persistence_forecast(t: Tables) -> DataFrame:
    return _out(forecast.persistence(series(t), BY_USER, IN_TIME, "value"))


@query(
    "last_value_forecast",
    "F2",
    f"""WITH p AS (SELECT user_id, value, row_number() OVER ({SQL_ORDER}) - 1 AS pos FROM events)
    SELECT a.user_id, a.pos AS origin, (b.pos - a.pos)::INT AS h, b.value AS actual,
        a.value AS predicted FROM p a JOIN p b
        ON a.user_id = b.user_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 6""",
)
def last_value_forecast(t: Tables) -> DataFrame:
    return forecast.last_value(series(t), BY_USER, IN_TIME, "value", 6)


@query(
    "repeat_period_forecast",
    "F3",
    f"SELECT event_id, {r(f'lag(value, 24) OVER ({SQL_ORDER})')} AS predicted FROM events",
)
def repeat_period_forecast(t: Tables) -> DataFrame:
    return _out(forecast.repeat_previous(series(t), BY_USER, IN_TIME, "value", 24))


_LAGGED = f"""WITH {SQL_SPLIT}, l AS (SELECT *, lag(value) OVER
        (PARTITION BY user_id ORDER BY ts, event_id) AS l1 FROM d),
    g AS (SELECT user_id, regr_intercept(value, l1) AS a, regr_slope(value, l1) AS b,
        avg(value - l1) AS drift FROM l WHERE split = 'train' GROUP BY 1)"""


def _ar1(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = split_series(t)
    return rows, forecast.fit_ar1(rows, BY_USER, IN_TIME, "value", where=F.expr("split = 'train'"))


@query(
    "linear_one_step",
    "F4",
    f"""{_LAGGED} SELECT event_id, {r("a + b * l1")} AS predicted FROM l JOIN g USING (user_id)""",
)
def linear_one_step(t: Tables) -> DataFrame:
    rows, model = _ar1(t)
    return _out(forecast.predict_ar1(rows, model, BY_USER, IN_TIME, "value"))


@query(
    "residual_forecast",
    "F7",
    f"""{_LAGGED} SELECT event_id, {r("l1 + drift")} AS predicted
        FROM l JOIN g USING (user_id)""",
)
def residual_forecast(t: Tables) -> DataFrame:
    rows = split_series(t)
    return _out(
        forecast.predict_drift(rows, BY_USER, IN_TIME, "value", where=F.expr("split = 'train'"))
    )


@query(
    "recursive_forecast",
    "F8",
    f"""WITH RECURSIVE m AS ({_LAGGED} SELECT user_id, a, b FROM g),
    o AS (SELECT user_id, arg_max(value, (ts, event_id)) AS x FROM events GROUP BY 1),
    f AS (SELECT user_id, 1 AS h, a + b * x AS v, a, b FROM o JOIN m USING (user_id)
        UNION ALL SELECT user_id, h + 1, a + b * v, a, b FROM f WHERE h < 24)
    SELECT user_id, h, {r("v")} AS predicted FROM f""",
)
def recursive_forecast(t: Tables) -> DataFrame:
    _, model = _ar1(t)
    out = forecast.forecast_ar1(series(t), model, BY_USER, IN_TIME, "value", 24)
    return rounded(out, "predicted")


@query(
    "windowed_scoring",
    "F10 C5",
    f"""WITH q AS (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
    l AS (SELECT user_id, event_id, (value - lo) / (hi - lo) AS s,
        lag((value - lo) / (hi - lo)) OVER ({SQL_ORDER}) AS l1 FROM events JOIN q USING (user_id)),
    g AS (SELECT user_id, regr_intercept(s, l1) AS a, regr_slope(s, l1) AS b FROM l GROUP BY 1),
    w AS (SELECT event_id, user_id, value, min(value) OVER f AS lo, max(value) OVER f AS hi,
        count(*) OVER f AS c FROM events
        WINDOW f AS ({SQL_ORDER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
    SELECT event_id, {r("(a + b * (value - lo) / (hi - lo)) * (hi - lo) + lo")} AS predicted
    FROM w JOIN g USING (user_id) WHERE c = 20""",
)
def windowed_scoring(t: Tables) -> DataFrame:
    rows = series(t)
    stats = scaling.fit(rows, BY_USER, ["value"], "minmax")
    unit = scaling.transform(rows, stats, BY_USER, ["value"])
    model = forecast.fit_ar1(unit, BY_USER, IN_TIME, "value_scaled")
    return _out(forecast.score_windows_ar1(rows, model, BY_USER, IN_TIME, "value", 20))


@query(
    "direct_multi_horizon",
    "F6",
    f"""WITH p AS (SELECT user_id, value, ts, event_id,
        row_number() OVER ({SQL_ORDER}) - 1 AS pos FROM events),
    m AS (SELECT a.user_id, b.pos - a.pos AS h, regr_intercept(b.value, a.value) AS a,
        regr_slope(b.value, a.value) AS b FROM p a JOIN p b
        ON a.user_id = b.user_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 4 GROUP BY ALL),
    o AS (SELECT user_id, arg_max(value, pos) AS x FROM p GROUP BY 1)
    SELECT user_id, h::INT AS h, {r("a + b * x", 5)} AS predicted FROM m JOIN o USING (user_id)""",
)
def direct_multi_horizon(t: Tables) -> DataFrame:
    out = forecast.direct_multi_horizon(series(t), BY_USER, IN_TIME, "value", 1, 4)
    return rounded(out, "predicted", digits=5)


def _two_columns(t: Tables) -> DataFrame:
    """Value and the number in ``props`` of every event."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("k")
    return t.events.select("event_id", "user_id", "ts", "value", k)


@query(
    "two_column_forecast",
    "F6",
    f"""WITH p AS (SELECT user_id, value AS x, regexp_extract(props, '[0-9]+')::DOUBLE AS y,
        row_number() OVER o AS pos, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2,
        lead(y, 1) OVER o AS y1, lead(y, 2) OVER o AS y2
        FROM events WINDOW o AS ({SQL_ORDER})),
    u AS (SELECT user_id, x, y, x2 IS NOT NULL AS used, unnest([
        {{'column': 'value', 'h': 1, 'z': x1}}, {{'column': 'value', 'h': 2, 'z': x2}},
        {{'column': 'k', 'h': 1, 'z': y1}}, {{'column': 'k', 'h': 2, 'z': y2}}], recursive := true)
        FROM p),
    g AS (SELECT user_id, "column", h, count(*) FILTER (used) AS n,
        avg(x) FILTER (used) AS mx, avg(y) FILTER (used) AS my, avg(z) FILTER (used) AS mz,
        var_pop(x) FILTER (used) AS vx, var_pop(y) FILTER (used) AS vy,
        covar_pop(x, y) FILTER (used) AS xy, covar_pop(x, z) FILTER (used) AS xz,
        covar_pop(y, z) FILTER (used) AS yz FROM u GROUP BY ALL),
    e AS (SELECT user_id, arg_max(x, pos) AS x, arg_max(y, pos) AS y FROM p GROUP BY 1)
    SELECT user_id, "column", h::INT AS h, n AS rows, CASE WHEN n >= 3 THEN
        {r("mz + ((xz * vy - yz * xy) * (x - mx) + (yz * vx - xz * xy) * (y - my)) / (vx * vy - xy * xy)", 5)}
        END AS predicted FROM g JOIN e USING (user_id)""",
)
def two_column_forecast(t: Tables) -> DataFrame:
    """Both columns, two steps ahead, from the last value of both."""
    out = horizons.horizon_forecast(
        _two_columns(t), BY_USER, IN_TIME, ["value", "k"], lags=1, horizon=2
    )
    return rounded(out.drop("sse"), "predicted", digits=5)


@query("day_ahead_forecast", "F6 F5")
def day_ahead_forecast(t: Tables) -> DataFrame:
    """Hourly mean and count, 24 hours ahead, from the last 60 hours of both."""
    hours = resample.resample(
        t.events, [], "ts", "hour", {"mean": F.avg("value"), "n": F.count(F.lit(1))}
    )
    return horizons.horizon_forecast(hours, [], ["bucket"], ["mean", "n"], lags=60, horizon=24)


#: Centred products of three features x1..x3 and a target z, and the weights that solve them.
THREE_SUMS = """avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(z) AS mz,
        var_pop(x1) AS a, covar_pop(x1, x2) AS b, covar_pop(x1, x3) AS c, var_pop(x2) AS d,
        covar_pop(x2, x3) AS e, var_pop(x3) AS f, covar_pop(x1, z) AS u, covar_pop(x2, z) AS v,
        covar_pop(x3, z) AS w"""
THREE_WEIGHTS = """a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det,
        (u * (d * f - e * e) - b * (v * f - e * w) + c * (v * e - d * w)) / det AS w1,
        (a * (v * f - w * e) - u * (b * f - e * c) + c * (b * w - v * c)) / det AS w2,
        (a * (d * w - v * e) - b * (b * w - v * c) + u * (b * e - d * c)) / det AS w3"""
THREE_FIT = "mz + w1 * (x1 - m1) + w2 * (x2 - m2) + w3 * (x3 - m3)"


@query(
    "direct_multi_horizon_three_lags",
    "F6 F5",
    f"""WITH p AS (SELECT user_id, value AS x1, lag(value, 1) OVER o AS x2,
        lag(value, 2) OVER o AS x3, row_number() OVER o AS pos FROM events
        WINDOW o AS ({SQL_ORDER})),
    l AS (SELECT a.user_id, b.pos - a.pos AS h, a.x1, a.x2, a.x3, b.x1 AS z FROM p a JOIN p b
        ON a.user_id = b.user_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 6
        WHERE a.x3 IS NOT NULL),
    g AS (SELECT user_id, h, {THREE_SUMS} FROM l GROUP BY 1, 2),
    k AS (SELECT *, {THREE_WEIGHTS} FROM g),
    o AS (SELECT user_id, x1, x2, x3 FROM p
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) = 1)
    SELECT user_id, h::INT AS h, {r(THREE_FIT, 5)} AS predicted FROM k JOIN o USING (user_id)""",
)
def direct_multi_horizon_three_lags(t: Tables) -> DataFrame:
    out = forecast.direct_multi_horizon(series(t), BY_USER, IN_TIME, "value", 3, 6)
    return rounded(out, "predicted", digits=5)


@query(
    "multi_input_step_forecast",
    "F5 F9",
    f"""WITH {SQL_SPLIT}, l AS (SELECT event_id, user_id, split, value, value AS z,
        lag(value, 1) OVER o AS x1, lag(value, 2) OVER o AS x2, lag(value, 3) OVER o AS x3
        FROM d WINDOW o AS ({SQL_ORDER})),
    g AS (SELECT user_id, {THREE_SUMS} FROM l WHERE split = 'train' AND x3 IS NOT NULL GROUP BY 1),
    k AS (SELECT *, {THREE_WEIGHTS} FROM g)
    SELECT event_id, user_id, split, value, {r(THREE_FIT, 5)} AS predicted
        FROM l JOIN k USING (user_id) WHERE x3 IS NOT NULL""",
)
def multi_input_step_forecast(t: Tables) -> DataFrame:
    rows = forecast.lag_table(split_series(t), BY_USER, IN_TIME, "value", 3)
    lags = ["lag_1", "lag_2", "lag_3"]
    model = forecast.least_squares(rows.filter("split = 'train'"), BY_USER, lags, "value")
    out = forecast.predict_linear(rows, model, BY_USER, lags)
    out = out.select("event_id", "user_id", "split", "value", "predicted")
    return rounded(out, "predicted", digits=5)


@query(
    "feature_weights_per_series",
    "F9 F4",
    f"""{_LAGGED} SELECT user_id, {r("a", 5)} AS intercept, {r("b", 5)} AS lag_1 FROM g""",
)
def feature_weights_per_series(t: Tables) -> DataFrame:
    rows = forecast.lag_table(split_series(t), BY_USER, IN_TIME, "value", 1)
    model = forecast.least_squares(rows.filter("split = 'train'"), BY_USER, ["lag_1"], "value")
    out = model.select(
        "user_id",
        F.get("weights", F.lit(0)).alias("intercept"),
        F.get("weights", F.lit(1)).alias("lag_1"),
    )
    return rounded(out, "intercept", "lag_1", digits=5)

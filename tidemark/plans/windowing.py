"""Queries: scaling and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rounding import r as rd
from tidemark.functions.rounding import rounded
from tidemark.operators import ordered, resample, scaling, windows
from tidemark.operators.forecast import persistence
from tidemark.plans.registry import Tables, query, r

BY_USER = ["user_id"]
IN_TIME = ["ts", "event_id"]
SQL_ORDER = "PARTITION BY user_id ORDER BY ts, event_id"
SQL_POS = f"""p AS (SELECT event_id, user_id, ts, value,
    row_number() OVER ({SQL_ORDER}) - 1 AS pos,
    count(*) OVER (PARTITION BY user_id) AS n FROM events)"""
SQL_SPLIT = f"""{SQL_POS}, d AS (SELECT *, CASE WHEN pos < floor(n * 0.8::DOUBLE)
    THEN 'train' ELSE 'test' END AS split FROM p)"""


def series(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "ts", "value")


def split_series(t: Tables) -> DataFrame:
    return ordered.chronological_split(series(t), BY_USER, IN_TIME, {"train": 0.8}, "test")


def _scaled(df: DataFrame, *names: str) -> DataFrame:
    return rounded(df.select("event_id", *names), *names)


@query(
    "minmax_scale",
    "C1",
    f"""WITH m AS (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
    SELECT event_id, {r("2 * (value - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END) - 1")}
        AS value_scaled, {r("value")} AS restored FROM events JOIN m USING (user_id)""",
)
def minmax_scale(t: Tables) -> DataFrame:
    stats = scaling.fit(t.events, BY_USER, ["value"], "minmax", low=-1.0, high=1.0)
    rows = scaling.transform(series(t), stats, BY_USER, ["value"])
    rows = scaling.invert(rows.withColumn("restored", F.col("value_scaled")), {"restored": "value"})
    return _scaled(rows, "value_scaled", "restored")


_IQR = """quantile_cont(value, 0.75) - quantile_cont(value, 0.25)"""


@query(
    "robust_scale",
    "C2",
    f"""WITH m AS (SELECT user_id, quantile_cont(value, 0.5) AS mid, {_IQR} AS iqr
        FROM events GROUP BY 1)
    SELECT event_id, {r("(value - mid) / (CASE WHEN iqr = 0 THEN 1 ELSE iqr END)")}
        AS value_scaled, {r("value")} AS restored FROM events JOIN m USING (user_id)""",
)
def robust_scale(t: Tables) -> DataFrame:
    stats = scaling.fit(t.events, BY_USER, ["value"], "robust")
    rows = scaling.transform(series(t), stats, BY_USER, ["value"])
    rows = scaling.invert(rows.withColumn("restored", F.col("value_scaled")), {"restored": "value"})
    return _scaled(rows, "value_scaled", "restored")


@query(
    "robust_scale_table",
    "C2",
    f"""WITH m AS (SELECT
        quantile_cont(l_quantity, 0.5) AS a, quantile_cont(l_quantity, 0.75)
            - quantile_cont(l_quantity, 0.25) AS b,
        quantile_cont(l_extendedprice, 0.5) AS c, quantile_cont(l_extendedprice, 0.75)
            - quantile_cont(l_extendedprice, 0.25) AS d FROM lineitem)
    SELECT l_orderkey, l_linenumber, {r("(l_quantity - a) / b")} AS l_quantity_scaled,
        {r("(l_extendedprice - c) / d")} AS l_extendedprice_scaled FROM lineitem, m""",
)
def robust_scale_table(t: Tables) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice"]
    rows = t.lineitem.select("l_orderkey", "l_linenumber", *columns)
    out = scaling.transform(rows, scaling.fit(rows, [], columns, "robust"), [], columns)
    names = [f"{c}_scaled" for c in columns]
    return rounded(out.select("l_orderkey", "l_linenumber", *names), *names)


@query(
    "standard_scale_from_train",
    "C3",
    f"""WITH {SQL_SPLIT}, m AS (SELECT user_id, avg(value) AS mean, stddev_samp(value) AS sd
        FROM d WHERE split = 'train' GROUP BY 1)
    SELECT event_id, split, {r("(value - mean) / (CASE WHEN sd = 0 THEN 1 ELSE sd END)")}
        AS value_scaled FROM d JOIN m USING (user_id)""",
)
def standard_scale_from_train(t: Tables) -> DataFrame:
    rows = scaling.scale(split_series(t), BY_USER, ["value"], "standard")
    return rounded(rows.select("event_id", "split", "value_scaled"), "value_scaled")


@query(
    "scale_each_split",
    "C4",
    f"""WITH {SQL_SPLIT}, m AS (SELECT user_id, split, quantile_cont(value, 0.5) AS mid,
        {_IQR} AS iqr, min(value) AS lo, max(value) AS hi FROM d GROUP BY ALL)
    SELECT event_id, split, {r("(value - mid) / (CASE WHEN iqr = 0 THEN 1 ELSE iqr END)")}
        AS robust, {r("(value - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END)")} AS minmax
    FROM d JOIN m USING (user_id, split)""",
)
def scale_each_split(t: Tables) -> DataFrame:
    rows = split_series(t).select("event_id", "user_id", "split", "value")
    rows = scaling.scale(rows, BY_USER, ["value"], "robust", fit_scope="split", suffix="_r")
    rows = scaling.drop_statistics(rows, ["value"])
    rows = scaling.scale(rows, BY_USER, ["value"], "minmax", fit_scope="split", suffix="_m")
    out = rows.select("event_id", "split", F.col("value_r").alias("robust"),
                      F.col("value_m").alias("minmax"))
    return rounded(out, "robust", "minmax")


_LAST = f"OVER ({SQL_ORDER} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"


@query(
    "scale_in_window",
    "C5",
    f"""WITH w AS (SELECT event_id, value, min(value) {_LAST} AS lo, max(value) {_LAST} AS hi,
        list_sort(list(value) {_LAST}) AS items, count(*) {_LAST} AS c FROM events),
    q AS (SELECT *, quantile_cont.a AS a, quantile_cont.b AS b, quantile_cont.m AS m FROM (
        SELECT *, {{'a': items[3] + (items[4] - items[3]) * 0.75::DOUBLE,
            'b': items[9] + (items[10] - items[9]) * 0.25::DOUBLE,
            'm': (items[6] + items[7]) / 2}} AS quantile_cont FROM w))
    SELECT event_id,
        {r("CASE WHEN c = 12 THEN (value - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END) END")}
            AS minmax,
        {r("CASE WHEN c = 12 THEN (value - m) / (CASE WHEN b = a THEN 1 ELSE b - a END) END")}
            AS robust FROM q""",
)
def scale_in_window(t: Tables) -> DataFrame:
    rows = scaling.scale_in_window(series(t), BY_USER, IN_TIME, "value", 12)
    rows = scaling.drop_statistics(rows.withColumnRenamed("value_scaled", "minmax"), ["value"])
    rows = scaling.scale_in_window(rows, BY_USER, IN_TIME, "value", 12, "robust")
    out = rows.select("event_id", "minmax", F.col("value_scaled").alias("robust"))
    return rounded(out, "minmax", "robust")


@query(
    "constant_scale",
    "C6",
    f"SELECT event_id, {r('value / 255')} AS value_unit FROM events",
)
def constant_scale(t: Tables) -> DataFrame:
    return _scaled(scaling.scale_constant(t.events, "value", 255, "value_unit"), "value_unit")


@query(
    "invert_forecast_columns",
    "C7",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
        lag(l_quantity) OVER w AS q, lag(l_extendedprice) OVER w AS e FROM lineitem
        WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber))
    SELECT l_orderkey, l_linenumber, {r("q", 4)} AS l_quantity_forecast,
        {r("e", 4)} AS l_extendedprice_forecast FROM s""",
)
def invert_forecast_columns(t: Tables) -> DataFrame:
    keys, columns = ["l_suppkey"], ["l_quantity", "l_extendedprice"]
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    rows = t.lineitem.select(*keys, *order, *columns)
    rows = scaling.transform(rows, scaling.fit(rows, keys, columns, "robust"), keys, columns)
    for c in columns:
        rows = persistence(rows, keys, order, f"{c}_scaled", out=f"{c}_forecast")
    rows = scaling.invert(rows, {f"{c}_forecast": c for c in columns})
    names = [f"{c}_forecast" for c in columns]
    return rounded(rows.select("l_orderkey", "l_linenumber", *names), *names, digits=4)


def long_windows(df: DataFrame, keys: list[str], **arrays: str) -> DataFrame:
    """One row per window element: which array it is in, its place and its value."""
    parts = [
        df.select(*keys, "start", F.lit(part).alias("part"),
                  F.posexplode(column).alias("place", "value"))
        for part, column in arrays.items()
    ]
    return ordered.concat(*parts)


def _long_sql(source: str, x_from: str, x_to: str, y_from: str, y_to: str) -> str:
    return f"""WITH {SQL_POS}, s AS ({source})
    SELECT s.user_id, s.start, 'x' AS part, (p.pos - s.start - ({x_from}))::INT AS place, p.value
    FROM s JOIN p ON p.user_id = s.user_id
        AND p.pos BETWEEN s.start + ({x_from}) AND s.start + ({x_to})
    UNION ALL SELECT s.user_id, s.start, 'y', (p.pos - s.start - ({y_from}))::INT, p.value
    FROM s JOIN p ON p.user_id = s.user_id
        AND p.pos BETWEEN s.start + ({y_from}) AND s.start + ({y_to})"""


@query(
    "forecast_windows",
    "W1",
    _long_sql(
        """SELECT user_id, pos AS start FROM p
           WHERE pos >= 12 AND pos < n - 3 AND (pos - 12) % 3 = 0""",
        "-12", "-1", "0", "2",
    ),
)
def forecast_windows(t: Tables) -> DataFrame:
    pairs = windows.supervised_windows(series(t), BY_USER, IN_TIME, ["value"], ["value"], 12, 3)
    return long_windows(pairs, BY_USER, x="inputs", y="labels")


@query(
    "forecast_windows_many_targets",
    "W2",
    """WITH p AS (SELECT l_suppkey, l_quantity, l_discount, row_number() OVER w - 1 AS pos,
        count(*) OVER (PARTITION BY l_suppkey) AS n, lag(l_extendedprice, 8) OVER w AS price
        FROM lineitem
        WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber)),
    s AS (SELECT *, pos - (pos - 8) % 4 AS start FROM p WHERE pos >= 8)
    SELECT l_suppkey, start, (pos - start)::INT AS place, l_quantity AS target_quantity,
        l_discount AS target_discount, price AS input_price FROM s WHERE start < n - 4""",
)
def forecast_windows_many_targets(t: Tables) -> DataFrame:
    features = ["l_quantity", "l_extendedprice", "l_discount"]
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    pairs = windows.supervised_windows(
        t.lineitem, ["l_suppkey"], order, features, ["l_quantity", "l_discount"], 8, 4
    )
    target = F.posexplode("labels").alias("place", "label")
    rows = pairs.select("l_suppkey", "start", "inputs", target)
    return rows.select(
        "l_suppkey",
        "start",
        "place",
        F.col("label.l_quantity").alias("target_quantity"),
        F.col("label.l_discount").alias("target_discount"),
        F.get("inputs", F.col("place"))["l_extendedprice"].alias("input_price"),
    )


@query(
    "general_windows",
    "W3",
    _long_sql(
        "SELECT user_id, pos AS start FROM p WHERE pos + 9 <= n", "0", "5", "7", "8"
    ),
)
def general_windows(t: Tables) -> DataFrame:
    pairs = windows.general_windows(
        series(t), BY_USER, IN_TIME, ["value"], ["value"], input_width=6, label_width=2, shift=3
    )
    return long_windows(pairs, BY_USER, x="inputs", y="labels")


@query(
    "lookback_windows",
    "W4",
    f"""WITH {SQL_POS} SELECT s.user_id, s.pos AS start, (p.pos - s.pos)::INT AS place, p.value
    FROM p s JOIN p ON p.user_id = s.user_id AND p.pos BETWEEN s.pos AND s.pos + 11
    WHERE s.pos < s.n - 13""",
)
def lookback_windows(t: Tables) -> DataFrame:
    rows = windows.lookback_windows(series(t), BY_USER, IN_TIME, ["value"], 12)
    return long_windows(rows, BY_USER, x="inputs").drop("part")


@query(
    "short_series",
    "W4",
    """SELECT user_id, count(*) AS rows FROM events GROUP BY 1 HAVING count(*) - 60 - 1 <= 0""",
)
def short_series(t: Tables) -> DataFrame:
    return windows.short_series(t.events, BY_USER, 60)


@query(
    "sliding_windows",
    "W5",
    f"""WITH {SQL_POS} SELECT s.user_id, s.pos AS start, (p.pos - s.pos)::INT AS place, p.value
    FROM p s JOIN p ON p.user_id = s.user_id AND p.pos BETWEEN s.pos AND s.pos + 4
    WHERE s.pos + 5 <= s.n""",
)
def sliding_windows(t: Tables) -> DataFrame:
    rows = windows.sliding_windows(series(t), BY_USER, IN_TIME, "value", 5)
    return long_windows(rows, BY_USER, x="items").drop("part")


@query(
    "last_rows_buffer",
    "W6",
    f"""SELECT event_id, count(*) OVER w AS kept, first_value(value) OVER w AS oldest,
        {r("sum(value) OVER w")} AS total FROM events
        WINDOW w AS ({SQL_ORDER} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
)
def last_rows_buffer(t: Tables) -> DataFrame:
    rows = windows.last_rows(series(t), BY_USER, IN_TIME, "value", 60)
    return rows.select(
        "event_id",
        F.size("recent").cast("long").alias("kept"),
        F.get("recent", F.lit(0)).alias("oldest"),
        rd(F.aggregate("recent", F.lit(0.0), lambda a, v: a + v)).alias("total"),
    )


@query(
    "rolling_mean_and_deviation",
    "W7",
    f"""SELECT event_id, {r("CASE WHEN c = 12 THEN m END")} AS rolling_mean,
        {r("CASE WHEN c = 12 THEN s END")} AS rolling_std FROM (
        SELECT event_id, count(*) {_LAST} AS c, avg(value) {_LAST} AS m,
            stddev_samp(value) {_LAST} AS s FROM events)""",
)
def rolling_mean_and_deviation(t: Tables) -> DataFrame:
    rows = windows.rolling_moments(series(t), BY_USER, IN_TIME, "value", 12)
    return _scaled(rows, "rolling_mean", "rolling_std")


_AROUND = f"OVER ({SQL_ORDER} ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)"
_MAD = """list_aggregate(list_transform(items,
    lambda x: abs(x - list_aggregate(items, 'median'))), 'median')"""


@query(
    "rolling_median_and_mad",
    "W8",
    f"""SELECT event_id, {r("list_aggregate(items, 'median')")} AS median,
        {r(_MAD)} AS mad FROM (SELECT event_id, list(value) {_AROUND} AS items FROM events)""",
)
def rolling_median_and_mad(t: Tables) -> DataFrame:
    rows = windows.rolling_median_mad(series(t), BY_USER, IN_TIME, "value", 10)
    return _scaled(rows, "median", "mad")


def midpoint_sql(q: float, items: str = "items") -> str:
    at = f"((len({items}) - 1) * {q}::DOUBLE)"
    return (
        f"({items}[floor({at})::INT + 1] + {items}[ceil({at})::INT + 1]) / 2"
    )


SQL_AHEAD = f"""f AS (SELECT event_id, user_id, value,
    list_sort(list(value) OVER w) AS items, lead(1, 20) OVER ({SQL_ORDER}) AS more
    FROM events WINDOW w AS ({SQL_ORDER} ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING))"""


@query(
    "rolling_percentiles",
    "W9",
    f"""WITH {SQL_AHEAD} SELECT event_id, {r(midpoint_sql(0.25))} AS p25,
        {r(midpoint_sql(0.5))} AS p50, {r(midpoint_sql(0.99))} AS p99 FROM f""",
)
def rolling_percentiles(t: Tables) -> DataFrame:
    rows = windows.rolling_percentiles(series(t), BY_USER, IN_TIME, "value", 20)
    return _scaled(rows, "p25", "p50", "p99")


@query(
    "step_differences",
    "W10 W11 W12",
    f"""SELECT event_id, {r(f"abs(value - lag(value) OVER ({SQL_ORDER}))")} AS back,
        {r(f"abs(value - lead(value) OVER ({SQL_ORDER}))")} AS ahead,
        {r(f"coalesce(abs(value - lag(value) OVER ({SQL_ORDER})), 0)")} AS back_filled
        FROM events""",
)
def step_differences(t: Tables) -> DataFrame:
    rows = series(t)
    rows = windows.difference(rows, BY_USER, IN_TIME, "value", "back", out="back")
    rows = windows.difference(rows, BY_USER, IN_TIME, "value", "ahead", out="ahead")
    rows = windows.difference(rows, BY_USER, IN_TIME, "value", "back", 0.0, "back_filled")
    return _scaled(rows, "back", "ahead", "back_filled")


@query(
    "next_step_time",
    "W13",
    "SELECT event_id, ts + INTERVAL 3 MINUTE AS next_ts FROM events",
)
def next_step_time(t: Tables) -> DataFrame:
    return windows.next_step_time(t.events.select("event_id", "ts"), "ts").drop("ts")


@query(
    "next_value_pairs",
    "W14",
    f"""SELECT event_id, x, y FROM (SELECT event_id, value AS x,
        lead(value) OVER ({SQL_ORDER}) AS y FROM events) WHERE y IS NOT NULL""",
)
def next_value_pairs(t: Tables) -> DataFrame:
    rows = windows.next_value_pairs(series(t), BY_USER, IN_TIME, "value")
    return rows.select("event_id", "x", "y")


@query(
    "hourly_windows",
    "A1 W1",
    f"""WITH b AS (SELECT user_id, date_trunc('hour', ts) AS hour, avg(value) AS v FROM events
        GROUP BY ALL), p AS (SELECT *, row_number() OVER w - 1 AS pos,
        count(*) OVER (PARTITION BY user_id) AS n,
        lag(v, 1) OVER w AS x1, lag(v, 2) OVER w AS x2, lag(v, 3) OVER w AS x3
        FROM b WINDOW w AS (PARTITION BY user_id ORDER BY hour))
    SELECT user_id, pos AS start, {r("x3")} AS x3, {r("x2")} AS x2, {r("x1")} AS x1,
        {r("v")} AS y FROM p WHERE pos >= 3 AND pos < n - 1""",
)
def hourly_windows(t: Tables) -> DataFrame:
    hours = t.events.groupBy("user_id", resample.bucket("ts", "hour").alias("hour")).agg(
        F.avg("value").alias("v")
    )
    pairs = windows.supervised_windows(hours, BY_USER, ["hour"], ["v"], ["v"], 3, 1)
    cols = [rd(F.get("inputs", F.lit(i))).alias(f"x{3 - i}") for i in range(3)]
    return pairs.select("user_id", "start", *cols, rd(F.get("labels", F.lit(0))).alias("y"))

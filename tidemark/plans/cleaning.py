"""Queries: selection, parsing, repair, imputation, order and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rounding import r as rd
from tidemark.functions.rounding import rounded
from tidemark.operators import clean, ordered, ordering
from tidemark.plans.registry import Tables, query, r

BY_USER = ["user_id"]
IN_TIME = ["ts", "event_id"]
SQL_ORDER = "PARTITION BY user_id ORDER BY ts, event_id"


def with_gaps(t: Tables) -> DataFrame:
    """Events whose errors lost their value: the given table with missing data."""
    return t.events.select(
        "event_id", "user_id", "ts", "event_type", "value"
    ).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))


SQL_GAPS = """gaps AS (SELECT event_id, user_id, ts, event_type,
    CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"""


@query(
    "feature_selection",
    "P1",
    "SELECT user_id, event_type, value FROM events",
)
def feature_selection(t: Tables) -> DataFrame:
    return clean.select_features(t.events, drop=("event_id", "ts", "props"))


@query(
    "timestamp_parse_and_cast",
    "P2",
    """SELECT event_id,
        date_trunc('second', ts) AS slash_time,
        date_trunc('second', ts) AS dotted_time,
        date_trunc('day', ts) AS day_time,
        CAST(CAST(value AS FLOAT) AS DOUBLE) AS value_single FROM events""",
)
def timestamp_parse_and_cast(t: Tables) -> DataFrame:
    text = t.events.select(
        "event_id",
        F.date_format("ts", "yyyy/MM/dd_HH:mm:ss").alias("slash_time"),
        F.date_format("ts", "dd.MM.yyyy HH:mm:ss").alias("dotted_time"),
        F.date_format("ts", "yyyy-MM-dd '00:00'").alias("day_time"),
        F.col("value").cast("float").cast("double").alias("value_single"),
    )
    parsed = clean.parse_timestamp(text, "slash_time", "yyyy/MM/dd_HH:mm:ss")
    parsed = clean.parse_timestamp(parsed, "dotted_time", "dd.MM.yyyy HH:mm:ss")
    return clean.parse_timestamp(parsed, "day_time", "yyyy-MM-dd 00:00")


@query(
    "sentinel_repair",
    "P3",
    """SELECT l_orderkey, l_linenumber,
        CASE WHEN l_discount = 0.1 THEN 0.0 ELSE l_discount END AS l_discount,
        CASE WHEN l_tax = 0.1 THEN 0.0 ELSE l_tax END AS l_tax FROM lineitem""",
)
def sentinel_repair(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    marked = rows.withColumns(
        {c: F.when(F.col(c) == 0.1, -9999.0).otherwise(F.col(c)) for c in ("l_discount", "l_tax")}
    )
    return clean.repair_sentinel(marked, ["l_discount", "l_tax"])


@query(
    "fill_zero",
    "P4",
    f"WITH {SQL_GAPS} SELECT event_id, coalesce(value, 0.0) AS value FROM gaps",
)
def fill_zero(t: Tables) -> DataFrame:
    return clean.fill_constant(with_gaps(t), 0.0).select("event_id", "value")


@query(
    "fill_column_mean",
    "P5",
    f"""WITH {SQL_GAPS} SELECT event_id,
        {r("coalesce(value, (SELECT avg(value) FROM gaps))")} AS value FROM gaps""",
)
def fill_column_mean(t: Tables) -> DataFrame:
    filled = clean.impute(with_gaps(t), {"value": "mean"})
    return filled.select("event_id", rd("value").alias("value"))


@query(
    "fill_column_minimum",
    "P6",
    f"""WITH {SQL_GAPS} SELECT event_id,
        coalesce(value, (SELECT min(value) FROM gaps)) AS value FROM gaps""",
)
def fill_column_minimum(t: Tables) -> DataFrame:
    return clean.impute(with_gaps(t), {"value": "default"}).select("event_id", "value")


@query(
    "fill_custom_value",
    "P7",
    f"WITH {SQL_GAPS} SELECT event_id, coalesce(value, 1.5) AS value FROM gaps",
)
def fill_custom_value(t: Tables) -> DataFrame:
    return clean.fill_constant(with_gaps(t), 1.5, ["value"]).select("event_id", "value")


@query(
    "imputation_plan",
    "P8 U4",
    f"""WITH {SQL_GAPS},
    g AS (SELECT *, CASE WHEN event_type <> 'view' THEN value END AS low,
        CASE WHEN event_type <> 'click' THEN value END AS fixed FROM gaps),
    s AS (SELECT user_id, avg(value) AS m, min(low) AS lo FROM g GROUP BY user_id)
    SELECT event_id, {r("coalesce(g.value, s.m)")} AS value, coalesce(g.low, s.lo) AS low,
        coalesce(g.fixed, -1.0) AS fixed FROM g JOIN s USING (user_id)""",
)
def imputation_plan(t: Tables) -> DataFrame:
    wide = with_gaps(t).withColumns(
        {
            "low": F.when(F.col("event_type") != "view", F.col("value")),
            "fixed": F.when(F.col("event_type") != "click", F.col("value")),
        }
    )
    modes = {"value": "mean", "low": "default", "fixed": "customize"}
    filled = clean.impute(wide, modes, value=-1.0, keys=BY_USER)
    return rounded(filled.select("event_id", "value", "low", "fixed"), "value")


@query(
    "fill_missing_text",
    "P9",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE '_NA_' END AS text FROM documents""",
)
def fill_missing_text(t: Tables) -> DataFrame:
    known = F.when(F.col("lang") == "en", F.col("text"))
    return clean.fill_text(t.documents.select("doc_id", known.alias("text")), ["text"])


@query(
    "drop_infinite_rows",
    "P10",
    f"""WITH {SQL_GAPS} SELECT event_id, value, 1 / (value - 6.55) AS inverse FROM gaps
        WHERE value IS NOT NULL AND value <> 6.55""",
)
def drop_infinite_rows(t: Tables) -> DataFrame:
    gap = F.col("value") - 6.55
    wide = with_gaps(t).withColumn(
        "inverse", F.when(gap == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1), gap))
    )
    kept = clean.drop_non_finite(wide, ["value", "inverse"])
    return kept.select("event_id", "value", "inverse")


@query(
    "null_profile",
    "P11",
    f"""WITH {SQL_GAPS}
    SELECT 'event_id' AS "column", count(*) - count(event_id) AS nulls FROM gaps
    UNION ALL SELECT 'ts', count(*) - count(ts) FROM gaps
    UNION ALL SELECT 'value', count(*) - count(value) FROM gaps""",
)
def null_profile(t: Tables) -> DataFrame:
    return clean.null_profile(with_gaps(t), ["event_id", "ts", "value"])


@query(
    "duplicate_keys",
    "P12",
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
       GROUP BY ALL HAVING count(*) > 1
       UNION ALL SELECT o_custkey, NULL, count(*) FROM orders
       GROUP BY o_custkey HAVING count(*) > 1""",
)
def duplicate_keys(t: Tables) -> DataFrame:
    lines = clean.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])
    buyers = clean.duplicate_keys(t.orders, ["o_custkey"])
    return lines.unionByName(
        buyers.select(
            F.col("o_custkey").alias("l_orderkey"),
            F.lit(None).cast("int").alias("l_linenumber"),
            "n",
        )
    )


@query(
    "level_filter",
    "P13",
    "SELECT event_id, user_id, ts, value FROM events WHERE value >= 60",
)
def level_filter(t: Tables) -> DataFrame:
    return clean.at_least(t.events, "value", 60.0).select("event_id", "user_id", "ts", "value")


@query(
    "position_range",
    "P14",
    f"""SELECT user_id, event_id, value, pos FROM (SELECT *,
        row_number() OVER ({SQL_ORDER}) - 1 AS pos FROM events) WHERE pos BETWEEN 5 AND 34""",
)
def position_range(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "ts", "event_id", "value")
    return clean.position_range(rows, BY_USER, IN_TIME, 5, 34).drop("ts")


@query(
    "every_sixth_row",
    "P15",
    f"""SELECT user_id, event_id, value FROM (SELECT *,
        row_number() OVER ({SQL_ORDER}) - 1 AS pos FROM events) WHERE pos % 6 = 5""",
)
def every_sixth_row(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "ts", "event_id", "value")
    return clean.every_nth(rows, BY_USER, IN_TIME, 6, 5).drop("ts", "pos")


@query(
    "calendar_month_slice",
    "P16",
    """SELECT o_orderkey, o_orderdate, o_totalprice,
        CASE WHEN month(o_orderdate) = 2 THEN 'train' ELSE 'test' END AS split
        FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) IN (2, 3)""",
)
def calendar_month_slice(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    train = clean.calendar_slice(rows, "o_orderdate", "month", "1997-02-01")
    test = clean.calendar_slice(rows, "o_orderdate", "month", "1997-03-01")
    return ordered.concat(
        train.withColumn("split", F.lit("train")), test.withColumn("split", F.lit("test"))
    )


@query(
    "polar_components",
    "P17",
    f"""SELECT event_id, {r("value * cos(radians(value * 7 % 360))")} AS wx,
        {r("value * sin(radians(value * 7 % 360))")} AS wy FROM events""",
)
def polar_components(t: Tables) -> DataFrame:
    wind = t.events.select("event_id", "value", (F.col("value") * 7 % 360).alias("degrees"))
    parts = clean.polar_to_xy(wind, "value", "degrees")
    return rounded(parts.select("event_id", "wx", "wy"), "wx", "wy")


_SECONDS = "(epoch_us(ts) / 1e6)"


@query(
    "cyclic_time_features",
    "P18",
    f"""SELECT event_id,
        {r(f"sin({_SECONDS} * (2 * pi() / 86400))")} AS day_sin,
        {r(f"cos({_SECONDS} * (2 * pi() / 86400))")} AS day_cos,
        {r(f"sin({_SECONDS} * (2 * pi() / (365.2425::DOUBLE * 86400)))")} AS year_sin,
        {r(f"cos({_SECONDS} * (2 * pi() / (365.2425::DOUBLE * 86400)))")} AS year_cos
        FROM events""",
)
def cyclic_time_features(t: Tables) -> DataFrame:
    rows = clean.cyclic_time(t.events.select("event_id", "ts"), "ts").drop("ts")
    return rounded(rows, "day_sin", "day_cos", "year_sin", "year_cos")


@query(
    "calendar_fields",
    "P19",
    """SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day,
        week(ts)::INT AS week, hour(ts)::INT AS hour, minute(ts)::INT AS minute,
        second(ts)::INT AS second FROM events""",
)
def calendar_fields(t: Tables) -> DataFrame:
    return clean.calendar_fields(t.events.select("event_id", "ts"), "ts").drop("ts")


@query(
    "wide_to_long",
    "P20",
    """SELECT l_orderkey, l_linenumber, 'l_quantity' AS feature, l_quantity AS value FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""",
)
def wide_to_long(t: Tables) -> DataFrame:
    return clean.to_long(
        t.lineitem,
        ["l_orderkey", "l_linenumber"],
        ["l_quantity", "l_discount", "l_tax"],
        "feature",
        "value",
    )


@query(
    "label_one_hot",
    "P21",
    """SELECT doc_id, (toxic = 0)::INT AS class_0, (toxic = 1)::INT AS class_1 FROM labels""",
)
def label_one_hot(t: Tables) -> DataFrame:
    return clean.one_hot(t.labels, "toxic", [0, 1], "class_").drop("quality", "toxic")


_EDGES = ", ".join(f"{i / 10}::DOUBLE" for i in range(1, 10))


@query(
    "decile_bins",
    "P22",
    f"""WITH e AS (SELECT quantile_cont(l_extendedprice, [{_EDGES}]) AS price,
        quantile_cont(l_quantity, [{_EDGES}]) AS quantity FROM lineitem)
    SELECT l_orderkey, l_linenumber,
        len(list_filter(e.price, lambda x: x < l_extendedprice))::INT AS l_extendedprice_bin,
        len(list_filter(e.quantity, lambda x: x < l_quantity))::INT AS l_quantity_bin
    FROM lineitem, e""",
)
def decile_bins(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    binned = clean.decile_bins(rows, ["l_extendedprice", "l_quantity"])
    return binned.drop("l_extendedprice", "l_quantity")


@query(
    "series_position",
    "X1",
    f"SELECT event_id, user_id, row_number() OVER ({SQL_ORDER}) - 1 AS pos FROM events",
)
def series_position(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts")
    return ordering.numbered(rows, BY_USER, IN_TIME).drop("ts")


@query(
    "table_position",
    "X1",
    """SELECT l_orderkey, l_linenumber,
        row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS pos
        FROM lineitem""",
)
def table_position(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate")
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    return ordering.numbered(rows, [], order).drop("l_shipdate")


@query(
    "oldest_first",
    "X2 X3",
    "SELECT user_id, ts, event_id, value FROM events ORDER BY user_id, ts, event_id",
)
def oldest_first(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "ts", "event_id", "value")
    return ordered.oldest_first(rows, BY_USER, IN_TIME)


@query(
    "top_event_users",
    "X4",
    "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
)
def top_event_users(t: Tables) -> DataFrame:
    return ordered.top_frequent(t.events, "user_id", 10)


@query(
    "latest_rows",
    "X5",
    "SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 20",
)
def latest_rows(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "ts", "value")
    return ordered.first_rows(rows, [F.desc("ts"), F.desc("event_id")], 20)


@query(
    "chronological_split",
    "X6",
    f"""SELECT event_id, user_id, CASE
        WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train'
        WHEN pos < floor(n * 0.9::DOUBLE) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER ({SQL_ORDER}) - 1 AS pos,
        count(*) OVER (PARTITION BY user_id) AS n FROM events)""",
)
def chronological_split(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts")
    cuts = {"train": 0.7, "val": 0.9}
    return ordered.chronological_split(rows, BY_USER, IN_TIME, cuts, "test").drop("ts")


def split_sql(share: float, id_column: str = "doc_id") -> str:
    """The split of ``ordered.hashed_split`` with seed 2019."""
    draw = f"('0x' || substr(md5({id_column}::VARCHAR || ':2019'), 1, 8))::BIGINT"
    return f"CASE WHEN {draw} < {share}::DOUBLE * 4294967296 THEN 'test' ELSE 'train' END"


@query("hashed_split", "X7", f"SELECT doc_id, lang, {split_sql(0.1)} AS split FROM documents")
def hashed_split(t: Tables) -> DataFrame:
    return ordered.hashed_split(t.documents.select("doc_id", "lang"), "doc_id", 0.1, 2019)


@query(
    "concat_series",
    "X8",
    """SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'view'
    UNION ALL SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'click'""",
)
def concat_series(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", "value", "event_type")
    parts = [rows.filter(F.col("event_type") == kind).drop("event_type") for kind in
             ("view", "click")]
    return ordered.concat(*parts)

"""Queries: time buckets and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rounding import rounded
from tidemark.operators import profile, resample
from tidemark.plans.registry import Tables, query, r


def _filled_sql(unit: str, what: str, fill: str) -> str:
    return f"""WITH b AS (SELECT user_id, date_trunc('{unit}', ts) AS bucket, {what} AS v
        FROM events GROUP BY ALL),
    s AS (SELECT user_id, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 {unit}))
        AS bucket FROM b GROUP BY user_id)
    SELECT s.user_id, s.bucket, {r(fill)} AS value
    FROM s LEFT JOIN b ON b.user_id = s.user_id AND b.bucket = s.bucket"""


@query("hourly_mean", "A1 A13", _filled_sql("hour", "avg(value)", "b.v"))
def hourly_mean(t: Tables) -> DataFrame:
    out = resample.resample(t.events, ["user_id"], "ts", "hour", {"value": F.avg("value")})
    return rounded(out, "value")


@query("hourly_sum", "A1", _filled_sql("hour", "sum(value)", "coalesce(b.v, 0)"))
def hourly_sum(t: Tables) -> DataFrame:
    out = resample.resample(
        t.events, ["user_id"], "ts", "hour", {"value": F.sum("value")}, {"value": 0.0}
    )
    return rounded(out, "value")


def _orders_sql(unit: str) -> str:
    return f"""WITH b AS (SELECT o_orderpriority, date_trunc('{unit}', o_orderdate)::TIMESTAMP
            AS bucket, avg(o_totalprice) AS m, sum(o_totalprice) AS s FROM orders GROUP BY ALL),
    s AS (SELECT o_orderpriority, unnest(generate_series(min(bucket), max(bucket),
        INTERVAL 1 {unit})) AS bucket FROM b GROUP BY o_orderpriority)
    SELECT s.o_orderpriority, s.bucket, {r("b.m", 7)} AS mean_price,
        {r("coalesce(b.s, 0)", 2)} AS total FROM s LEFT JOIN b
        ON b.o_orderpriority = s.o_orderpriority AND b.bucket = s.bucket"""


def _orders(t: Tables, unit: str) -> DataFrame:
    aggs = {"mean_price": F.avg("o_totalprice"), "total": F.sum("o_totalprice")}
    out = resample.resample(
        t.orders, ["o_orderpriority"], "o_orderdate", unit, aggs, {"total": 0.0}
    )
    return rounded(rounded(out, "mean_price", digits=7), "total", digits=2)


@query("monthly_orders", "A1", _orders_sql("month"))
def monthly_orders(t: Tables) -> DataFrame:
    return _orders(t, "month")


@query("yearly_orders", "A1", _orders_sql("year"))
def yearly_orders(t: Tables) -> DataFrame:
    return _orders(t, "year")


_W30 = """time_bucket(INTERVAL 30 DAYS, o_orderdate, TIMESTAMP '1970-01-01')"""


@query(
    "thirty_day_totals",
    "A2 A4 U3",
    f"""SELECT {_W30} AS start, {_W30} + INTERVAL 30 DAYS AS "end", count(*) AS n,
        {r("sum(o_totalprice)", 2)} AS total FROM orders GROUP BY ALL""",
)
def thirty_day_totals(t: Tables) -> DataFrame:
    aggs = {"n": F.expr("count('Transaction ID')"), "total": F.sum("o_totalprice")}
    return rounded(resample.tumbling(t.orders, [], "o_orderdate", "30 days", aggs), "total",
                   digits=2)


@query(
    "thirty_day_distinct_prices",
    "A3 A4 U1",
    f"""WITH w AS (SELECT {_W30} AS start, round(o_totalprice, -3) AS price FROM orders),
    n AS (SELECT start, count(*) AS rows FROM w GROUP BY 1),
    d AS (SELECT start, avg(price) AS mean, quantile_cont(price, 0.5) AS median
        FROM (SELECT DISTINCT start, price FROM w) GROUP BY 1)
    SELECT n.start, n.start + INTERVAL 30 DAYS AS "end", n.rows, {r("mean", 3)} AS mean,
        {r("median", 3)} AS median FROM n JOIN d USING (start)""",
)
def thirty_day_distinct_prices(t: Tables) -> DataFrame:
    sales = t.orders.select("o_orderdate", F.round("o_totalprice", -3).alias("price"))
    out = resample.tumbling_center(sales, [], "o_orderdate", "price", "30 days")
    return rounded(out, "mean", "median", digits=3)


@query(
    "thirty_day_all_prices",
    "A3",
    f"""SELECT o_orderpriority, {_W30} AS start, {_W30} + INTERVAL 30 DAYS AS "end",
        count(*) AS rows, {r("avg(o_totalprice)", 7)} AS mean,
        {r("quantile_cont(o_totalprice, 0.5)", 7)} AS median FROM orders GROUP BY ALL""",
)
def thirty_day_all_prices(t: Tables) -> DataFrame:
    out = resample.tumbling_center(
        t.orders, ["o_orderpriority"], "o_orderdate", "o_totalprice", "30 days", distinct=False
    )
    return rounded(out, "mean", "median", digits=7)


def _describe_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count({column}) AS count,
        {r(f"avg({column})", 4)} AS mean, {r(f"stddev_samp({column})", 4)} AS std,
        min({column}) AS min, max({column}) AS max,
        {r(f"quantile_cont({column}, 0.25)", 4)} AS q25,
        {r(f"quantile_cont({column}, 0.5)", 4)} AS q50,
        {r(f"quantile_cont({column}, 0.75)", 4)} AS q75 FROM lineitem"""


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_columns", "A5", " UNION ALL ".join(_describe_sql(c) for c in _NUMERIC))
def describe_columns(t: Tables) -> DataFrame:
    out = profile.describe(t.lineitem, _NUMERIC)
    return rounded(out, "mean", "std", "q25", "q50", "q75", digits=4)


@query(
    "label_counts",
    "A6",
    "SELECT toxic, count(*) AS n FROM labels GROUP BY toxic",
)
def label_counts(t: Tables) -> DataFrame:
    return profile.value_counts(t.labels, "toxic")


@query(
    "toxic_rate",
    "A6",
    f"""SELECT quality, count(*) AS rows,
        {r("avg(CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0 END) * 100")} AS percent
        FROM labels GROUP BY quality""",
)
def toxic_rate(t: Tables) -> DataFrame:
    return rounded(profile.positive_rate(t.labels, "toxic", ["quality"]), "percent")


@query("distinct_event_types", "A7", "SELECT DISTINCT event_type FROM events")
def distinct_event_types(t: Tables) -> DataFrame:
    return profile.distinct_values(t.events, "event_type")


_RANK = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE)"
_SPEARMAN = ["l_quantity", "l_extendedprice", "l_discount"]


def _pairs_sql(columns: list[str], source: str) -> str:
    ranks = ", ".join(f"{_RANK.format(c=c)} AS r_{c}" for c in columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    union = " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, {r(f'corr(r_{a}, r_{b})')} AS rho FROM k"
        for a, b in pairs
    )
    return f"WITH s AS ({source}), k AS (SELECT {ranks} FROM s) {union}"


@query(
    "spearman_matrix",
    "A8",
    _pairs_sql(_SPEARMAN, "SELECT l_quantity, l_extendedprice, l_discount FROM lineitem"),
)
def spearman_matrix(t: Tables) -> DataFrame:
    return rounded(profile.spearman(t.lineitem, _SPEARMAN), "rho")


@query(
    "spearman_daily",
    "A8",
    _pairs_sql(
        _SPEARMAN,
        """SELECT date_trunc('day', l_shipdate) AS day,
           round(avg(l_quantity), 9) AS l_quantity,
           round(avg(l_extendedprice), 9) AS l_extendedprice,
           round(avg(l_discount), 9) AS l_discount FROM lineitem GROUP BY 1""",
    ),
)
def spearman_daily(t: Tables) -> DataFrame:
    means = {c: F.round(F.avg(c), 9) for c in _SPEARMAN}
    daily = resample.resample(t.lineitem, [], "l_shipdate", "day", means)
    return rounded(profile.spearman(daily, _SPEARMAN), "rho")


_BOX_BY = "event_type"


@query(
    "box_plot_statistics",
    "A9",
    f"""WITH q AS (SELECT {_BOX_BY}, quantile_cont(value, 0.25) AS q1,
        quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
        FROM events GROUP BY 1),
    f AS (SELECT q.*, value, value BETWEEN q1 - (q3 - q1) * 1.5::DOUBLE
        AND q3 + (q3 - q1) * 1.5::DOUBLE AS inside FROM events JOIN q USING ({_BOX_BY}))
    SELECT {_BOX_BY}, {r("any_value(q1)")} AS q1, {r("any_value(median)")} AS median,
        {r("any_value(q3)")} AS q3, {r("avg(value)")} AS mean,
        min(CASE WHEN inside THEN value END) AS whisker_low,
        max(CASE WHEN inside THEN value END) AS whisker_high,
        count(*) FILTER (NOT inside) AS fliers FROM f GROUP BY 1""",
)
def box_plot_statistics(t: Tables) -> DataFrame:
    out = profile.box_stats(t.events, "value", [_BOX_BY], whisker=1.5)
    return rounded(out, "q1", "median", "q3", "mean")


@query(
    "box_plot_fliers",
    "A9",
    """WITH q AS (SELECT user_id, quantile_cont(value, 0.25) AS q1,
        quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
    SELECT event_id, user_id, value FROM events JOIN q USING (user_id)
    WHERE NOT value BETWEEN q1 - (q3 - q1) * 1.5::DOUBLE AND q3 + (q3 - q1) * 1.5::DOUBLE""",
)
def box_plot_fliers(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "value")
    return profile.fliers(rows, "value", ["user_id"], whisker=1.5)


@query(
    "histogram_two_columns",
    "A10",
    """WITH e AS (SELECT min(l_extendedprice) AS x0, max(l_extendedprice) AS x1,
        min(l_quantity) AS y0, max(l_quantity) AS y1 FROM lineitem)
    SELECT least(floor((l_extendedprice - x0) / (x1 - x0) * 50), 49)::BIGINT AS bx,
        least(floor((l_quantity - y0) / (y1 - y0) * 50), 49)::BIGINT AS "by", count(*) AS n
    FROM lineitem, e GROUP BY ALL""",
)
def histogram_two_columns(t: Tables) -> DataFrame:
    return profile.histogram_2d(t.lineitem, "l_extendedprice", "l_quantity", 50)


@query(
    "value_density",
    "A11",
    f"""WITH s AS (SELECT event_type, count(*) AS n, stddev_samp(value) AS sd,
        min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
    b AS (SELECT event_type, least(floor((value - lo) / (hi - lo) * 64), 63) AS slot,
        count(*) AS m FROM events JOIN s USING (event_type) GROUP BY ALL),
    g AS (SELECT b.m, s.*, lo + (slot + 0.5::DOUBLE) * (hi - lo) / 64 AS centre,
        sd * pow(n, -0.2::DOUBLE) AS h, unnest(range(50)) AS point
        FROM b JOIN s USING (event_type)),
    z AS (SELECT *, lo - (hi - lo) / 2 + point * ((hi - lo) * 2 / 49) AS x FROM g)
    SELECT event_type, point::INT AS point, {r("any_value(x)")} AS x,
        {r("sum(m * exp(-0.5::DOUBLE * ((x - centre) / h) * ((x - centre) / h))"
           " / (h * n * sqrt(2 * pi())))", 9)} AS density
    FROM z GROUP BY ALL""",
)
def value_density(t: Tables) -> DataFrame:
    out = profile.density(t.events, "value", ["event_type"], points=50, bins=64)
    return rounded(rounded(out, "x"), "density", digits=9)


@query(
    "count_by_remainder",
    "A12 A13",
    "SELECT l_partkey % 10 AS remainder, count(*) AS n FROM lineitem GROUP BY 1",
)
def count_by_remainder(t: Tables) -> DataFrame:
    return profile.count_by_remainder(t.lineitem, "l_partkey")


@query(
    "mean_series_per_class",
    "A14",
    f"""WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS v,
        generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
    SELECT label, pos::INT AS pos, {r("avg(v)")} AS mean FROM p GROUP BY ALL""",
)
def mean_series_per_class(t: Tables) -> DataFrame:
    return rounded(profile.mean_series(t.embeddings, "label", "embedding"), "mean")

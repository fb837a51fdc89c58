"""Plans that must stay as they are: pruned scans, pushed filters, few shuffles."""

import re

import pytest

from tidemark import plans
from tidemark.operators import anomaly, clean, resample
from tidemark.plans.registry import Tables, run

plans.load()
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, FOLDER)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hampel_shuffles_once(t):
    plan = physical(anomaly.hampel(t.events, ["user_id"], ["ts", "event_id"], "value", 10).select(
        "event_id", "is_outlier"
    ))
    assert plan.count("Exchange") == 1 and plan.count("Window [") == 1
    columns = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert {c.split(":")[0] for c in columns.split(",")} == {"event_id", "ts", "user_id", "value"}


def test_calendar_slice_is_pushed_down(t):
    plan = physical(clean.calendar_slice(t.orders, "o_orderdate", "month", "1997-02-01").select(
        "o_totalprice"
    ))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "o_custkey" not in plan


def test_month_folders_are_pruned(spark):
    plan = physical(run("month_folder_slice", spark, FOLDER))
    assert re.search(r"PartitionFilters: \[.*month.*1998-03", plan)


def test_resample_needs_no_spine_join(t):
    from pyspark.sql import functions as F

    plan = physical(resample.resample(t.events, ["user_id"], "ts", "hour", {"m": F.avg("value")}))
    assert "Join" not in plan and plan.count("FileScan") == 1
    assert "partial_avg" in plan


def test_global_fill_is_a_subquery(t):
    plan = physical(clean.impute(t.events.select("event_id", "value"), {"value": "mean"}))
    assert "Subquery" in plan and "Join" not in plan


def test_filter_on_flags_does_not_multiply_the_work(t):
    """The statistics of a window are bound once, also under a filter."""
    rows = anomaly.hampel(t.events, ["user_id"], ["ts", "event_id"], "value", 10)
    plan = physical(rows.filter("is_outlier").select("event_id"))
    assert plan.count("sort_array(") <= 8

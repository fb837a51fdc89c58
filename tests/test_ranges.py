from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranges, resample


@pytest.mark.parametrize("spread", [False, True])
def test_ranges(spark, monkeypatch, spread):
    monkeypatch.setattr(ranges, "BITS", 2)  # cells of 4: three levels reach 64
    sizes = [("a", 0), ("b", 1), ("c", 3), ("d", 4), ("e", 5), ("f", 16), ("g", 17), ("h", 64), ("i", None), ("j", -2)]
    df = spark.createDataFrame(sizes, "k string, n long")
    got: dict = {}
    for r in ranges.with_range(df, F.col("n"), "i", spread).collect():
        got.setdefault(r.k, []).append(r.i)
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(n)) for k, n in sizes if n and n > 0}
    assert ranges.with_range(df, F.col("n"), "i", spread).columns == ["k", "n", "i"]


def test_a_gap_of_54_years_in_minutes(spark):
    rows = [("a", dt.datetime(1970, 1, 1), 1.0), ("a", dt.datetime(2024, 1, 1), 2.0), ("b", dt.datetime(2000, 1, 1), 3.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    out = resample.resample(df, ["k"], "ts", "minute", {"v": F.sum("v")}, {"v": 0.0})
    last = dt.datetime(2024, 1, 1)
    row = out.agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.countDistinct("bucket").alias("d"), F.max("bucket").alias("b")).first()
    minutes = int((last - dt.datetime(1970, 1, 1)).total_seconds()) // 60 + 1
    assert (row.n, row.d, row.v, row.b) == (minutes + 1, minutes, 6.0, last)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Generate explode", plan)) == 3


@pytest.mark.parametrize("unit,n", [("month", 27), ("year", 3), ("day", 762), ("hour", 761 * 24 - 22)])
def test_calendar_units(spark, unit, n):
    rows = [(dt.datetime(2020, 1, 31, 23, 5), 1.0), (dt.datetime(2022, 3, 2, 0, 1), 2.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    got = [r.bucket for r in resample.resample(df, [], "ts", unit, {"v": F.sum("v")}).orderBy("bucket").collect()]
    assert len(got) == len(set(got)) == n

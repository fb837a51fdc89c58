from __future__ import annotations

import datetime as dt

import pytest

from tidemark.session import get_spark

START = dt.datetime(2021, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["whole", "chunked"])
def plan(request, spark):
    """Both plans of the ordered operators: series in one task, and series in chunks."""
    if request.param == "chunked":
        spark.conf.set("tidemark.rowsPerTask", "7")
    yield request.param
    spark.conf.unset("tidemark.rowsPerTask")


def minute(i: int) -> dt.datetime:
    return START + dt.timedelta(minutes=3 * i)


def lcg(n: int, seed: int = 1) -> list[float]:
    """Repeatable numbers with two decimals."""
    out, x = [], seed
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append((x >> 8) % 10000 / 100)
    return out


@pytest.fixture(scope="session")
def hot(spark):
    """Three series: one holds most rows, one is short, one has no key; times tie."""
    rows = []
    for host, n, seed in (("a", 61, 1), ("b", 9, 2), (None, 20, 3)):
        for i, v in enumerate(lcg(n, seed)):
            rows.append((host, minute(i // 2), i, v))
    schema = "host string, ts timestamp_ntz, id long, value double"
    return spark.createDataFrame(rows[::-1], schema)


def by_series(df, *columns):
    """host -> list of tuples in (ts, id) order."""
    out: dict = {}
    for row in df.collect():
        out.setdefault(row["host"], []).append(row)
    return {
        host: [tuple(r[c] for c in columns) for r in sorted(rows, key=lambda r: r["id"])]
        for host, rows in out.items()
    }


def values(df):
    return {host: [v for (v,) in rows] for host, rows in by_series(df, "value").items()}

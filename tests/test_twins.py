"""Every registered query against its SQL twin, and what its plan may not hold."""

import pytest

import __spark_entry__ as entry_points
from tidemark.plans.registry import QUERIES
from tools.check_twins import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = list(entry_points.queries())
TWINS = entry_points.oracle_sql()

INVENTORY = {
    "S": 12, "P": 22, "X": 8, "A": 14, "J": 7, "C": 7, "W": 14, "N": 10, "F": 18, "E": 9,
    "T": 15, "R": 10, "U": 5,
}
# A socket needs a server with an open port; tests/test_streaming.py builds the reader.
WITHOUT_QUERY = {"S6"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry_points.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name in TWINS:
        assert compare(con, name, TWINS[name], df).startswith("ok")
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_inventory_is_covered():
    ids = {i for q in QUERIES.values() for i in q.covers}
    want = {f"{letter}{i}" for letter, n in INVENTORY.items() for i in range(1, n + 1)}
    assert want - ids == WITHOUT_QUERY
    assert ids <= want

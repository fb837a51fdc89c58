from __future__ import annotations

import numpy as np
import pytest

from tests.conftest import lcg, minute
from tidemark.operators import horizons


def table(spark, sizes, seed=1, level=0.0):
    rows = []
    for k, (host, n) in enumerate(sizes.items()):
        a, b = lcg(n, seed + k), lcg(n, seed + 50 + k)
        for i in range(n):
            x = a[i] + (0.7 * a[i - 1] if i else 0) + level
            rows.append((host, minute(i // 2), i, x, b[i] + 0.3 * x, "other"))
    schema = "host string, ts timestamp_ntz, id long, x double, y double, column string"
    return rows, spark.createDataFrame(rows[::-1], schema)


def expected(rows, host, lags, horizon):
    v = np.array([(x, y) for h, _, _, x, y, _ in rows if h == host])
    past = [np.concatenate([[1], *[v[t - lags + 1 : t + 1, c][::-1] for c in range(2)]]) for t in range(lags - 1, len(v) - horizon)]
    out = {}
    newest = np.concatenate([[1], *[v[-lags:, c][::-1] for c in range(2)]])
    for c, name in enumerate(("x", "y")):
        for h in range(1, horizon + 1):
            y = [v[t + h, c] for t in range(lags - 1, len(v) - horizon)]
            w, *_ = np.linalg.lstsq(np.array(past), np.array(y), rcond=None)
            out[name, h] = (float(newest @ w), float(((np.array(past) @ w - y) ** 2).sum()), len(y))
    return out


@pytest.mark.parametrize("level", [0.0, 1e6])
def test_equals_least_squares(spark, plan, level):
    sizes = {"a": 90, "b": 31, None: 40}
    rows, df = table(spark, sizes, level=level)
    got = horizons.horizon_forecast(df, ["host"], ["ts", "id"], ["x", "y"], 3, 4)
    assert got.columns == ["host", "column", "h", "predicted", "rows", "sse"]
    got = got.collect()
    assert len(got) == 3 * 2 * 4
    for host in sizes:
        want = expected(rows, host, 3, 4)
        for r in (r for r in got if r.host == host):
            predicted, sse, n = want[r.column, r.h]
            assert r.rows == n
            assert r.predicted == pytest.approx(predicted, rel=1e-6, abs=1e-6)
            assert r.sse == pytest.approx(sse, rel=1e-5, abs=1e-6)


def test_many_lags_and_steps(spark):
    rows, df = table(spark, {"a": 900})
    got = horizons.horizon_forecast(df, ["host"], ["ts", "id"], ["x", "y"], 60, 24).collect()
    want = expected(rows, "a", 60, 24)
    assert len(got) == 48
    for r in got:
        assert r.predicted == pytest.approx(want[r.column, r.h][0], rel=1e-6)


def test_short_singular_and_gappy_series(spark, plan):
    rows = [("short", minute(i), i, float(i), 1.0) for i in range(2)]
    rows += [("flat", minute(i), i, 5.0, 5.0) for i in range(30)]
    rows += [("gap", minute(i), i, None if i == 10 else v, v * v) for i, v in enumerate(lcg(30))]
    rows += [("end", minute(i), i, None if i == 29 else v, v * v) for i, v in enumerate(lcg(30))]
    df = spark.createDataFrame(rows, "host string, ts timestamp_ntz, id long, x double, y double")
    got = horizons.horizon_forecast(df, ["host"], ["ts", "id"], ["x", "y"], 2, 1).collect()
    by_host = {h: [r for r in got if r.host == h] for h in ("short", "flat", "gap", "end")}
    assert all(len(v) == 2 for v in by_host.values())
    assert all(r.predicted is None and r.rows == 0 for r in by_host["short"])
    assert all(r.predicted is None and r.sse is None for r in by_host["flat"])
    assert all(r.predicted is not None and r.rows == 25 for r in by_host["gap"])
    assert all(r.predicted is None and r.sse is not None for r in by_host["end"])


def test_no_keys_and_empty(spark):
    _, df = table(spark, {"a": 40})
    assert len(horizons.horizon_forecast(df, [], ["ts", "id"], ["x"], 2, 3).collect()) == 3
    assert horizons.horizon_forecast(df.limit(0), ["host"], ["ts", "id"], ["x"], 2, 3).collect() == []
    with pytest.raises(ValueError):
        horizons.horizon_forecast(df, ["host"], ["ts", "id"], [], 2, 3)

import math

import numpy as np
import pytest

from tests.conftest import by_series, values
from tidemark.operators import windows

KEYS, ORDER = ["host"], ["ts", "id"]


def starts(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r["host"], {})[r["start"]] = tuple(r[c] for c in columns)
    return out


@pytest.mark.parametrize("x,y", [(5, 3), (1, 1), (8, 1)])
def test_supervised_windows(hot, plan, x, y):
    found = starts(
        windows.supervised_windows(hot, KEYS, ORDER, ["value"], ["value"], x, y),
        "inputs", "labels",
    )
    for host, v in values(hot).items():
        want = {i: (v[i - x : i], v[i : i + y]) for i in range(x, len(v) - y, y)}
        assert found.get(host, {}) == want
        assert len(want) == max(0, math.ceil((len(v) - y - x) / y))


def test_several_targets(hot):
    rows = windows.supervised_windows(hot, KEYS, ORDER, ["value", "id"], ["id"], 2, 2).collect()
    for r in rows:
        assert [p.id for p in r.inputs] == [r.start - 2, r.start - 1]
        assert r.labels == [r.start, r.start + 1]


def test_general_windows(hot, plan):
    found = starts(
        windows.general_windows(hot, KEYS, ORDER, ["value"], ["value"], 6, 2, 3),
        "inputs", "labels",
    )
    for host, v in values(hot).items():
        want = {i: (v[i : i + 6], v[i + 7 : i + 9]) for i in range(len(v) - 9 + 1)}
        assert found.get(host, {}) == want


def test_lookback(hot, plan):
    found = starts(windows.lookback_windows(hot, KEYS, ORDER, ["value"], 12), "inputs")
    for host, v in values(hot).items():
        assert found.get(host, {}) == {i: (v[i : i + 12],) for i in range(len(v) - 12 - 1)}
    short = [r.host for r in windows.short_series(hot, KEYS, 12).collect()]
    assert short == ["b"]


def test_sliding_and_buffer(hot, plan):
    found = starts(windows.sliding_windows(hot, KEYS, ORDER, "value", 4), "items")
    buffers = by_series(windows.last_rows(hot, KEYS, ORDER, "value", 4), "recent")
    for host, v in values(hot).items():
        assert found[host] == {i: (v[i : i + 4],) for i in range(len(v) - 3)}
        assert [b for (b,) in buffers[host]] == [v[max(0, i - 3) : i + 1] for i in range(len(v))]


def test_sliding_window_needs_a_row(hot):
    with pytest.raises(ValueError):
        windows.sliding_windows(hot, KEYS, ORDER, "value", 0)


def test_rolling_moments(hot, plan):
    found = by_series(windows.rolling_moments(hot, KEYS, ORDER, "value", 12),
                      "rolling_mean", "rolling_std")
    for host, v in values(hot).items():
        for i, (mean, std) in enumerate(found[host]):
            if i < 11:
                assert mean is None and std is None
            else:
                part = v[i - 11 : i + 1]
                assert np.isclose(mean, np.mean(part)) and np.isclose(std, np.std(part, ddof=1))


@pytest.mark.parametrize("short_tail", [True, False])
def test_rolling_percentiles(hot, plan, short_tail):
    rows = windows.rolling_percentiles(hot, KEYS, ORDER, "value", 20, short_tail=short_tail)
    found = by_series(rows, "id", "p25", "p50", "p99")
    for host, v in values(hot).items():
        last = len(v) if short_tail else max(0, len(v) - 20)
        assert [r[0] for r in found.get(host, [])] == list(range(last))
        for i, *ps in found.get(host, []):
            want = np.percentile(v[i : i + 20], (25, 50, 99), method="midpoint")
            assert np.allclose(ps, want)


def test_differences(hot, plan):
    back = by_series(windows.difference(hot, KEYS, ORDER, "value"), "diff")
    ahead = by_series(windows.difference(hot, KEYS, ORDER, "value", "ahead", 0.0), "diff")
    for host, v in values(hot).items():
        gaps = [abs(a - b) for a, b in zip(v, v[1:])]
        assert [d for (d,) in back[host]] == [None, *gaps]
        assert [d for (d,) in ahead[host]] == [*gaps, 0.0]


def test_next_pairs(hot, plan):
    found = by_series(windows.next_value_pairs(hot, KEYS, ORDER, "value"), "x", "y")
    for host, v in values(hot).items():
        assert found[host] == list(zip(v, v[1:]))

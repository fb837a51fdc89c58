"""Spectrum of a series and the unit-root test."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.forecast import comoments, solve_centred, symmetric
from tidemark.operators.ordering import (
    Frames,
    Order,
    attach,
    largest_group,
    match,
    numbered,
)
from tidemark.operators.ranges import with_range
from tidemark.session import rows_per_task

DAYS_PER_YEAR = 365.2425

# Response surface of the test statistic with a constant term, by sample size.
CRITICAL_VALUES = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}
# P-value approximation (constant term), limits and polynomials.
P_MAX, P_MIN, P_STAR = 2.74, -18.83, -1.61
P_SMALL = (2.1659, 1.4412, 0.038269)
P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def dft_bins(
    df: DataFrame, keys: Sequence[str], order: Order, value: str, bins: Sequence[int]
) -> DataFrame:
    """Fourier magnitude of chosen frequency bins, as sums that combine map-side."""
    rows = numbered(df.filter(F.col(value).isNotNull()), keys, order, "_pos", "_n")
    turn = F.col("_pos") * F.lit(2 * math.pi) / F.col("_n")
    sums = []
    for k in bins:
        sums += [
            F.sum(F.col(value) * F.cos(turn * k)).alias(f"_c{k}"),
            F.sum(F.col(value) * F.sin(turn * k)).alias(f"_s{k}"),
        ]
    table = rows.groupBy(*keys).agg(F.first("_n").alias("n"), *sums)
    found = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                F.sqrt(F.col(f"_c{k}") ** 2 + F.col(f"_s{k}") ** 2).alias("magnitude"),
            )
            for k in bins
        ]
    )
    return table.select(*keys, "n", F.explode(found).alias("b")).select(*keys, "n", "b.*")


def per_year(df: DataFrame, step_hours: float, k: str = "k", n: str = "n") -> DataFrame:
    """Add the frequency per year of bin k of a series of n rows ``step_hours`` apart."""
    years = F.col(n) * step_hours / (24 * DAYS_PER_YEAR)
    return df.withColumn("per_year", F.col(k) / years)


def _key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keys).schema)


def _by_blocks(df: DataFrame, keys: Sequence[str], inverse: bool = False) -> DataFrame:
    """Fourier transform of complex rows (pos, re, im, n1, n2), n1 * n2 long, in two steps.

    Rows pos = n2 * j1 + j2 are transformed over j1 for each j2, turned, and then
    transformed over j2 for each k1. No group holds more than max(n1, n2) rows.
    """
    keys = list(keys)
    sign = 1j if inverse else -1j
    head = _key_schema(df, keys) + "n1 long, n2 long, "

    def transform(x: np.ndarray) -> np.ndarray:
        return np.fft.ifft(x) * len(x) if inverse else np.fft.fft(x)

    def columns(part: pd.DataFrame, order: str) -> tuple[pd.DataFrame, np.ndarray, int, int]:
        part = part.sort_values(order)
        x = part["re"].to_numpy() + 1j * part["im"].to_numpy()
        return part, x, int(part["n1"].iloc[0]), int(part["n2"].iloc[0])

    def with_keys(part: pd.DataFrame, data: dict) -> pd.DataFrame:
        out = pd.DataFrame(data)
        for name in reversed([*keys, "n1", "n2"]):
            out.insert(0, name, [part[name].iloc[0]] * len(out))
        return out

    def over_first(part: pd.DataFrame) -> pd.DataFrame:
        part, x, n1, n2 = columns(part, "pos")
        j2, k1 = int(part["j2"].iloc[0]), np.arange(n1)
        y = transform(x) * np.exp(sign * 2 * np.pi * ((j2 * k1) % (n1 * n2)) / (n1 * n2))
        return with_keys(part, {"k1": k1, "j2": j2, "re": y.real, "im": y.imag})

    def over_second(part: pd.DataFrame) -> pd.DataFrame:
        part, x, n1, n2 = columns(part, "j2")
        y = transform(x)
        pos = int(part["k1"].iloc[0]) + n1 * np.arange(n2)
        return with_keys(part, {"pos": pos, "re": y.real, "im": y.imag})

    first = (
        df.withColumn("j2", F.col("pos") % F.col("n2"))
        .groupBy(*keys, "j2")
        .applyInPandas(over_first, head + "k1 long, j2 long, re double, im double")
    )
    return first.groupBy(*keys, "k1").applyInPandas(
        over_second, head + "pos long, re double, im double"
    )


def _long_spectrum(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spectrum of series too long for one task: rows (keys, pos, n, x).

    A chirp turns the transform of any length n into transforms of a power of two
    m >= 2n - 1, which ``_by_blocks`` splits evenly.
    """
    keys = list(keys)
    m_exp = F.ceil(F.log2(F.col("n") * 2 - 1)).cast("int")
    sized = rows.withColumn("e", m_exp).withColumns(
        {
            "n1": F.pow(F.lit(2.0), F.floor(F.col("e") / 2)).cast("long"),
            "n2": F.pow(F.lit(2.0), F.col("e") - F.floor(F.col("e") / 2)).cast("long"),
        }
    )

    def chirp(at):
        # at^2 / n modulo 2, in whole numbers: large squares would lose the phase.
        return F.pmod(at.cast("decimal(38,0)") * at, (F.col("n") * 2).cast("decimal(38,0)")).cast(
            "double"
        ) * F.lit(math.pi) / F.col("n")

    angle = chirp(F.col("pos"))
    signal = sized.select(
        *keys, "pos", "n", "n1", "n2",
        (F.col("x") * F.cos(angle)).alias("re"), (-F.col("x") * F.sin(angle)).alias("im"),
    )
    lengths = signal.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("n", "n1", "n2")])
    m = F.col("n1") * F.col("n2")
    grid = with_range(lengths, m, "pos", spread=True)
    padded = signal.select(*keys, "pos", "n1", "n2", "re", "im").unionByName(
        grid.filter(F.col("pos") >= F.col("n")).select(
            *keys, "pos", "n1", "n2", F.lit(0.0).alias("re"), F.lit(0.0).alias("im")
        )
    )
    back = F.least(F.col("pos"), m - F.col("pos"))
    inside = back < F.col("n")
    kernel = grid.select(
        *keys, "pos", "n1", "n2",
        F.when(inside, F.cos(chirp(back))).otherwise(0.0).alias("re"),
        F.when(inside, F.sin(chirp(back))).otherwise(0.0).alias("im"),
    )
    a = _by_blocks(padded, keys)
    b = _by_blocks(kernel, keys).select(
        *keys, "pos", F.col("re").alias("re2"), F.col("im").alias("im2")
    )
    product = match(a, b, [*keys, "pos"], "inner").select(
        *keys, "pos", "n1", "n2",
        (F.col("re") * F.col("re2") - F.col("im") * F.col("im2")).alias("re"),
        (F.col("re") * F.col("im2") + F.col("im") * F.col("re2")).alias("im"),
    )
    folded = attach(
        _by_blocks(product, keys, inverse=True), lengths.select(*keys, "n"), keys
    )
    # The final turn has length one, so it does not change the magnitude.
    size = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) / (F.col("n1") * F.col("n2"))
    return folded.filter(F.col("pos") * 2 <= F.col("n")).select(
        *keys, F.col("pos").alias("k"), "n", size.alias("magnitude")
    )


def spectrum(
    df: DataFrame, keys: Sequence[str], order: Order, value: str, packed_rows: int = 4096
) -> DataFrame:
    """Magnitude of every bin 0 .. n // 2 of the real Fourier transform of each series.

    Short series are packed into one row each and transformed many at a time.
    Series that fit into one task are transformed one at a time, longer ones in
    blocks.
    """
    keys = list(keys)
    present = df.filter(F.col(value).isNotNull())
    rows = numbered(present, keys, order, "pos", "n").select(
        *keys, "pos", "n", F.col(value).cast("double").alias("x")
    )
    head = _key_schema(rows, keys)
    limit = rows_per_task(df.sparkSession)

    schema = head + "k long, n long, magnitude double"

    def many(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [np.abs(np.fft.rfft(np.asarray(x, dtype=float))) for x in batch["_x"]]
            counts = [len(s) for s in sizes]
            out = {name: np.repeat(batch[name].to_numpy(), counts) for name in keys}
            out["k"] = np.concatenate([np.arange(c) for c in counts]) if counts else []
            out["n"] = np.repeat(batch["_x"].map(len).to_numpy(), counts)
            out["magnitude"] = np.concatenate(sizes) if sizes else []
            yield pd.DataFrame(out)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("pos")["x"].to_numpy()
        size = np.abs(np.fft.rfft(x))
        out = pd.DataFrame({"k": np.arange(len(size)), "n": len(x), "magnitude": size})
        for name in reversed(keys):
            out.insert(0, name, [part[name].iloc[0]] * len(out))
        return out

    # Each series goes by its own length. The counted length only leaves out branches; the last
    # branch built takes all series left over.
    short = min(packed_rows, limit)
    longest = largest_group(present, keys, short)
    items = F.sort_array(F.collect_list(F.struct("pos", "x")))
    packed = rows.filter(F.col("n") <= short) if longest > short else rows
    series = packed.groupBy(*keys).agg(F.transform(items, lambda p: p["x"]).alias("_x"))
    found = series.mapInPandas(many, schema)
    if longest > short:
        fitting = rows.filter(F.col("n") > short)
        fitting = fitting.filter(F.col("n") <= limit) if longest > limit else fitting
        found = found.unionByName(fitting.groupBy(*keys).applyInPandas(one, schema))
    if longest > limit:
        found = found.unionByName(_long_spectrum(rows.filter(F.col("n") > limit), keys))
    return found


def _p_value(stat: float) -> float:
    if stat > P_MAX:
        return 1.0
    if stat < P_MIN:
        return 0.0
    terms = P_SMALL if stat <= P_STAR else P_LARGE
    z = sum(c * stat**i for i, c in enumerate(terms))
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def dickey_fuller(
    df: DataFrame, keys: Sequence[str], order: Order, value: str, max_lags: int = 0
) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant, per series.

    The number of lagged changes is the one of 0 .. ``max_lags`` with the lowest
    AIC over the rows that all candidates share; the statistic is then taken over
    all rows that have those lags. Everything follows from sums of products, kept
    apart by how many lags a row has, so no task holds a series.
    """
    keys = list(keys)
    present = df.filter(F.col(value).isNotNull())
    frames = Frames(present, keys, order, before=max_lags + 1, position="_pos")
    rows = frames.df.withColumns(
        {f"_x{i}": F.lag(value, i).over(frames.order) for i in range(1, max_lags + 2)}
    )
    rows = frames.finish(rows).filter("_pos >= 1")
    levels = [F.col(value), *[F.col(f"_x{i}") for i in range(1, max_lags + 2)]]
    changes = [
        F.coalesce(levels[i] - levels[i + 1], F.lit(0.0)) for i in range(1, max_lags + 1)
    ]
    step = F.col(value).cast("double") - F.col("_x1")
    has = F.least(F.col("_pos") - 1, F.lit(max_lags)).cast("int")
    sums = comoments([F.col("_x1").cast("double"), *changes, step])
    table = rows.groupBy(*keys, has.alias("_has")).agg(
        *[c.alias(f"_{name}") for name, c in sums.items()]
    )
    size = max_lags + 2

    def fit(sums: list[np.ndarray], lags: int, least: int) -> tuple[float, float, int]:
        """(statistic, AIC, rows) of the model with ``lags`` over rows with >= ``least``."""
        has, rows, means, co = sums
        use = has >= least
        n, k = int(rows[use].sum()), 2 + lags
        if n <= k:
            return math.nan, math.inf, n
        # parts of a series have means of their own
        mean = (rows[use, None] * means[use]).sum(axis=0) / n
        off = means[use] - mean
        joint = symmetric(co[use], size).sum(axis=0)
        joint = joint + np.einsum("r,ri,rj->ij", rows[use].astype(float), off, off)
        some = [*range(lags + 1), size - 1]
        w, sse, inverse, singular = solve_centred(joint[np.ix_(some, some)][None])
        if singular[0]:
            return math.nan, math.inf, n
        sse = float(sse[0])
        spread = inverse[0, 0, 0] * sse / (n - k)
        stat = w[0, 0] / math.sqrt(spread) if spread > 0 else math.nan
        aic = n * (math.log(2 * math.pi * sse / n) + 1) + 2 * k if sse > 0 else -math.inf
        return float(stat), aic, n

    def test(sums: list[np.ndarray]) -> dict[str, float]:
        lags = min((fit(sums, i, max_lags)[1], i) for i in range(max_lags + 1))[1]
        stat, _, n = fit(sums, lags, lags)
        found = {"statistic": stat, "p_value": _p_value(stat) if stat == stat else math.nan,
                 "lags": lags, "rows": n}
        for level, surface in CRITICAL_VALUES.items():
            found[f"critical_{level[:-1]}"] = sum(c / n**i for i, c in enumerate(surface))
        return found

    parts = ["_has", *[f"_{name}" for name in sums]]

    def tests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(*[batch[c] for c in parts])
            found = pd.DataFrame([test([np.stack(list(c)) for c in row]) for row in rows])
            yield pd.concat([batch[keys].reset_index(drop=True), found], axis=1)

    schema = _key_schema(table, keys) + (
        "statistic double, p_value double, lags int, rows long,"
        " critical_1 double, critical_5 double, critical_10 double"
    )
    # At most max_lags + 1 rows of sums per series.
    lists = [F.collect_list(c).alias(c) for c in parts]
    return table.groupBy(*keys).agg(*lists).mapInPandas(tests, schema)

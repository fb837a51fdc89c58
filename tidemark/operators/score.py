"""Scores of forecasts and classifiers, all plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The thresholds 0.10, 0.11, ... 0.50 of the F1 sweep.
F1_THRESHOLDS = tuple(round(0.10 + 0.01 * i, 2) for i in range(41))


def regression_scores(
    df: DataFrame,
    actual: str,
    predicted: str,
    by: Sequence[str] = (),
    digits: int | None = None,
) -> DataFrame:
    """MAE, RMSE, MSE, MAPE (percent) and R2 over rows that have both values.

    MAPE leaves out rows whose actual value is 0 and counts them in
    ``zero_actuals``. R2 is null when the actual values do not vary.
    """
    y, p = F.col(actual), F.col(predicted)
    e = y - p
    rows = df.filter(y.isNotNull() & p.isNotNull())
    spread = F.var_pop(y)
    scores = {
        "mae": F.avg(F.abs(e)),
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "mape": F.avg(F.abs(e / F.nullif(y, F.lit(0.0)))) * 100,
        "r2": F.when(spread > 0, 1 - F.avg(e * e) / spread),
    }
    if digits is not None:
        scores = {name: F.round(c, digits) for name, c in scores.items()}
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(y == 0).alias("zero_actuals"),
        *[c.alias(name) for name, c in scores.items()],
    )


def truncated(df: DataFrame, column: str) -> DataFrame:
    """Cut the fraction off, toward zero."""
    return df.withColumn(column, F.col(column).cast("long"))


def accuracy(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    pairs = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = F.explode(
        F.array(
            F.struct(F.col("y").alias("class"), F.col("n").alias("support"), zero.alias("found"),
                     hit.cast("long").alias("hits")),
            F.struct(F.col("p").alias("class"), zero.alias("support"), F.col("n").alias("found"),
                     zero.alias("hits")),
        )
    ).alias("s")
    sums = pairs.select(sides).select("s.*").groupBy("class").agg(
        F.sum("hits").alias("hits"), F.sum("found").alias("found"),
        F.sum("support").alias("support"),
    )
    precision = _ratio(F.col("hits"), F.col("found"))
    recall = _ratio(F.col("hits"), F.col("support"))
    f1 = _ratio(F.lit(2.0) * F.col("hits"), F.col("found") + F.col("support"))
    return sums.select(
        "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support"
    )


def f1_by_threshold(
    df: DataFrame, label: str, probability: str, thresholds: Sequence[float] = F1_THRESHOLDS
) -> DataFrame:
    """F1 of ``probability > t`` for each threshold.

    Rows are first counted by how many thresholds they pass, so the sweep itself
    runs on at most a few hundred counts.
    """
    cuts = sorted(thresholds)
    passed = sum(((F.col(probability) > F.lit(t)).cast("int") for t in cuts), F.lit(0))
    counts = df.groupBy(passed.alias("passed"), (F.col(label) == 1).alias("positive")).agg(
        F.count(F.lit(1)).alias("n")
    )
    grid = F.array(*[F.lit(t) for t in cuts])
    swept = counts.select("*", F.posexplode(grid).alias("step", "threshold"))
    flagged = F.col("passed") > F.col("step")
    tp = F.sum(F.when(flagged & F.col("positive"), F.col("n")).otherwise(0))
    fp = F.sum(F.when(flagged & ~F.col("positive"), F.col("n")).otherwise(0))
    fn = F.sum(F.when(~flagged & F.col("positive"), F.col("n")).otherwise(0))
    return swept.groupBy("threshold").agg(
        F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1")
    )


def best_f1_threshold(
    df: DataFrame, label: str, probability: str, thresholds: Sequence[float] = F1_THRESHOLDS
) -> DataFrame:
    """The lowest threshold of the highest F1."""
    scores = f1_by_threshold(df, label, probability, thresholds).filter("f1 > 0")
    return scores.orderBy(F.desc("f1"), "threshold").limit(1)

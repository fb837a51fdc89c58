"""MLlib models, custom pipeline stages and batch inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import Evaluator, RegressionEvaluator
from pyspark.ml.feature import IDF, HashingTF, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import TrainValidationSplit, TrainValidationSplitModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as fn
from tidemark.operators import clean, scaling


class TokenStage(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable,
                 DefaultParamsWritable):
    """Words and punctuation runs without stop words, as a pipeline stage."""

    stopWords = Param(Params._dummy(), "stopWords", "words to drop, lower case",
                      TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, stopWords=None) -> None:
        super().__init__()
        self._setDefault(stopWords=[])
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        tokens = fn.words_and_punctuation(F.col(self.getInputCol()))
        stop = self.getOrDefault(self.stopWords)
        if stop:
            tokens = fn.without(tokens, stop, ignore_case=True)
        return dataset.withColumn(self.getOutputCol(), tokens)


class FeatureStage(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Keep the named columns."""

    @keyword_only
    def __init__(self, *, inputCols=None) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.select(*self.getInputCols())


class ImputeStage(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Column-by-column imputation; ``modes`` runs parallel to ``inputCols``."""

    modes = Param(Params._dummy(), "modes", "default, mean or customize per column",
                  TypeConverters.toListString)
    value = Param(Params._dummy(), "value", "value of customize", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, modes=None, value=1.0) -> None:
        super().__init__()
        self._setDefault(value=1.0)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        modes = dict(zip(self.getInputCols(), self.getOrDefault(self.modes), strict=True))
        return clean.impute(dataset, modes, self.getOrDefault(self.value))


class RobustScaleStage(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable,
                       DefaultParamsWritable):
    """Exact median / quartile-range scaling of one column on itself."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        column, out = self.getInputCol(), self.getOutputCol()
        stats = scaling.fit(dataset, [], [column], "robust")
        rows = scaling.transform(dataset, stats, [], [column], suffix="_robust_scaled")
        return scaling.drop_statistics(rows, [column]).withColumnRenamed(
            f"{column}_robust_scaled", out
        )


def linear_model(features: Sequence[str], target: str, **params: Any) -> Pipeline:
    return _on_vector(features, LinearRegression(labelCol=target, predictionCol="predicted",
                                                 **params))


def boosted_model(features: Sequence[str], target: str, **params: Any) -> Pipeline:
    return _on_vector(features, GBTRegressor(labelCol=target, predictionCol="predicted", **params))


def class_model(features: Sequence[str], target: str, **params: Any) -> Pipeline:
    return _on_vector(
        features, LogisticRegression(labelCol=target, predictionCol="predicted", **params)
    )


def _on_vector(features: Sequence[str], estimator: Estimator) -> Pipeline:
    gather = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    return Pipeline(stages=[gather, estimator])


def text_model(text: str, target: str, buckets: int = 1 << 16, **params: Any) -> Pipeline:
    """Binary text classifier: tokens, hashed counts, inverse frequency, logistic fit."""
    return Pipeline(
        stages=[
            TokenStage(inputCol=text, outputCol="tokens", stopWords=list(fn.STOP_WORDS)),
            HashingTF(inputCol="tokens", outputCol="counts", numFeatures=buckets),
            IDF(inputCol="counts", outputCol="features"),
            LogisticRegression(labelCol=target, predictionCol="predicted", **params),
        ]
    )


def feature_weights(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Weight of each input column of a fitted linear pipeline, and the intercept."""
    gather, linear = model.stages[0], model.stages[-1]
    rows = list(zip(gather.getInputCols(), (float(w) for w in linear.coefficients)))
    rows.append(("(intercept)", float(linear.intercept)))
    return spark.createDataFrame(rows, "feature string, weight double")


def search(
    train: DataFrame,
    pipeline: Pipeline,
    grid: Sequence[Mapping[Param, Any]],
    target: str,
    keep_at: float = 0.9,
    evaluator: Evaluator | None = None,
    save_to: str | None = None,
    parallelism: int = 4,
    seed: int = 2019,
) -> tuple[DataFrame, TrainValidationSplitModel]:
    """Fit every grid point, report its R2 x 100, save the best one if it is good enough."""
    evaluator = evaluator or RegressionEvaluator(
        labelCol=target, predictionCol="predicted", metricName="r2"
    )
    tuned = TrainValidationSplit(
        estimator=pipeline, estimatorParamMaps=list(grid), evaluator=evaluator,
        trainRatio=0.8, parallelism=parallelism, seed=seed,
    ).fit(train)
    best = max(tuned.validationMetrics)
    rows = []
    for i, (point, metric) in enumerate(zip(grid, tuned.validationMetrics)):
        settings = ", ".join(f"{p.name}={v}" for p, v in point.items())
        rows.append((i, settings, float(metric) * 100, metric >= keep_at, metric == best))
    report = train.sparkSession.createDataFrame(
        rows, "fit int, settings string, score double, kept boolean, best boolean"
    )
    if save_to is not None and best >= keep_at:
        save_model(tuned.bestModel, save_to)
    return report, tuned


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def batch_inference(
    df: DataFrame,
    load: Callable[[], Any],
    predict: Callable[[Any, pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Score a table with any Python model.

    ``load`` runs once per task, on the executor; ``predict`` gets the model and
    one Arrow batch at a time.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield predict(model, batch)

    return df.mapInPandas(score, schema)

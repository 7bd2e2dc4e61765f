"""Hand-off to pyspark.ml: feature vectors, standard pipelines, evaluation and what features matter."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.errors import QuillonError, SchemaError
from quillon.operators.rows import numbered
from quillon.types import require


def feature_matrix(df: DataFrame, columns: Sequence[str], to: str = "features") -> DataFrame:
    """A vector column; nulls are 0."""
    names = require(df, list(columns))
    filled = df.select("*", *(F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(f"__f{i}") for i, n in enumerate(names)))
    inputs = [f"__f{i}" for i in range(len(names))]
    return VectorAssembler(inputCols=inputs, outputCol=to).transform(filled).drop(*inputs)


def dataset(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(features, label) for training; a null is an error."""
    names = require(df, [*columns, label])
    if not df.where(F.greatest(*(F.col(n).isNull().cast("int") for n in names)) == 1 if len(names) > 1 else F.col(names[0]).isNull()).isEmpty():
        raise QuillonError("nulls can't be trained on")
    return feature_matrix(df, columns).select("features", F.col(names[-1]).cast("double").alias("label"))


def to_arrays(df: DataFrame, vector: str, to: str) -> DataFrame:
    return df.withColumn(to, vector_to_array(F.col(vector)))


def from_arrays(df: DataFrame, array: str, to: str) -> DataFrame:
    return df.withColumn(to, array_to_vector(F.col(array)))


def sparse_entries(df: DataFrame, array: str, key: str, threshold: float = 1e-6) -> DataFrame:
    """(key, index, value) of entries whose magnitude is above the threshold."""
    return df.select(key, F.posexplode(array).alias("index", "value")).where(F.abs("value") > threshold)


def pipeline(kind: str, features: str = "features", label: str = "label") -> Pipeline:
    """binary: scaled features and a logistic model; multiclass: a multinomial one; regression: a linear one."""
    scaled = MinMaxScaler(inputCol=features, outputCol="scaled")
    models = {
        "binary": lambda: LogisticRegression(featuresCol="scaled", labelCol=label, family="binomial"),
        "multiclass": lambda: LogisticRegression(featuresCol="scaled", labelCol=label, family="multinomial"),
        "regression": lambda: LinearRegression(featuresCol="scaled", labelCol=label),
    }
    if kind not in models:
        raise SchemaError(f"no pipeline {kind!r}")
    return Pipeline(stages=[scaled, models[kind]()])


def evaluator(kind: str, label: str = "label"):  # noqa: ANN201
    return {"binary": lambda: BinaryClassificationEvaluator(labelCol=label), "multiclass": lambda: MulticlassClassificationEvaluator(labelCol=label), "regression": lambda: RegressionEvaluator(labelCol=label)}[kind]()


def train_and_evaluate(kind: str, train: DataFrame, test: DataFrame) -> tuple[PipelineModel, float]:
    model = pipeline(kind).fit(train)
    return model, evaluator(kind).evaluate(model.transform(test))


def cross_validate(kind: str, df: DataFrame, folds: int = 5, seed: int = 0) -> float:
    """The mean of the folds' figures."""
    made = CrossValidator(estimator=pipeline(kind), estimatorParamMaps=ParamGridBuilder().build(), evaluator=evaluator(kind), numFolds=folds, seed=seed)
    return made.fit(df).avgMetrics[0]


def feature_importance(kind: str, model: PipelineModel, df: DataFrame, names: Sequence[str], seed: int = 0) -> dict[str, float]:
    """How much the figure falls when a feature's values are dealt to other rows."""
    base = evaluator(kind).evaluate(model.transform(df))
    keyed = to_arrays(df, "features", "__a")
    out = {}
    for i, n in enumerate(names):
        marked = numbered(keyed.withColumn("__r", F.monotonically_increasing_id()), "__r", "__n")
        mixed = numbered(keyed.select(F.get("__a", F.lit(i)).alias("__v")).withColumn("__x", F.xxhash64(F.lit(seed), F.monotonically_increasing_id())), ["__x", "__v"], "__m").select("__v", "__m")
        met = marked.join(mixed, F.col("__n") == F.col("__m"))
        changed = met.withColumn("__a", _replaced("__a", i, "__v"))
        out[n] = base - evaluator(kind).evaluate(model.transform(from_arrays(changed.drop("features"), "__a", "features")))
    return out


def _replaced(array: str, index: int, by: str) -> Column:
    return F.transform(array, lambda x, j: F.when(j == index, F.col(by)).otherwise(x))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def sample(logits: np.ndarray, temperature: float = 1.0, top_k: int = 0, seed: int | None = None) -> int:
    """An index drawn by the softmax of logits over temperature, of the top_k largest if that is above 0."""
    z = np.asarray(logits, float) / max(temperature, 1e-8)
    if top_k:
        z = np.where(z >= np.sort(z)[-min(top_k, len(z))], z, -np.inf)
    p = np.exp(z - z.max())
    return int(np.random.default_rng(seed).choice(len(p), p=p / p.sum()))

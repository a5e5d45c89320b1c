"""Forecasting models over feature columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import errors


class BoostedTrees:
    """Gradient-boosted trees. Rows with a missing feature teach nothing, but predict()
    returns every row: a missing feature takes the branch of large values."""

    def __init__(self, trees: int = 500, depth: int = 6, rate: float = 0.05, subsample: float = 0.8, columns: str = "0.8", seed: int = 42):
        self.params = {"maxIter": trees, "maxDepth": depth, "stepSize": rate, "subsamplingRate": subsample, "featureSubsetStrategy": columns, "seed": seed}
        self.model = None

    def fit(self, df: DataFrame, features: Sequence[str], target: str) -> BoostedTrees:
        self.assembler = VectorAssembler(inputCols=list(features), outputCol="_cw_x", handleInvalid="skip")
        self.model = GBTRegressor(featuresCol="_cw_x", labelCol=target, predictionCol="prediction", **self.params).fit(self.assembler.transform(df))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("predict before fit")
        return self.model.transform(self.assembler.copy({self.assembler.handleInvalid: "keep"}).transform(df)).drop("_cw_x")


class MeanBaseline:
    """The training mean for every row."""

    def __init__(self) -> None:
        self.mean: float | None = None

    def fit(self, df: DataFrame, features: Sequence[str], target: str) -> MeanBaseline:
        self.mean = df.agg(F.avg(target)).first()[0]
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.mean is None:
            raise RuntimeError("predict before fit")
        return df.withColumn("prediction", F.lit(float(self.mean)))


#: Names of models. The recurrent and attention models are mean baselines: no deep
#: learning library is at hand, and they say so.
MODELS = {"gbt": BoostedTrees, "xgboost": BoostedTrees, "mean": MeanBaseline, "lstm": MeanBaseline, "tft": MeanBaseline}


def create(name: str, **params) -> BoostedTrees | MeanBaseline:
    if name not in MODELS:
        raise ValueError(f"no model {name!r}")
    return MODELS[name](**params)


def evaluate(model: BoostedTrees | MeanBaseline, df: DataFrame, target: str) -> dict[str, float]:
    return errors(model.predict(df), target, "prediction").first().asDict()

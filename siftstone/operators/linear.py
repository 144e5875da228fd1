"""Linear and boosted models on feature columns: fitting by pyspark.ml, scoring as a plain column expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.operators.stats import STRIPE, regression_metrics, summed_stripes


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float

    def column(self) -> Column:
        """The prediction; null if a feature is null."""
        out = F.lit(self.bias)
        for name, w in zip(self.features, self.weights):
            out = out + F.col(name).cast("double") * F.lit(w)
        return out

    def importance(self, spark: SparkSession, k: int = 20) -> DataFrame:
        """feature, weight and rank of the k weights that are largest in size."""
        top = sorted(zip(self.features, self.weights), key=lambda x: (-abs(x[1]), x[0]))[:k]
        return spark.createDataFrame([(f, w, i) for i, (f, w) in enumerate(top, 1)], "feature string, weight double, rank int")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(list(self.features), list(self.weights), self.bias)], "features array<string>, weights array<double>, bias double").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearModel:
        row = spark.read.parquet(path).first()
        return LinearModel(tuple(row.features), tuple(row.weights), row.bias)


def _unpacked(words: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, bits x rows as 0 and 1) of the rows that have bits / 64 words and no null among them."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == bits // 64)
    flat = words.take(pa.array(rows)).flatten().cast(pa.int64())
    whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(rows), -1).all(axis=1)
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(len(rows), -1)[whole]
    return rows[whole], np.unpackbits(np.ascontiguousarray(values).astype("<i8").view(np.uint8), axis=1, bitorder="little")


@dataclass(frozen=True)
class BitModel:
    """A linear model on fingerprints packed in longs: a weight for each bit, no column for each bit."""

    weights: tuple[float, ...]
    bias: float

    @staticmethod
    def fit(df: DataFrame, bits: str, label: str, size: int, l2: float = 0.01) -> BitModel:
        """The least mean of squares and l2 times the squared weights, from one pass: sums of products of the bits.

        size: bits of a fingerprint, a multiple of 64. A task adds up a matrix of size x size, and matrices
        are added up by stripes. Rows without a label or with another number of words, or a null word, are left out.
        """
        if size < 64 or size % 64:
            raise ValueError("the size must be a multiple of 64")

        def products(batches):
            from pyspark import TaskContext

            gram, moved, ones, y_sum, n = np.zeros((size, size)), np.zeros(size), np.zeros(size), 0.0, 0
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    rows, x = _unpacked(part.column(0), size)
                    x, y = x.astype(np.float64), part.column(1).to_numpy(zero_copy_only=False)[rows]
                    gram, moved, ones, y_sum, n = gram + x.T @ x, moved + x.T @ y, ones + x.sum(axis=0), y_sum + y.sum(), n + len(y)
            if n:
                stripes = range(0, size, STRIPE)
                values = [np.concatenate([gram[s : s + STRIPE].ravel(), moved[s : s + STRIPE], ones[s : s + STRIPE], [y_sum, n]]).tobytes() for s in stripes]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([TaskContext.get().partitionId() % 64] * len(values), pa.int32()), pa.array(values, pa.binary())], names=["stripe", "salt", "sums"])

        rows = df.select(F.col(bits), F.col(label).cast("double").alias("y")).filter("y IS NOT NULL AND NOT isnan(y)")
        added = summed_stripes(summed_stripes(rows.mapInArrow(products, "stripe int, salt int, sums binary"), "stripe", "salt"), "stripe")
        found = [np.frombuffer(r.sums) for r in sorted(added.collect())]  # size x size numbers
        if not found:
            raise ValueError("there is no row to learn from")
        wide = STRIPE * size
        gram, moved, ones = (np.concatenate([f[a:b] for f in found]) for a, b in ((0, wide), (wide, wide + STRIPE), (wide + STRIPE, wide + 2 * STRIPE)))
        y_sum, n = found[0][-2:]
        mean = ones / n
        weights = np.linalg.solve(gram.reshape(size, size) / n - np.outer(mean, mean) + l2 * np.eye(size), moved / n - mean * y_sum / n)
        return BitModel(tuple(weights.tolist()), float(y_sum / n - mean @ weights))

    def score(self, df: DataFrame, bits: str, name: str = "predicted") -> DataFrame:
        """df with a prediction for each row: NaN for a null fingerprint, one with a null word, or one of another size. A column of that name is replaced."""
        weights, bias = np.array(self.weights), self.bias
        kept = [c for c in df.columns if c != name]

        def run(batches):
            for batch in batches:
                out = np.full(batch.num_rows, np.nan)
                rows, x = _unpacked(batch.column(kept.index(bits)), len(weights))
                out[rows] = x @ weights + bias
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*kept, name])

        rows = df.select(*kept)
        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))


@dataclass(frozen=True)
class BoostedModel:
    """Boosted trees with the names of their features."""

    features: tuple[str, ...]
    trees: GBTRegressionModel

    def save(self, spark: SparkSession, path: str) -> None:
        self.trees.write().overwrite().save(f"{path}/trees")
        spark.createDataFrame([(list(self.features),)], "features array<string>").write.mode("overwrite").parquet(f"{path}/features")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedModel:
        return BoostedModel(tuple(spark.read.parquet(f"{path}/features").first().features), GBTRegressionModel.load(f"{path}/trees"))


def load_model(spark: SparkSession, boosted: str, linear: str) -> BoostedModel | LinearModel:
    """The boosted model if its folder is there, else the linear one."""
    try:
        return BoostedModel.load(spark, boosted)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return LinearModel.load(spark, linear)


def predict(df: DataFrame, model: BoostedModel | LinearModel, name: str = "predicted") -> DataFrame:
    """df with a prediction for each row, NaN for a row in which a feature is null or NaN. No row is left out."""
    bad = F.lit(False)
    for c in model.features:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    if isinstance(model, LinearModel):
        return df.withColumn(name, F.when(bad, float("nan")).otherwise(model.column()))
    filled = df.withColumn("__x", array_to_vector(F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in model.features))))
    out = model.trees.setFeaturesCol("__x").setPredictionCol("__y").transform(filled)
    return out.withColumn(name, F.when(bad, float("nan")).otherwise(F.col("__y"))).drop("__x", "__y")


def fit_and_judge(train: DataFrame, test: DataFrame, features: Sequence[str], label: str) -> tuple[LinearModel, DataFrame]:
    """A linear model of train, and its n, rmse and r2 on train and on test (column part)."""
    model = fit_linear(train, features, label)
    judged = [regression_metrics(part, F.col(label), model.column()).withColumn("part", F.lit(name)) for name, part in (("train", train), ("test", test))]
    return model, judged[0].unionByName(judged[1])


def _assembled(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    ready = df.filter(F.col(label).isNotNull())
    return VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="skip").transform(ready)


def fit_linear(df: DataFrame, features: Sequence[str], label: str, l1: float = 0.001, l2: float = 0.01, max_iter: int = 5000) -> LinearModel:
    """An elastic net with the two penalties. Rows with a null or NaN in a feature or label are left out."""
    total = l1 + l2
    model = LinearRegression(featuresCol="__x", labelCol=label, regParam=total, elasticNetParam=l1 / total if total else 0.0, maxIter=max_iter, standardization=False).fit(_assembled(df, features, label))
    return LinearModel(tuple(features), tuple(float(w) for w in model.coefficients), float(model.intercept))


def fit_boosted(df: DataFrame, features: Sequence[str], label: str, depth: int = 8, rate: float = 0.05, rounds: int = 100, validation: str | None = None, seed: int = 42):
    """Boosted trees; with validation (a boolean column) they stop when they no longer get better on its rows."""
    more = {"validationIndicatorCol": validation} if validation else {}
    return GBTRegressor(featuresCol="__x", labelCol=label, maxDepth=depth, stepSize=rate, maxIter=rounds, seed=seed, **more).fit(_assembled(df, features, label))


def tune_boosted(df: DataFrame, features: Sequence[str], label: str, depths: Sequence[int] = (4, 8), rates: Sequence[float] = (0.05, 0.1), rounds: int = 20, seed: int = 42, parallelism: int = 2):
    """The best boosted trees of a grid, judged on a fifth of the rows that none of them was fitted on."""
    from pyspark.ml.evaluation import RegressionEvaluator

    trees = GBTRegressor(featuresCol="__x", labelCol=label, maxIter=rounds, seed=seed)
    grid = ParamGridBuilder().addGrid(trees.maxDepth, list(depths)).addGrid(trees.stepSize, list(rates)).build()
    return TrainValidationSplit(estimator=trees, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label, metricName="rmse"), trainRatio=0.8, seed=seed, parallelism=parallelism).fit(_assembled(df, features, label))

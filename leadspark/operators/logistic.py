"""Logistic regression by reweighted least squares: one small sum per Newton step, many fits at a time.

A step needs the gradient and the Gram matrix of the weighted features, some hundred numbers whatever the rows; each
task adds them up over its rows for every fit, Spark adds up the tasks', the driver solves. Features are scaled by
mean and population deviation, classes balanced, coefficients (not the intercept) bear an L2 penalty of strength 1/C.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import StandardScalerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.session import fresh_path, stage

# The functions below travel to the executors by value, so those need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Scaled:
    """A fit: what scales its rows, its class weights, and what it has learnt (coefficients, intercept last)."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: tuple[float, float]
    c: float
    held: int
    beta: np.ndarray


def read_rows(vectors: DataFrame, label: str = "converted", part: str | None = None) -> DataFrame:
    """label, part and the features, written once; every step reads them."""
    source = vectors.select(F.col(label).cast("double").alias("label"), (F.lit(0) if part is None else F.col(part).cast("int")).alias("part"), vector_to_array("features").alias("x"))
    return stage(source, "logistic-rows")


def _moments(rows: DataFrame, n: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per part: rows per class, means, sums of squared deviations."""
    x = [F.col("x")[k] for k in range(n)]
    found = rows.groupBy("part").agg(
        F.array(F.sum(1 - F.col("label")), F.sum("label")).alias("n"), F.array(*[F.avg(c) for c in x]).alias("mean"), F.array(*[F.var_pop(c) for c in x]).alias("var")
    ).collect()
    return {r["part"]: (np.array(r["n"]), np.array(r["mean"]), np.array(r["var"]) * sum(r["n"])) for r in found}


def _prepare(moments: dict, held: int, c: float, n: int) -> Scaled:
    """Moments of all parts but the one left out, combined."""
    parts = [v for part, v in moments.items() if part != held]
    classes = sum((v[0] for v in parts), np.zeros(2))
    total = max(classes.sum(), 1.0)
    mean = sum((v[0].sum() * v[1] for v in parts), np.zeros(n)) / total
    squares = sum((v[2] + v[0].sum() * (v[1] - mean) ** 2 for v in parts), np.zeros(n))
    deviation = np.sqrt(squares / total)
    weights = tuple(total / (2 * k) if k else 1.0 for k in classes)
    return Scaled(mean, np.where(deviation == 0, 1.0, deviation), weights, c, held, np.zeros(n + 1))


def _sums(rows: DataFrame, fits: list[Scaled], points: list[np.ndarray]) -> list[np.ndarray]:
    """For each fit at its point: loss, gradient and Gram matrix, flattened, over all rows but those left out."""
    width = len(points[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(fits), 1 + width + width * width))
        for batch in batches:
            y, part = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width - 1)
            for k, (fit, beta) in enumerate(zip(fits, points)):
                use = part != fit.held
                z = np.hstack([(x[use] - fit.mean) / fit.deviation, np.ones((use.sum(), 1))])
                t = y[use]
                w = np.where(t > 0, fit.weights[1], fit.weights[0])
                margin = z @ beta
                p = 1 / (1 + np.exp(-margin))
                loss = (w * (np.logaddexp(0, margin) - t * margin)).sum()
                total[k] += np.concatenate([[loss], z.T @ (w * (p - t)), (z.T @ (z * (w * p * (1 - p))[:, None])).ravel()])
        place = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel())], names=["place", "value"])

    found = rows.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(len(fits) * (1 + width + width * width))
    out[found["place"].to_numpy()] = found["value"].to_numpy()
    return list(out.reshape(len(fits), -1))


def newton(rows: DataFrame, fits: list[Scaled], steps: int, tolerance: float = 1e-9) -> None:
    """Set the coefficients of all fits; each step moves those that have not converged, halving steps that lose."""
    width = len(fits[0].beta)
    ridge = [np.append(np.full(width - 1, 1 / f.c), 0.0) for f in fits]
    before = [np.inf] * len(fits)
    step = [np.zeros(width) for _ in fits]
    open_fits = set(range(len(fits)))
    for _ in range(steps):
        at = sorted(open_fits)
        found = _sums(rows, [fits[k] for k in at], [fits[k].beta for k in at])
        for k, s in zip(at, found):
            f = fits[k]
            loss = s[0] + (ridge[k] * f.beta**2).sum() / 2
            if loss > before[k] + 1e-12 * abs(before[k]) and np.abs(step[k]).max() > tolerance:
                step[k] = step[k] / 2
                f.beta = f.beta - step[k]
                continue
            before[k] = loss
            gradient = s[1 : 1 + width] + ridge[k] * f.beta
            gram = s[1 + width :].reshape(width, width) + np.diag(ridge[k])
            step[k] = -np.linalg.lstsq(gram, gradient, rcond=None)[0]
            f.beta = f.beta + step[k]
            if np.abs(step[k]).max() < tolerance:
                open_fits.discard(k)
        if not open_fits:
            return


def fit_logistic(rows: DataFrame, n_features: int, helds: Sequence[int] = (-1,), c: float = 1.0, steps: int = 1000) -> list[Scaled]:
    """One fit per left-out part (-1 for none) over ``read_rows``."""
    moments = _moments(rows, n_features)
    fits = [_prepare(moments, held, c, n_features) for held in helds]
    newton(rows, fits, steps)
    return fits


def predict_held(rows: DataFrame, fits: list[Scaled]) -> DataFrame:
    """(fold, converted, prediction): each row by the fit that left its part out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(1).to_numpy(zero_copy_only=False)
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            says = np.zeros(len(part), dtype=np.int32)
            for f in fits:
                at = part == f.held
                says[at] = ((x[at] - f.mean) / f.deviation) @ f.beta[:-1] + f.beta[-1] > 0
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0).cast(pa.int32()), pa.array(says)], names=["fold", "converted", "prediction"])

    return rows.mapInArrow(run, "fold int, converted int, prediction int")


def gradient(rows: DataFrame, fits: list[Scaled]) -> list[np.ndarray]:
    """The gradient of each fit's penalised loss at its coefficients; zero where it is least."""
    width = len(fits[0].beta)
    sums = _sums(rows, fits, [f.beta for f in fits])
    return [s[1 : 1 + width] + np.append(np.full(width - 1, 1 / f.c), 0.0) * f.beta for s, f in zip(sums, fits)]


def as_stages(spark: SparkSession, fit: Scaled, label: str = "converted") -> list:
    """The scaler and the regression as Spark ML models, loaded from its saved form."""
    def save(name: str, kind: str, params: dict, data: DataFrame) -> str:
        path = fresh_path(spark, name)
        about = {"class": f"org.apache.spark.ml.{kind}", "timestamp": 0, "sparkVersion": spark.version, "uid": f"{name}_newton", "paramMap": params, "defaultParamMap": {}}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        data.coalesce(1).write.parquet(f"{path}/data")
        return path

    scaler = save("scaler", "feature.StandardScalerModel", {"inputCol": "features", "outputCol": "scaled", "withMean": True, "withStd": True},
                  spark.createDataFrame([(Vectors.dense(fit.deviation), Vectors.dense(fit.mean))], ["std", "mean"]))
    values = fit.beta[:-1]
    row = (2, len(values), Vectors.dense([fit.beta[-1]]), DenseMatrix(1, len(values), values.tolist(), True), False)
    regression = save(
        "logistic", "classification.LogisticRegressionModel",
        {"featuresCol": "scaled", "labelCol": label, "predictionCol": "prediction", "probabilityCol": "probability", "rawPredictionCol": "rawPrediction", "threshold": 0.5},
        spark.createDataFrame([row], ["numClasses", "numFeatures", "interceptVector", "coefficientMatrix", "isMultinomial"]).selectExpr(
            "CAST(numClasses AS INT) AS numClasses", "CAST(numFeatures AS INT) AS numFeatures", "interceptVector", "coefficientMatrix", "isMultinomial"),
    )
    return [StandardScalerModel.load(scaler), LogisticRegressionModel.load(regression)]

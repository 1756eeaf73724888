"""Trained models over feature tables: boosted trees for failures, linear ones for codec measures."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _clean(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Fields as doubles, not-a-numbers as nulls."""
    return rows.withColumns({f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in fields})


def train_failure_model(rows: DataFrame, fields: list[str], label: str, trees: int = 20, depth: int = 4, seed: int = 1) -> PipelineModel:
    """Boosted trees for a 0/1 label; missing fields take the field's median. Needs rows of both labels."""
    stages = [Imputer(strategy="median", inputCols=fields, outputCols=[f"{f}_i" for f in fields]), VectorAssembler(inputCols=[f"{f}_i" for f in fields], outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed, predictionCol="predicted").setProbabilityCol("_p").setRawPredictionCol("_r")]
    return Pipeline(stages=stages).fit(_clean(rows, fields).withColumn(label, F.col(label).cast("double")))


def failure_probability(model: PipelineModel, rows: DataFrame, fields: list[str]) -> DataFrame:
    """The rows with ``probability``; their other columns stay."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_clean(rows, fields))
    return out.withColumn("probability", vector_to_array("_p")[1]).drop("_x", "_p", "_r", *[f"{f}_i" for f in fields])


def train_linear(rows: DataFrame, fields: list[str], target: str) -> PipelineModel:
    """Least squares of a measure on the fields; rows with gaps are left out."""
    stages = [VectorAssembler(inputCols=fields, outputCol="_x", handleInvalid="skip"), LinearRegression(featuresCol="_x", labelCol=target, predictionCol="predicted")]
    return Pipeline(stages=stages).fit(_clean(rows, [*fields, target]).dropna(subset=[*fields, target]))


class DenseNet:
    """A small dense network for measures of a codec, trained on all rows by whole-batch steps.

    The weights are few and sent out with every step; each task gives the sum of its rows' gradients and one row
    comes back per task, so a step costs one pass and no shuffle of rows. Fields are centred and scaled by statistics over
    all rows; a missing field counts as its mean.
    """

    def __init__(self, fields: list[str], targets: list[str], hidden: tuple[int, ...] = (16, 16), seed: int = 1):
        self.fields, self.targets, self.hidden, self.seed = fields, targets, hidden, seed
        self.weights: list[np.ndarray] = []
        self.scale: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None

    def is_ready(self) -> bool:
        return self.scale is not None

    def _statistics(self, rows: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
        r = rows.agg(*[f(c) for c in columns for f in (F.avg, F.stddev_pop)]).first()
        mean, sd = (np.array([x if x is not None else d for x in r[i::2]], dtype=float) for i, d in ((0, 0.0), (1, 0.0)))
        return mean, np.where(sd > 1e-12, sd, 1.0)

    def fit(self, rows: DataFrame, steps: int = 200, rate: float = 0.02) -> DenseNet:
        """Adam on the mean squared error of the scaled targets; rows without a target are left out."""
        rows = _clean(rows, [*self.fields, *self.targets]).dropna(subset=self.targets).select(*self.fields, *self.targets)
        self.scale = (*self._statistics(rows, self.fields), *self._statistics(rows, self.targets))
        sizes = [len(self.fields), *self.hidden, len(self.targets)]
        rng = np.random.default_rng(self.seed)
        self.weights = [x for a, b in zip(sizes, sizes[1:]) for x in (rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b))]
        m, v = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        k, scale = len(self.fields), self.scale
        for step in range(1, steps + 1):
            weights = self.weights

            def gradients(frames):
                total, n = [np.zeros_like(w) for w in weights], 0
                for df in frames:
                    x, y = _scaled(df.iloc[:, :k].to_numpy(float), scale[0], scale[1]), _scaled(df.iloc[:, k:].to_numpy(float), scale[2], scale[3])
                    acts = _activations(x, weights)
                    d = 2 * (acts[-1] - y)
                    for i in range(len(weights) - 2, -1, -2):
                        total[i] += acts[i // 2].T @ d
                        total[i + 1] += d.sum(axis=0)
                        d = (d @ weights[i].T) * (acts[i // 2] > 0)
                    n += len(df)
                yield pd.DataFrame({"n": [n], "g": [np.concatenate([t.ravel() for t in total]).tolist()]})

            got = rows.mapInPandas(gradients, "n bigint, g array<double>").toPandas()  # a row per task
            n = max(int(got["n"].sum()), 1)
            flat, at = np.sum(got["g"].tolist(), axis=0) / n if len(got) else np.zeros(sum(w.size for w in weights)), 0
            for i, w in enumerate(self.weights):
                g = flat[at : at + w.size].reshape(w.shape)
                at += w.size
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                self.weights[i] = w - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """The rows with ``predicted_<target>``."""
        if not self.is_ready():
            raise ValueError("the model isn't fitted")
        weights, scale, names = self.weights, self.scale, [f"predicted_{t}" for t in self.targets]

        def run(batches):
            for b in batches:
                x = np.column_stack([b.column(b.num_columns - len(weights[0]) + j).to_numpy(zero_copy_only=False) for j in range(len(weights[0]))]).astype(float)
                y = _activations(_scaled(x, scale[0], scale[1]), weights)[-1] * scale[3] + scale[2]
                keep = list(range(b.num_columns - len(weights[0])))
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], *[pa.array(np.ascontiguousarray(y[:, j])) for j in range(y.shape[1])]], names=[*[b.schema.names[i] for i in keep], *names])

        src = _clean(rows.select("*", *[F.col(f).alias(f"_x{i}") for i, f in enumerate(self.fields)]), [f"_x{i}" for i in range(len(self.fields))])
        return src.mapInArrow(run, T.StructType([*rows.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]]))

    def save(self, spark: SparkSession, path: str) -> None:
        doc = {"fields": self.fields, "targets": self.targets, "hidden": list(self.hidden), "scale": [s.tolist() for s in self.scale or ()], "weights": [w.tolist() for w in self.weights]}
        spark.createDataFrame([(json.dumps(doc),)], "value string").write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DenseNet:
        doc = json.loads(spark.read.text(path).first()[0])
        out = cls(doc["fields"], doc["targets"], tuple(doc["hidden"]))
        out.weights, out.scale = [np.array(w) for w in doc["weights"]], tuple(np.array(s) for s in doc["scale"]) or None
        return out


def _scaled(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return np.nan_to_num((x - mean) / sd)


def _activations(x: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """Inputs of every layer and the output: rectified but for the last."""
    acts = [x]
    for i in range(0, len(weights), 2):
        z = acts[-1] @ weights[i] + weights[i + 1]
        acts.append(z if i + 2 == len(weights) else np.maximum(z, 0))
    return acts


class Pipelined:
    """The same interface over MLlib pipelines, one per target: ``trees`` (boosted) or ``linear``."""

    def __init__(self, kind: str, fields: list[str], targets: list[str]):
        self.kind, self.fields, self.targets = kind, fields, targets
        self.models: dict[str, PipelineModel] = {}

    def is_ready(self) -> bool:
        return set(self.models) == set(self.targets)

    def fit(self, rows: DataFrame) -> Pipelined:
        for t in self.targets:
            if self.kind == "linear":
                self.models[t] = train_linear(rows, self.fields, t)
            else:
                stages = [Imputer(strategy="median", inputCols=self.fields, outputCols=[f"{f}_i" for f in self.fields]), VectorAssembler(inputCols=[f"{f}_i" for f in self.fields], outputCol="_x"), GBTRegressor(featuresCol="_x", labelCol=t, maxIter=20, maxDepth=4, seed=1, predictionCol="predicted")]
                self.models[t] = Pipeline(stages=stages).fit(_clean(rows, [*self.fields, t]).dropna(subset=[t]))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if not self.is_ready():
            raise ValueError("the model isn't fitted")
        out = _clean(rows, self.fields)
        for t, m in self.models.items():
            out = m.transform(out).withColumnRenamed("predicted", f"predicted_{t}").drop("_x", *[f"{f}_i" for f in self.fields])
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        for t, m in self.models.items():
            m.write().overwrite().save(f"{path}/{t}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, kind: str, fields: list[str], targets: list[str]) -> Pipelined:
        out = cls(kind, fields, targets)
        out.models = {t: PipelineModel.load(f"{path}/{t}") for t in targets}
        return out

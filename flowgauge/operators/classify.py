"""Classifiers on feature vectors, macro-F1 evaluation and grid search."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bounded import local_table
from .assign import as_matrix, from_matrix
from .diversity import fourier_features, frequencies
from .sampling import stratified_folds
from .scores import balanced_weights, classification_metrics

KINDS = ("random_forest", "svm", "dnn")
#: The deepest tree that Spark ML grows.
MAX_DEPTH = 30
OPTIONS = {
    "random_forest": {"n_estimators", "max_depth", "min_samples_leaf", "max_features"},
    "svm": {"C", "gamma", "max_iter", "m", "n_rows", "kernel_col"},
    "dnn": {"hidden_dims", "epochs", "tol", "learning_rate"},
}


class ModelError(ValueError):
    """An unknown kind of model, or one used before it is fitted."""


def with_vectors(df: DataFrame, features: str = "features") -> DataFrame:
    """MLlib's column names and types beside the library's own."""
    return df.withColumn("_vec", array_to_vector(F.col(features))).withColumn("_label", F.col("y").cast("double"))


def kernel_column(omega: np.ndarray):
    """Random Fourier features of an RBF kernel, by numpy on Arrow batches."""

    @F.arrow_udf("array<double>")
    def mapped(v: pa.Array) -> pa.Array:
        return from_matrix(fourier_features(as_matrix(v), omega) if len(v) else np.empty((0, 1)))

    return mapped


def _estimator(kind: str, params: dict, seed: int, dim: int, n_classes: int) -> Estimator:
    columns = {"featuresCol": "_vec", "labelCol": "_label"}
    if kind == "random_forest":
        return RandomForestClassifier(
            numTrees=params.get("n_estimators", 200), maxDepth=_depth(params.get("max_depth", 10)),
            minInstancesPerNode=params.get("min_samples_leaf", 1),
            featureSubsetStrategy=params.get("max_features", "sqrt"), weightCol="weight", seed=seed, **columns,
        )
    if kind == "svm":
        base = LinearSVC(
            regParam=1.0 / max(params.get("C", 1.0) * params.get("n_rows", 1000), 1e-9),
            maxIter=params.get("max_iter", 50), weightCol="weight", standardization=False,
        )
        return OneVsRest(classifier=base, featuresCol=params["kernel_col"], labelCol="_label", weightCol="weight", parallelism=4)
    if kind == "dnn":
        hidden = params.get("hidden_dims", [128, 128, 128])
        return MultilayerPerceptronClassifier(
            layers=[dim, *hidden, n_classes], maxIter=params.get("epochs", 100), tol=params.get("tol", 1e-6), seed=seed,
            # only gradient descent has a rate; without one the quasi-Newton solver is used
            **({"solver": "gd", "stepSize": params["learning_rate"]} if "learning_rate" in params else {}), **columns,
        )
    raise ModelError(f"Unknown kind of model: {kind}. Known: {', '.join(KINDS)}")


@dataclass(frozen=True)
class Kernel:
    """A random-feature map that stands in for an RBF kernel."""

    dim: int
    m: int
    gamma: float
    seed: int

    @property
    def column(self) -> str:
        return f"_kernel_{self.m}_{self.seed}_" + repr(self.gamma).replace(".", "_").replace("-", "m")

    def add(self, df: DataFrame) -> DataFrame:
        omega = frequencies(self.dim, self.m, self.gamma, self.seed)
        return df.withColumn(self.column, array_to_vector(kernel_column(omega)(F.col("features"))))


def _depth(depth: int) -> int:
    if depth > MAX_DEPTH:
        raise ModelError(f"A tree can be at most {MAX_DEPTH} deep, not {depth}")
    return depth


def _check(kind: str, params: dict) -> None:
    unknown = set(params) - OPTIONS[kind]
    if unknown:
        raise ModelError(f"{kind} has no option {', '.join(sorted(unknown))}; it has {', '.join(sorted(OPTIONS[kind]))}")


def feature_variance(df: DataFrame) -> float:
    """The variance of all feature values taken together, in one pass."""
    value = F.explode("features").alias("v")
    return float(df.select(value).agg(F.var_pop("v")).first()[0] or 0.0)


def _kernel(kind: str, params: dict, seed: int, dim: int, variance: float) -> Kernel | None:
    """Gamma "scale" is 1 / (dim * variance of the features), "auto" is 1 / dim."""
    if kind != "svm":
        return None
    gamma = params.get("gamma", "scale")
    if gamma == "scale":
        gamma = 1.0 / (dim * variance) if variance > 0 else 1.0
    elif gamma == "auto":
        gamma = 1.0 / dim
    return Kernel(dim, params.get("m", 128), float(gamma), seed)


class FittedClassifier:
    """A fitted pipeline with predict, probabilities and macro metrics."""

    def __init__(self, kind: str, model: PipelineModel | None, n_classes: int, kernel: Kernel | None = None):
        self.kind, self.model, self.n_classes, self.kernel = kind, model, n_classes, kernel

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise ModelError("The model is not fitted")
        vectors = df.withColumn("_vec", array_to_vector(F.col("features")))
        return self.model.transform(self.kernel.add(vectors) if self.kernel else vectors)

    def predict(self, df: DataFrame, out: str = "pred") -> DataFrame:
        scored = self._transform(df)
        return scored.select(*df.columns, F.col("prediction").cast("int").alias(out))

    def predict_proba(self, df: DataFrame, out: str = "proba") -> DataFrame:
        """Class probabilities; a softmax of the margins for the kernel machine."""
        scored = self._transform(df)
        if self.kind == "svm":
            margins = vector_to_array(F.col("rawPrediction"))
            top = F.array_max(margins)
            raised = F.transform(margins, lambda v: F.exp(v - top))
            total = F.aggregate(raised, F.lit(0.0), lambda s, v: s + v)
            proba = F.transform(raised, lambda v: v / total)
        else:
            proba = vector_to_array(F.col("probability"))
        return scored.select(*df.columns, proba.alias(out))

    def evaluate(self, df: DataFrame, keys: list[str] | None = None) -> DataFrame:
        return classification_metrics(self.predict(df), "y", "pred", keys)

    def activations(self, df: DataFrame) -> DataFrame | None:
        """Last hidden layer of a feed-forward model (sigmoid units); None for other kinds."""
        if self.kind != "dnn":
            return None
        from .mlp import Layer, Network, activations

        stage = self.model.stages[-1]
        sizes, flat, at, stack = stage.getLayers(), np.array(stage.weights), 0, []
        for a, b in zip(sizes[:-1], sizes[1:], strict=True):
            w = flat[at : at + a * b].reshape((b, a), order="F").T
            stack.append(Layer(w, flat[at + a * b : at + a * b + b], "sigmoid"))
            at += a * b + b
        return activations(df, Network({"classifier": stack}))

    def save(self, spark: SparkSession, path: str) -> None:
        """The pipeline, and beside it one row that says how to feed it."""
        if self.model is None:
            raise ModelError("The model is not fitted")
        self.model.write().overwrite().save(f"{path}/model")
        k = self.kernel or Kernel(0, 0, 0.0, 0)
        row = [(self.kind, self.n_classes, k.dim, k.m, k.gamma, k.seed)]
        local_table(spark, row, "kind string, n_classes int, dim int, m int, gamma double, seed int"
        ).write.mode("overwrite").json(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FittedClassifier":
        a = spark.read.json(f"{path}/about").first()
        kernel = Kernel(a.dim, a.m, a.gamma, a.seed) if a.m else None
        return FittedClassifier(a.kind, PipelineModel.load(f"{path}/model"), a.n_classes, kernel)


def fit_classifier(
    df: DataFrame, kind: "str | Estimator", params: dict | None = None, seed: int = 42
) -> FittedClassifier:
    """Fit on ``features, y``.

    ``kind`` is a known name or any Spark ML classifier of the caller's own, whose features and label columns are set.
    Forest and kernel machine use balanced class weights, as does an own classifier that takes weights; the feed-forward
    network takes none.
    """
    params = dict(params or {})
    if isinstance(kind, Estimator):
        own = kind.copy({kind.getParam(k): v for k, v in params.items()})
        columns = {"featuresCol": "_vec", "labelCol": "_label", "weightCol": "weight"}
        own = own.copy({own.getParam(k): v for k, v in columns.items() if own.hasParam(k)})
        n_classes = int(df.agg(F.max("y")).first()[0]) + 1
        return FittedClassifier("own", Pipeline(stages=[own]).fit(balanced_weights(with_vectors(df))), n_classes)
    if kind not in KINDS:
        raise ModelError(f"Unknown kind of model: {kind}. Known: {', '.join(KINDS)}")
    _check(kind, params)
    dim = len(df.select("features").first()[0])
    n_classes = int(df.agg(F.max("y")).first()[0]) + 1
    train = balanced_weights(with_vectors(df))
    kernel = _kernel(kind, params, seed, dim, feature_variance(df) if kind == "svm" else 0.0)
    if kernel:
        params.setdefault("n_rows", df.count())
        params["kernel_col"] = kernel.column
        train = kernel.add(train).persist()
    model = Pipeline(stages=[_estimator(kind, params, seed, dim, n_classes)]).fit(train)
    if kernel:
        train.unpersist()
    return FittedClassifier(kind, model, n_classes, kernel)


class MacroF1Evaluator(Evaluator):
    """Macro-averaged F1 for model selection."""

    def _evaluate(self, dataset: DataFrame) -> float:
        scored = dataset.select(F.col("_label").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"))
        return float(classification_metrics(scored).first().f1 or 0.0)

    def isLargerBetter(self) -> bool:
        return True


# The default search grids, by kind. Depth 50 is beyond Spark ML's trees, so the deepest that it grows
# stands in for it; sizes of batches are left out, as its network is fitted on all rows at once.
GRIDS = {
    "random_forest": {
        "n_estimators": [50, 100, 200, 500], "max_depth": [10, 20, MAX_DEPTH], "min_samples_leaf": [1, 2, 4],
        "max_features": ["sqrt", "log2"],
    },
    "svm": {"C": [0.1, 1.0, 10.0, 100.0], "gamma": ["scale", "auto", 0.001, 0.01, 0.1, 1.0]},
    "dnn": {"learning_rate": [0.0001, 0.0005, 0.001, 0.005, 0.01], "epochs": [50, 100, 200]},
}


def grid_points(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def grid_search(
    df: DataFrame, kind: str, grid: dict[str, list] | None = None, folds: int = 5, seed: int = 42,
    parallelism: int = 2, row_id: str = "row_id",
) -> tuple[FittedClassifier, DataFrame]:
    """Stratified k-fold search on macro-F1, then a refit on all rows.

    Class weights apply in the search and in the refit.  Returns the refitted
    classifier and one row per grid point, best first on ties by position.
    """
    if kind not in KINDS:
        raise ModelError(f"Unknown kind of model: {kind}. Known: {', '.join(KINDS)}")
    points = grid_points(GRIDS[kind] if grid is None else grid)
    dim = len(df.select("features").first()[0])
    n_classes = int(df.agg(F.max("y")).first()[0]) + 1
    data = balanced_weights(with_vectors(stratified_folds(df, folds, seed, row_id=row_id)))
    for p in points:
        _check(kind, p)
    variance = feature_variance(df) if kind == "svm" else 0.0
    kernels = [_kernel(kind, p, seed, dim, variance) for p in points]
    for kernel in {k for k in kernels if k}:
        data = kernel.add(data)
    data = data.persist()
    shared = {"n_rows": data.count()}
    stages = [
        [_estimator(kind, {**shared, **({"kernel_col": k.column} if k else {}), **p}, seed, dim, n_classes)]
        for p, k in zip(points, kernels, strict=True)
    ]
    pipe = Pipeline(stages=stages[0])
    # A grid over whole stage lists lets every point have its own settings.
    search = CrossValidator(
        estimator=pipe, estimatorParamMaps=ParamGridBuilder().addGrid(pipe.stages, stages).build(),
        evaluator=MacroF1Evaluator(), numFolds=folds, foldCol="fold", parallelism=parallelism, seed=seed,
    )
    found: CrossValidatorModel = search.fit(data)
    data.unpersist()
    scores = [(i, repr(p), float(s)) for i, (p, s) in enumerate(zip(points, found.avgMetrics, strict=True))]
    best = max(scores, key=lambda r: (r[2], -r[0]))[0]
    table = local_table(df.sparkSession, scores, "point int, params string, macro_f1 double")
    return FittedClassifier(kind, found.bestModel, n_classes, kernels[best]), table


def retrain_and_score(
    train: DataFrame, extra: DataFrame | None, holdout: DataFrame, kinds: dict[str, dict] | None = None, seed: int = 42
) -> DataFrame:
    """Fit every kind on train plus extra rows (feature space); macro metrics on the holdout."""
    kinds = {k: {} for k in KINDS} if kinds is None else kinds
    rows = train.select("features", "y")
    if extra is not None:
        rows = rows.unionByName(extra.select("features", "y"))
    rows = rows.persist()
    models = {kind: fit_classifier(rows, kind, params, seed) for kind, params in kinds.items()}
    rows.unpersist()
    parts = [m.evaluate(holdout).select(F.lit(kind).alias("model"), "*") for kind, m in models.items()]
    return reduce(DataFrame.unionByName, parts)

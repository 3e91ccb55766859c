"""Supervised models on ``spark.ml``, with parameters scaled to the usual objectives.

A prepared table has ``features`` (vector) and ``label`` (double).  Every fitted
model here and in the sibling modules offers ``predict(df)``, ``importance()`` and
``save(path)``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    LinearRegression,
    LinearRegressionModel,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .trees import TreeModel, fit_trees

# Parameters offered per model, with the values offered for each.
CLASSIFIER_PARAMETERS: dict[str, dict[str, list]] = {
    "decision_tree": {
        "max_depth": [3, 5, 10, 15, 20, None],
        "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 5],
    },
    "random_forest": {
        "n_estimators": [50, 100, 200, 300],
        "max_depth": [3, 5, 10, 15, 20, None],
        "min_samples_split": [2, 5, 10],
    },
    "logistic_regression": {"C": [0.1, 1.0, 10.0, 100.0], "solver": ["liblinear", "lbfgs"]},
    "svm": {"C": [0.1, 1.0, 10.0, 100.0], "kernel": ["linear"]},
    "knn": {"n_neighbors": [3, 5, 7, 10], "weights": ["uniform", "distance"]},
    "naive_bayes": {"var_smoothing": [1e-9, 1e-8, 1e-7, 1e-6]},
}
REGRESSOR_PARAMETERS: dict[str, dict[str, list]] = {
    "linear_regression": {"fit_intercept": [True, False]},
    "ridge_regression": {"alpha": [0.1, 1.0, 10.0, 100.0], "fit_intercept": [True, False]},
    "lasso_regression": {"alpha": [0.1, 1.0, 10.0, 100.0], "fit_intercept": [True, False]},
    "elastic_net": {
        "alpha": [0.1, 1.0, 10.0],
        "l1_ratio": [0.1, 0.5, 0.7, 0.9],
        "fit_intercept": [True, False],
    },
    "decision_tree_regressor": {
        "max_depth": [3, 5, 10, 15, 20, None],
        "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 5],
    },
    "random_forest_regressor": {
        "n_estimators": [50, 100, 200, 300],
        "max_depth": [3, 5, 10, 15, 20, None],
        "min_samples_split": [2, 5, 10],
    },
    "svr": {"C": [0.1, 1.0, 10.0, 100.0], "kernel": ["linear"]},
    "knn_regressor": {"n_neighbors": [3, 5, 7, 10], "weights": ["uniform", "distance"]},
}
# Defaults.
DEFAULTS = {
    "C": 1.0,
    "alpha": 1.0,
    "l1_ratio": 0.5,
    "fit_intercept": True,
    "max_depth": None,
    "min_samples_split": 2,
    "min_samples_leaf": 1,
    "n_estimators": 100,
    "n_neighbors": 5,
    "weights": "uniform",
    "var_smoothing": 1e-9,
    "solver": "lbfgs",
    "kernel": "linear",
}
LOGISTIC_MAX_ITER = 1000



# Offered parameters that the distributed estimators cannot follow: any other value
# than the default is refused, rather than stored with the model and ignored.
WITHOUT_EFFECT = {
    "solver": "the intercept is never penalised",
}


def model_parameters(model: str, params: dict[str, Any], strict: bool = False) -> dict[str, Any]:
    """Check names and values and fill in the defaults.

    ``strict`` also requires each value to be one of the offered ones.
    """
    offered = {**CLASSIFIER_PARAMETERS, **REGRESSOR_PARAMETERS}.get(model)
    if offered is None:
        raise ValueError(f"unknown model {model!r}")
    unknown = sorted(set(params) - set(offered))
    if unknown:
        raise ValueError(f"{model} has no parameter {', '.join(unknown)}")
    full = {name: params.get(name, DEFAULTS[name]) for name in offered}
    for name, value in full.items():
        if name in ("weights", "solver", "kernel") or strict:
            if value not in offered[name]:
                raise ValueError(f"{model}: {name} must be one of {offered[name]}, not {value!r}")
        elif name == "fit_intercept":
            if not isinstance(value, bool):
                raise ValueError(f"{model}: {name} must be true or false")
        elif name == "max_depth" and value is None:
            continue
        elif not isinstance(value, (int, float)) or isinstance(value, bool):
            raise ValueError(f"{model}: {name} must be a number, not {value!r}")
        elif name == "l1_ratio":
            if not 0 <= value <= 1:
                raise ValueError(f"{model}: {name} must lie between 0 and 1")
        elif name != "alpha" and value <= 0 or value < 0:
            raise ValueError(f"{model}: {name} must be positive")
    for name, reason in WITHOUT_EFFECT.items():
        if full.get(name, DEFAULTS[name]) != DEFAULTS[name]:
            raise ValueError(f"{model}: only {name}={DEFAULTS[name]!r} is supported, {reason}")
    return full


class Fitted(Protocol):
    """What every fitted model offers."""

    name: str

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` plus ``prediction`` and, where known, ``probability`` (array)."""

    def importance(self) -> list[float] | None: ...

    def save(self, path: str) -> None: ...


@dataclass
class SparkModel:
    """A fitted ``spark.ml`` model behind the common surface."""

    name: str
    model: Any

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        if "probability" in out.columns:
            out = out.withColumn("probability", vector_to_array("probability"))
        return out.drop("rawPrediction")

    def importance(self) -> list[float] | None:
        if self.name in REGRESSOR_PARAMETERS and hasattr(self.model, "coefficients"):
            return [float(x) for x in self.model.coefficients.toArray()]
        return None

    def linear_terms(self) -> tuple[list[float], float] | None:
        """Coefficients and intercept of a linear regression."""
        if self.name in REGRESSOR_PARAMETERS and hasattr(self.model, "coefficients"):
            return [float(x) for x in self.model.coefficients.toArray()], float(self.model.intercept)
        return None

    def save(self, path: str) -> None:
        self.model.write().save(path)

    @staticmethod
    def load(name: str, path: str) -> SparkModel:
        return SparkModel(name, _READERS[name].load(path))


_READERS = {
    "logistic_regression": LogisticRegressionModel,
    "linear_regression": LinearRegressionModel,
    "ridge_regression": LinearRegressionModel,
    "lasso_regression": LinearRegressionModel,
    "elastic_net": LinearRegressionModel,
}


TREES = ("decision_tree", "decision_tree_regressor", "random_forest", "random_forest_regressor")


def fit_tree_model(train: DataFrame, name: str, p: dict[str, Any], n_classes: int) -> TreeModel:
    """Fit a tree, or a forest of trees on drawn rows; classifying ones draw features too."""
    forest = name.startswith("random_forest")
    return fit_trees(
        train,
        name,
        n_classes if name in CLASSIFIER_PARAMETERS else 0,
        n_trees=int(p["n_estimators"]) if forest else 1,
        wanted="sqrt" if name == "random_forest" else "all",
        drawn=forest,
        max_depth=p["max_depth"],
        min_samples_split=p["min_samples_split"],
        min_samples_leaf=1 if forest else p["min_samples_leaf"],
    )


def _penalised(l1: float, l2: float, y_std: float, intercept: bool):
    """Linear regression for ``1/(2n)·SSE + l1·|w| + l2/2·|w|²``.

    ``spark.ml`` solves on a label divided by its sample deviation, which leaves
    the L1 weight as it is and asks for the L2 weight times that deviation.
    """
    l2 = l2 * y_std
    total = l1 + l2
    return LinearRegression(
        regParam=total,
        elasticNetParam=l1 / total if total else 0.0,
        standardization=False,
        fitIntercept=intercept,
        solver="l-bfgs" if total else "auto",
        maxIter=1000,
        tol=1e-10,
    )


def fit_spark_model(
    train: DataFrame, name: str, p: dict[str, Any], n_train: int, n_classes: int
) -> SparkModel | TreeModel:
    """Fit a tree model or one of the ``spark.ml`` backed models on ``features``/``label``."""
    if name in TREES:
        return fit_tree_model(train, name, p, n_classes)
    y_std = 1.0
    if name in ("ridge_regression", "elastic_net"):
        y_std = train.agg(F.stddev_samp("label")).first()[0] or 1.0
    if name == "logistic_regression":
        est = LogisticRegression(
            regParam=1.0 / (p["C"] * n_train),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=LOGISTIC_MAX_ITER,
            tol=1e-8,
        )
    elif name == "linear_regression":
        est = _penalised(0.0, 0.0, y_std, p["fit_intercept"])
    elif name == "ridge_regression":
        est = _penalised(0.0, p["alpha"] / n_train, y_std, p["fit_intercept"])
    elif name == "lasso_regression":
        est = _penalised(p["alpha"], 0.0, y_std, p["fit_intercept"])
    elif name == "elastic_net":
        est = _penalised(
            p["alpha"] * p["l1_ratio"], p["alpha"] * (1 - p["l1_ratio"]), y_std, p["fit_intercept"]
        )
    else:
        raise ValueError(f"{name!r} is not a spark.ml model")
    return SparkModel(name, est.fit(train))


# --- reports on fitted models --------------------------------------------------


def importance_table(spark: SparkSession, model: Fitted, features: Sequence[str]) -> DataFrame:
    """``(position, feature, importance)``: tree importances or linear coefficients."""
    values = model.importance() or []
    rows = [(i, f, v) for i, (f, v) in enumerate(zip(features, values))]
    return spark.createDataFrame(rows, "position int, feature string, importance double")


def top_importance(importance: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest by absolute value (10, 15 and 20 are the usual reports)."""
    return importance.orderBy(F.abs("importance").desc(), "position").limit(k)


def coefficient_table(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    """``(position, term, coefficient)`` with the intercept as term 0."""
    coefficients, intercept = model.linear_terms()
    rows = [(0, "(intercept)", intercept)]
    rows += [(i + 1, f, c) for i, (f, c) in enumerate(zip(features, coefficients))]
    return spark.createDataFrame(rows, "position int, term string, coefficient double")


def equation(coefficients: DataFrame, target: str) -> DataFrame:
    """The fitted line as text: ``target = b + w x1 - v x2``."""
    sign = F.when(F.col("coefficient") < 0, " - ").otherwise(" + ")
    piece = F.when(
        F.col("position") == 0, F.format_string("%.4f", "coefficient")
    ).otherwise(F.concat(sign, F.format_string("%.4f × %s", F.abs("coefficient"), "term")))
    ordered = coefficients.select("position", piece.alias("piece")).groupBy().agg(
        F.array_sort(F.collect_list(F.struct("position", "piece"))).alias("p")
    )
    return ordered.select(F.concat(F.lit(f"{target} = "), F.array_join(F.col("p.piece"), "")).alias("equation"))


def write_json(spark: SparkSession, record: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(record),)], "record string").coalesce(1).write.text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])

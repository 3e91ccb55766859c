"""From a table to a trained, evaluated and storable model."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.columns import quoted
from ..functions.names import Task, tidy_columns
from ..operators.evaluate import classification_metrics, regression_metrics
from ..operators.margins import fit_svc, fit_svr
from ..operators.models import (
    CLASSIFIER_PARAMETERS,
    REGRESSOR_PARAMETERS,
    Fitted,
    fit_spark_model,
    importance_table,
    model_parameters,
)
from ..operators.naive_bayes import fit_naive_bayes
from ..operators.neighbors import fit_neighbors
from ..operators.prepare import Preparation, check_complete, fit_preparation
from ..operators.retrain import align_records, append_records, stored_kinds
from ..operators.score import as_metric_table, row_key
from ..operators.split import SEED, Split, train_test_split

# Rows a task should have in an iterative fit, and the size up to which one shuffle
# for it is cheap.  Larger tables keep the partitions of their input splits.
ROWS_PER_TASK = 25_000
BALANCE_ROWS = 10_000_000


@dataclass
class TrainedModel:
    """A fitted model with its preparation, split and metrics."""

    task: Task
    model: str
    params: dict[str, Any]
    preparation: Preparation
    fitted: Fitted
    split: Split
    key: list[str]
    file_used: str | None = None
    lineage: dict[str, Any] = field(default_factory=dict)
    held: list[DataFrame] = field(default_factory=list)

    @cached_property
    def metrics(self) -> dict[str, float | None]:
        """Sizes and both sides' scores, measured when first asked for."""
        measure = classification_metrics if self.task.kind == "classification" else regression_metrics
        out: dict[str, float | None] = {
            "train_size": self.split.n_train,
            "test_size": self.split.n_test,
        }
        for part, rows in (("train", self.split.train), ("test", self.split.test)):
            out.update(measure(self.fitted.predict(rows), part))
        return out

    def close(self) -> None:
        """Release the rows kept for the fit; predictions and metrics compute them anew."""
        for rows in self.held:
            rows.unpersist()

    def metric_table(self) -> DataFrame:
        return as_metric_table(self.metrics, self.preparation.codes.sparkSession)

    def importance(self) -> DataFrame:
        return importance_table(
            self.preparation.codes.sparkSession, self.fitted, self.preparation.features
        )

    def metadata(self) -> dict[str, Any]:
        """The record stored next to the model."""
        return {
            "model_type": self.model,
            "task_type": self.task.kind,
            "target_column": self.task.target,
            "feature_columns": self.preparation.features,
            "key_columns": self.key,
            "n_features": len(self.preparation.features),
            "n_classes": self.preparation.n_classes,
            "file_used": self.file_used,
            "model_params": json.dumps(self.params),
            "metrics": {k: v for k, v in self.metrics.items() if v is not None},
            "preparation_info": self.preparation.feature_types(),
            **self.lineage,
        }


def fit_model(train: DataFrame, model: str, params: dict[str, Any], n_train: int, n_classes: int) -> Fitted:
    """Fit ``model`` on ``__id``/``features``/``label`` rows."""
    if model == "naive_bayes":
        return fit_naive_bayes(train, params["var_smoothing"])
    if model in ("knn", "knn_regressor"):
        return fit_neighbors(
            train, int(params["n_neighbors"]), params["weights"], model == "knn_regressor", n_classes
        )
    if model == "svr":
        return fit_svr(train, params["C"])
    if model == "svm":
        return fit_svc(train, params["C"], n_classes)
    return fit_spark_model(train, model, params, n_train, n_classes)


def _tasks(n: int) -> int | None:
    """Even partitions for small and middling tables, which often sit in one file."""
    return None if n > BALANCE_ROWS else max(1, math.ceil(n / ROWS_PER_TASK))


def train(
    df: DataFrame,
    target: str,
    predictors: Sequence[str],
    model: str,
    key: Sequence[str] | None = None,
    seed: int = SEED,
    strict: bool = False,
    file_used: str | None = None,
    **params: Any,
) -> TrainedModel:
    """Prepare, split and fit; the metrics are measured when they are asked for.

    ``key`` names the columns that identify a row; the split depends on them and the
    seed only.  Without a key, rows are numbered and the numbering is checkpointed.
    The prepared vectors are persisted while the split is found, the flagged rows while
    the model is fitted and measured; ``close()`` on the result releases both.
    """
    kind = "classification" if model in CLASSIFIER_PARAMETERS else "regression"
    if kind == "regression" and model not in REGRESSOR_PARAMETERS:
        raise ValueError(f"unknown model {model!r}")
    full = model_parameters(model, params, strict)
    data = row_key(tidy_columns(df), key)
    preparation = fit_preparation(data, target, predictors, kind)
    task = preparation.task
    prepared = preparation.transform(data.select("__id", *[quoted(c) for c in task.columns]))
    tasks = _tasks(data.count())
    vectors = preparation.assemble(prepared, ["__id"])
    if tasks:
        vectors = vectors.repartition(tasks, "__id")
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    split = train_test_split(vectors, ["__id"], "label" if kind == "classification" else None, seed)
    flagged = split.data.coalesce(tasks) if tasks else split.data
    split.data = flagged.persist(StorageLevel.MEMORY_AND_DISK)
    fitted = fit_model(split.train, model, full, split.n_train, preparation.n_classes)
    out = TrainedModel(task, model, full, preparation, fitted, split, list(key or []), file_used)
    out.held = [vectors, split.data]
    return out


def check_prepared(df: DataFrame, preparation: Preparation) -> DataFrame:
    """Prepared rows, after checking that nothing is missing any more."""
    out = preparation.transform(tidy_columns(df))
    return check_complete(out, [*preparation.features, "label"])


def retrain(
    original: DataFrame,
    records: DataFrame,
    meta: dict[str, Any],
    key: Sequence[str] | None = None,
    seed: int = SEED,
) -> TrainedModel:
    """Train again on the stored rows and new records, with the stored parameters."""
    columns = [meta["target_column"], *meta["feature_columns"]]
    kinds = stored_kinds(original, columns)
    aligned = align_records(records, kinds)
    combined = append_records(original, aligned, kinds)
    params = json.loads(meta["model_params"]) if meta.get("model_params") else {}
    out = train(
        combined,
        meta["target_column"],
        meta["feature_columns"],
        meta["model_type"],
        key,
        seed,
        file_used=meta.get("file_used"),
        **params,
    )
    before, added = original.count(), records.count()
    out.lineage = {
        "retrained_from": meta["model_name"],
        "original_records": before,
        "new_records_added": added,
        "total_records": before + added,
    }
    return out


def predictions(trained: TrainedModel, part: str = "test") -> DataFrame:
    """``__id``, ``label`` and ``prediction`` of one side of the split."""
    rows = trained.split.test if part == "test" else trained.split.train
    return trained.fitted.predict(rows).select(F.col("__id"), "label", "prediction")

"""Stored models: artefact, preparation and one metadata record each.

Layout below the registry folder: ``<name>/metadata`` (one JSON record) and
``<name>/artefact`` (model and preparation).
"""

from __future__ import annotations

import json
import re
from datetime import datetime
from itertools import chain, count
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.margins import LinearSVC, LinearSVR
from ..operators.models import TREES, SparkModel
from ..operators.naive_bayes import GaussianNaiveBayes
from ..operators.neighbors import Neighbors
from ..operators.prepare import Preparation
from ..operators.trees import TreeModel

METADATA_SCHEMA = (
    "model_name string, model_type string, task_type string, created_at string, status string,"
    " target_column string, feature_columns array<string>, key_columns array<string>,"
    " n_features int, n_classes int, file_used string,"
    " model_params string, metrics map<string,double>, preparation_info map<string,string>,"
    " retrained_from string, original_records bigint, new_records_added bigint, total_records bigint"
)
# Time stamp of default names, and the listed date.
STAMP = "%Y%m%d_%H%M%S"
LISTED_DATE = "dd/MM/yyyy HH:mm"


def registry_name(name: str | None, model: str, kind: str, now: datetime) -> str:
    """Keep letters, digits, ``_`` and ``-``; an empty name becomes model, task and time."""
    kept = re.sub(r"[^\w-]", "", name or "")
    return kept or f"{model}_{kind}_{now.strftime(STAMP)}"


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
        return True
    except AnalysisException:
        return False


def _claimed(spark: SparkSession, path: str) -> bool:
    """Take a name by creating its claim file, which succeeds for one writer only."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/claim")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(place)


def save_model(spark: SparkSession, root: str, trained: Any, name: str | None = None, now: datetime | None = None) -> str:
    """Write a trained model below ``root`` and return the name it got.

    A taken name gets the time behind it, and a number if that is taken too.
    """
    now = now or datetime.now()
    plain = registry_name(name, trained.model, trained.task.kind, now)
    stamped = f"{plain}_{now.strftime(STAMP)}"
    final = next(
        n
        for n in chain([plain, stamped], (f"{stamped}_{k}" for k in count(2)))
        if not _exists(spark, f"{root}/{n}/metadata") and _claimed(spark, f"{root}/{n}")
    )
    base = f"{root}/{final}"
    trained.fitted.save(f"{base}/artefact/model")
    trained.preparation.save(f"{base}/artefact/preparation")
    record = {"model_name": final, "created_at": now.isoformat(), "status": "complete", **trained.metadata()}
    spark.createDataFrame([(json.dumps(record),)], "record string").coalesce(1).write.text(f"{base}/metadata")
    return final


def load_metadata(spark: SparkSession, root: str, name: str) -> dict:
    row = spark.read.schema(METADATA_SCHEMA).json(f"{root}/{name}/metadata").first()
    return row.asDict(recursive=True)


def load_model(spark: SparkSession, root: str, name: str):
    """``(fitted model, preparation, metadata)`` of a stored model."""
    meta = load_metadata(spark, root, name)
    base = f"{root}/{name}/artefact"
    kind = meta["model_type"]
    path = f"{base}/model"
    if kind in ("knn", "knn_regressor"):
        fitted = Neighbors.load(spark, path)
    elif kind == "naive_bayes":
        fitted = GaussianNaiveBayes.load(spark, path)
    elif kind in TREES:
        fitted = TreeModel.load(spark, kind, path)
    elif kind == "svr":
        fitted = LinearSVR.load(spark, path)
    elif kind == "svm":
        fitted = LinearSVC.load(spark, path)
    else:
        fitted = SparkModel.load(kind, path)
    return fitted, Preparation.load(spark, f"{base}/preparation"), meta


def list_models(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of the models whose artefact is there, newest first.

    Sizes come from listing the files; their content is not read.
    """
    try:
        records = spark.read.schema(METADATA_SCHEMA).json(f"{root}/*/metadata")
        files = (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/*/artefact")
        )
    except AnalysisException:
        return spark.createDataFrame([], f"{METADATA_SCHEMA}, model_size_mb double, created_at_formatted string")
    sizes = files.select(
        F.regexp_extract("path", r"([^/]+)/artefact/", 1).alias("model_name"), "length"
    ).groupBy("model_name").agg(F.round(F.sum("length") / F.lit(1024 * 1024), 2).alias("model_size_mb"))
    return (
        records.join(sizes, "model_name")
        .withColumn(
            "created_at_formatted",
            F.coalesce(F.date_format(F.col("created_at").try_cast("timestamp"), LISTED_DATE), "created_at"),
        )
        .orderBy(F.desc("created_at"), "model_name")
    )

"""Appending new records to the training data, and comparing two models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, nan_to_null, numeric_columns
from ..functions.statistics import wide_aggregate
from .prepare import coerce_numeric

# Compared metrics, those where less is better, and the tolerance.
CLASSIFICATION_METRICS = ["test_accuracy", "test_precision_macro", "test_recall_macro", "test_f1_macro"]
REGRESSION_METRICS = ["test_r2", "test_mse", "test_mae"]
LESS_IS_BETTER = ["test_mse", "test_mae"]
TOLERANCE = 0.0001


def stored_kinds(original: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """``numeric`` when every value of a column converts, ``text`` when not, ``unknown`` without values.

    Columns that are numeric by type need no look at the rows.
    """
    data = nan_to_null(original)
    by_type = set(numeric_columns(data))
    exprs = {}
    for c in columns:
        if c in data.columns:
            exprs["n" + c] = F.count(col(c))
            if c not in by_type:
                exprs["bad" + c] = F.count_if(
                    col(c).isNotNull() & coerce_numeric(col(c).cast("string")).isNull()
                )
    facts = wide_aggregate(data, exprs) if exprs else {}
    kinds = {}
    for c in columns:
        if c not in data.columns:
            continue
        if not facts["n" + c]:
            kinds[c] = "unknown"
        else:
            kinds[c] = "numeric" if c in by_type or not facts["bad" + c] else "text"
    return kinds


def align_records(records: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """New records with the stored types; values that do not convert become null."""
    out = []
    for c in records.columns:
        if kinds.get(c) == "numeric":
            out.append(coerce_numeric(col(c)).alias(c))
        elif kinds.get(c) == "text":
            out.append(col(c).cast("string").alias(c))
        else:
            out.append(col(c))
    return records.select(*out)


def append_records(original: DataFrame, records: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Original rows and new rows; columns one side lacks are null there."""
    if kinds:
        original = align_records(original, {c: k for c, k in kinds.items() if k == "numeric"})
    return original.unionByName(records, allowMissingColumns=True)


def compare_metrics(old: DataFrame, new: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per metric: both values, the improvement and a verdict.

    Missing values count as zero.  ``metrics`` lists what to compare.
    """
    names = old.sparkSession.createDataFrame(
        [(i, m) for i, m in enumerate(metrics)], "position int, metric string"
    )
    joined = (
        names.join(old.select("metric", F.col("value").alias("old_value")), "metric", "left")
        .join(new.select("metric", F.col("value").alias("new_value")), "metric", "left")
        .fillna(0.0, ["old_value", "new_value"])
    )
    change = F.col("new_value") - F.col("old_value")
    gain = F.when(F.col("metric").isin(LESS_IS_BETTER), -change).otherwise(change)
    return joined.withColumn("improvement", gain).withColumn(
        "verdict",
        F.when(F.col("improvement") > TOLERANCE, "better")
        .when(F.col("improvement") < -TOLERANCE, "worse")
        .when(F.col("improvement") == 0, "identical")
        .otherwise("minimal"),
    )

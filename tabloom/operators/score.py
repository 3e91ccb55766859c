"""Batch scoring with a fitted model and its preparation."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, quoted
from ..functions.names import tidy_columns
from ..functions.sizing import cut_lineage, join_by_size
from .models import Fitted
from .prepare import Preparation, feature_kind

# Output column names and limits.
PREDICTION = "Prediccion"
PREDICTION_CODE = "Prediccion_Numerica"
LOWER = "Confianza_Inferior"
UPPER = "Confianza_Superior"
CONFIDENCE = "Confianza"
PROBABILITY_PREFIX = "Prob_"
PROBABILITY_CLASSES = 10
FEW_ROWS = 5


def row_key(df: DataFrame, key: Sequence[str] | None) -> DataFrame:
    """Add ``__id``: the key column, the joined key columns, or a fixed row number.

    Separators inside joined parts are escaped and missing parts marked, so that different
    keys never give the same text.  Row numbers depend on how the input is split, so
    they are checkpointed before use.
    """
    if not key:
        return cut_lineage(df.withColumn("__id", F.monotonically_increasing_id()))
    if len(key) == 1:
        return df.withColumn("__id", col(key[0]))
    parts = [col(k).cast("string") for k in key]
    escaped = [F.coalesce(F.regexp_replace(p, r"([\\|])", r"\\$1"), F.lit(r"\N")) for p in parts]
    return df.withColumn("__id", F.concat_ws("|", *escaped))


def check_compatibility(df: DataFrame, preparation: Preparation) -> DataFrame:
    """One row: missing features, type warnings, too few rows.

    Everything but the row test reads the schema; that test reads five rows at most.
    """
    df = tidy_columns(df)
    types = {f.name: feature_kind(f.dataType) for f in df.schema}
    features = preparation.features
    missing = [f for f in features if f not in types]
    warnings = []
    for f in features:
        expected = "categorical" if preparation.kinds[f] == "text" else "numeric"
        actual = types.get(f)
        if expected == "numeric" and actual == "text":
            warnings.append(f"'{f}' should be numeric but is categorical")
        elif expected == "categorical" and actual == "numeric":
            warnings.append(f"'{f}' should be categorical but is numeric")
    few = df.limit(FEW_ROWS).count()
    return df.sparkSession.createDataFrame(
        [
            (
                not missing,
                ", ".join(missing),
                "; ".join(warnings),
                f"only {few} rows; at least {FEW_ROWS} are recommended" if few < FEW_ROWS else None,
                len(features),
                len(df.columns),
            )
        ],
        "compatible boolean, missing_columns string, type_warnings string, few_rows_warning string,"
        " required_columns int, available_columns int",
    )


def _predict(df: DataFrame, model: Fitted, preparation: Preparation, key, impute_from: str) -> DataFrame:
    """Predictions next to the untouched input row (``__row``)."""
    keyed = row_key(df, key) if model.name in ("knn", "knn_regressor") else df.withColumn("__id", F.lit(0))
    staged = keyed.select(
        F.struct(*[quoted(c) for c in df.columns]).alias("__row"),
        "__id",
        *[quoted(f) for f in preparation.features],
    )
    ready = preparation.assemble(preparation.transform_features(staged, impute_from), ["__row", "__id"])
    return model.predict(ready)


def raw_predictions(
    df: DataFrame,
    model: Fitted,
    preparation: Preparation,
    key: Sequence[str] | None = None,
    impute_from: str = "training",
) -> DataFrame:
    """``__row`` (the input), ``prediction``, and for classes ``__label`` and ``probability``."""
    out = _predict(tidy_columns(df), model, preparation, key, impute_from)
    if preparation.task.kind == "regression":
        return out.select("__row", "prediction")
    labels = preparation.class_labels().select(
        F.col("code").cast("double").alias("prediction"), F.col("value").alias("__label")
    )
    out = join_by_size(out, labels, "prediction", "left", preparation.n_classes)
    known = ["probability"] if "probability" in out.columns else []
    return out.select("__row", "prediction", "__label", *known)


def present_regression(raw: DataFrame) -> DataFrame:
    """Input columns, prediction, and a band of one population deviation of all predictions."""
    # Predictions are made once: the deviation of the batch, which is one number, and the
    # output both read the written ones.
    raw = cut_lineage(raw)
    spread = raw.agg(F.stddev_pop("prediction")).first()[0]
    return raw.select(
        "__row.*",
        F.col("prediction").alias(PREDICTION),
        (F.col("prediction") - F.lit(spread)).alias(LOWER),
        (F.col("prediction") + F.lit(spread)).alias(UPPER),
    )


def present_classes(raw: DataFrame, preparation: Preparation) -> DataFrame:
    """Input columns, code, label, confidence in percent, and per-class probabilities when few."""
    extra = []
    if "probability" in raw.columns:
        extra.append(F.round(F.array_max("probability") * 100, 2).alias(CONFIDENCE))
        if preparation.n_classes <= PROBABILITY_CLASSES:
            names = sorted((r["code"], r["value"]) for r in preparation.class_labels().collect())
            extra += [
                F.round(F.get("probability", F.lit(code)) * 100, 2).alias(f"{PROBABILITY_PREFIX}{value}")
                for code, value in names
            ]
    return raw.select(
        "__row.*",
        F.col("prediction").cast("int").alias(PREDICTION_CODE),
        F.col("__label").alias(PREDICTION),
        *extra,
    )


def score(
    df: DataFrame,
    model: Fitted,
    preparation: Preparation,
    key: Sequence[str] | None = None,
    impute_from: str = "training",
) -> DataFrame:
    """The input plus predictions, in the output form of its task."""
    raw = raw_predictions(df, model, preparation, key, impute_from)
    if preparation.task.kind == "regression":
        return present_regression(raw)
    return present_classes(raw, preparation)


def regression_statistics(raw: DataFrame) -> DataFrame:
    return raw.agg(
        F.count("prediction").alias("total_predictions"),
        F.avg("prediction").alias("prediction_mean"),
        F.stddev_pop("prediction").alias("prediction_std"),
        F.min("prediction").alias("prediction_min"),
        F.max("prediction").alias("prediction_max"),
    )


def classification_statistics(raw: DataFrame) -> DataFrame:
    """Counts, and the mean of the unrounded confidences in percent."""
    known = "probability" in raw.columns
    mean = F.round(F.avg(F.array_max("probability")) * 100, 2) if known else F.lit(None).cast("double")
    return raw.agg(
        F.count("prediction").alias("total_predictions"),
        F.count_distinct("prediction").alias("unique_predictions"),
        mean.alias("avg_confidence"),
    )


def prediction_distribution(scored: DataFrame) -> DataFrame:
    """Count and share (one decimal) per predicted class."""
    counts = scored.groupBy(col(PREDICTION).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    # One row per class: the window is over the counted classes.
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("prediction", "n", F.round(F.col("n") * 100.0 / total, 1).alias("pct"))


def class_mapping(preparation: Preparation) -> DataFrame:
    return preparation.class_labels().select("code", F.col("value").alias("class"))


def as_metric_table(metrics: dict[str, Any], spark) -> DataFrame:
    return spark.createDataFrame(
        [(k, None if v is None else float(v)) for k, v in metrics.items()], "metric string, value double"
    )

"""Target analysis: profile, task compatibility, recommendation, availability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, nan_to_null, numeric_columns, rows_from_aggregate
from ..functions.statistics import distinct_counts, smallest_values

# Distinct-value limits of the compatibility rules.
CATEGORICAL_MAX = 20
DISCRETE_MAX = 10
CLASSIFICATION_MAX = 50
CLASSIFICATION_MIN = 2
FEW_VALUES = 5
REGRESSION_OVER = 10
SAMPLE_VALUES = 10


def target_profile(df: DataFrame, columns: Sequence[str] | None = None, exact_distinct: bool = True) -> DataFrame:
    """Counts, type, distinct values and a value sample for each candidate column.

    The sample is the ten smallest distinct values.  With ``exact_distinct=False``
    key-like columns keep a sketched distinct count; every threshold below is far
    under the size at which that happens.
    """
    data = nan_to_null(df)
    columns = list(columns) if columns is not None else data.columns
    numeric = set(numeric_columns(data))
    kinds = dict(data.dtypes)
    exprs = []
    for i, c in enumerate(columns):
        v = col(c)
        whole = (
            F.bool_and(v.cast("double") == F.floor(v.cast("double")))
            if c in numeric
            else F.bool_and(F.lit(False))
        )
        exprs += [
            F.count(F.lit(1)).alias(f"__{i}_total_values"),
            F.count(v).alias(f"__{i}_valid_values"),
            F.max(F.lit(kinds[c])).alias(f"__{i}_data_type"),
            F.coalesce(F.max(F.lit(c in numeric)), F.lit(c in numeric)).alias(f"__{i}_is_numeric"),
            F.coalesce(whole, F.lit(False)).alias(f"__{i}_whole"),
        ]
    facts = rows_from_aggregate(
        data.agg(*exprs),
        columns,
        [
            ("total_values", "bigint"),
            ("valid_values", "bigint"),
            ("data_type", "string"),
            ("is_numeric", "boolean"),
            ("whole", "boolean"),
        ],
    )
    # Both sides have one row per column.
    sample = F.broadcast(smallest_values(data, columns, SAMPLE_VALUES))
    distinct = F.broadcast(distinct_counts(data, columns, exact_distinct))
    return (
        facts.join(distinct, "column_name")
        .join(sample, "column_name", "left")
        .withColumn("missing_values", F.col("total_values") - F.col("valid_values"))
    )


def target_compatibility(profile: DataFrame) -> DataFrame:
    """Which tasks a column supports, and why not.

    A column without valid values supports nothing.
    """
    n = F.col("distinct_values")
    numeric = F.col("is_numeric")
    valid = F.col("valid_values") > 0
    categorical = ~numeric | (n <= CATEGORICAL_MAX)
    discrete = numeric & F.col("whole") & (n <= DISCRETE_MAX)
    too_many = ~categorical & (n > CLASSIFICATION_MAX)
    too_few = n < CLASSIFICATION_MIN
    class_notes = F.concat_ws(
        ". ",
        F.when(
            too_many,
            F.format_string(f"Too many unique categories (%d). Recommended maximum: {CATEGORICAL_MAX}", n),
        ),
        F.when(too_few, F.lit(f"At least {CLASSIFICATION_MIN} different categories are needed")),
    )
    reg_notes = F.concat_ws(
        ". ",
        F.when(~numeric, F.lit("The target must be numeric for regression")),
        F.when(numeric & (n == 1), F.lit("All values are equal, there is nothing to predict")),
        F.when(
            numeric & (n < FEW_VALUES),
            F.format_string("Few unique values (%d). Consider classification", n),
        ),
    )
    return (
        profile.withColumn("is_categorical", categorical)
        .withColumn("is_discrete", discrete)
        .withColumn("classification_compatible", valid & ~too_many & ~too_few)
        .withColumn("regression_compatible", valid & numeric & (n != 1))
        .withColumn("classification_notes", F.when(valid, class_notes).otherwise(F.lit("No valid values")))
        .withColumn("regression_notes", F.when(valid, reg_notes).otherwise(F.lit("No valid values")))
    )


def target_recommendation(compatibility: DataFrame) -> DataFrame:
    """The task to prefer for each column."""
    both = F.col("classification_compatible") & F.col("regression_compatible")
    many = F.col("is_numeric") & (F.col("distinct_values") > REGRESSION_OVER)
    return compatibility.withColumn(
        "recommendation",
        F.when(both & many, "regression")
        .when(F.col("classification_compatible"), "classification")
        .when(F.col("regression_compatible"), "regression")
        .otherwise("none"),
    ).withColumn(
        "reason",
        F.when(both & many, "continuous numeric column with many values")
        .when(both, "categorical or discrete column")
        .when(F.col("classification_compatible"), "only classification is possible")
        .when(F.col("regression_compatible"), "only regression is possible")
        .otherwise("no model type is possible"),
    )


def _status(task: str):
    return (
        F.when(~F.col(f"{task}_compatible"), "unavailable")
        .when(F.col("recommendation") == task, "recommended")
        .otherwise("available")
    )


def target_availability(recommendation: DataFrame) -> DataFrame:
    """Status and message per task, plus a one-line summary per column."""
    n = F.col("distinct_values")
    summary = F.concat(
        F.format_string("Column '%s': %d unique values ", "column_name", n),
        F.when(F.col("is_numeric"), F.format_string("(numeric - %s)", "data_type")).otherwise("(categorical/text)"),
        F.when(F.col("missing_values") > 0, F.format_string(". %d missing values", "missing_values")).otherwise(""),
    )
    out = recommendation.withColumn("classification_status", _status("classification")).withColumn(
        "regression_status", _status("regression")
    )
    return (
        out.withColumn(
            "classification_message",
            F.when(
                F.col("classification_status") == "unavailable",
                F.concat(F.lit("Not suitable for classification: "), F.col("classification_notes")),
            )
            .when(
                F.col("classification_status") == "recommended",
                F.format_string("Recommended for classification (%d categories)", n),
            )
            .otherwise(F.format_string("Suitable for classification (%d categories)", n)),
        )
        .withColumn(
            "regression_message",
            F.when(
                F.col("regression_status") == "unavailable",
                F.concat(F.lit("Not suitable for regression: "), F.col("regression_notes")),
            )
            .when(
                F.col("regression_status") == "recommended",
                F.lit("Recommended for regression (continuous numeric column)"),
            )
            .when(
                F.col("regression_notes") != "",
                F.concat(
                    F.lit("Suitable for regression, classification is preferred. "), F.col("regression_notes")
                ),
            )
            .otherwise(F.lit("Suitable for regression, classification is preferred")),
        )
        .withColumn("summary", summary)
    )


def analyze_targets(
    df: DataFrame, columns: Sequence[str] | None = None, exact_distinct: bool = True
) -> DataFrame:
    """The full analysis of every candidate column in one job."""
    profile = target_profile(df, columns, exact_distinct)
    return target_availability(target_recommendation(target_compatibility(profile)))

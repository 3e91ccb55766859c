"""Evaluation: aggregates over ``label`` and ``prediction``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col

# Quality bands of R² and the overfit gap.
R2_BANDS = [(0.8, "excellent"), (0.6, "good"), (0.3, "fair")]
R2_LOWEST = "poor"
OVERFIT_GAP = 0.1
SAMPLE_ROWS = 10


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("accuracy"),
    )


def confusion_counts(df: DataFrame) -> DataFrame:
    """``(label, prediction, n)`` for the pairs that occur: the basis of all class metrics."""
    return df.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame) -> DataFrame:
    """All pairs of labels seen in truth or prediction, zeros included.

    Works on the counted pairs, which are at most classes² rows; every label is
    paired with the array of labels instead of a join of two tables.
    """
    counts = confusion_counts(df)
    seen = counts.select(F.col("label").alias("c")).unionAll(counts.select(F.col("prediction").alias("c"))).distinct()
    grid = seen.groupBy().agg(F.array_sort(F.collect_set("c")).alias("classes"))
    grid = grid.select(F.explode("classes").alias("label"), "classes").select(
        "label", F.explode("classes").alias("prediction")
    )
    return grid.join(counts, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).alias("n")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_report(df: DataFrame) -> DataFrame:
    """Per class: precision, recall, F1 and support, zero on empty denominators."""
    counts = confusion_counts(df)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), hit.alias("h")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")),
            )
        )
    )
    totals = sides.groupBy("class").agg(
        F.sum("h").alias("hits"), F.sum("p").alias("predicted"), F.sum("s").alias("support")
    )
    return (
        totals.withColumn("precision", _ratio(F.col("hits"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("hits"), F.col("support")))
        .withColumn("f1", _ratio(2.0 * F.col("hits"), F.col("predicted") + F.col("support")))
        .select("class", "precision", "recall", "f1", "support")
    )


def averaged_report(df: DataFrame) -> DataFrame:
    """Accuracy, macro and support-weighted averages over the class report."""
    report = class_report(df)
    total = F.sum("support")
    wide = report.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
        total.alias("support"),
    )
    rows = [
        F.struct(
            F.lit(f"{kind} avg").alias("average"),
            *[F.col(f"{kind}_{m}").alias(m) for m in ("precision", "recall", "f1")],
            F.col("support").alias("support"),
        )
        for kind in ("macro", "weighted")
    ]
    # Support-weighted recall is the accuracy.
    hit = F.struct(
        F.lit("accuracy").alias("average"),
        *[F.col("weighted_recall").alias(m) for m in ("precision", "recall", "f1")],
        F.col("support").alias("support"),
    )
    return wide.select(F.inline(F.array(hit, *rows)))


def macro_micro(df: DataFrame) -> DataFrame:
    """Macro and micro precision, recall and F1 in one row.

    With one label per row the micro figures all equal the accuracy.
    """
    report = class_report(df)
    micro = F.sum(F.col("recall") * F.col("support")) / F.sum("support")
    return report.agg(
        *[F.avg(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")],
        *[micro.alias(f"{m}_micro") for m in ("precision", "recall", "f1")],
    )


def classification_metrics(df: DataFrame, part: str) -> dict[str, float]:
    """The metric dictionary of one side of the split."""
    row = macro_micro(df).first()
    return {
        f"{part}_accuracy": row["recall_micro"],
        **{f"{part}_{k}": row[k] for k in row.asDict()},
    }


def regression_report(df: DataFrame) -> DataFrame:
    """MSE, RMSE, MAE and R² in one row; R² of a single row is null.

    R² needs the label's variance, which comes with the same pass.
    """
    error = F.col("label") - F.col("prediction")
    facts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop("label").alias("var"),
    )
    return facts.select(
        "n",
        "mse",
        F.sqrt("mse").alias("rmse"),
        "mae",
        F.when(
            F.col("n") > 1,
            F.when(F.col("var") > 0, 1.0 - F.col("mse") / F.col("var"))
            .when(F.col("mse") == 0, 1.0)
            .otherwise(0.0),
        ).alias("r2"),
    )


def regression_metrics(df: DataFrame, part: str) -> dict[str, float]:
    row = regression_report(df).first()
    return {f"{part}_{k}": row[k] for k in ("mse", "rmse", "mae", "r2")}


def prediction_sample(df: DataFrame, key: Sequence[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows by key with true and predicted value."""
    return df.orderBy(*[col(k) for k in key]).limit(rows).select(*[col(k) for k in key], "label", "prediction")


def training_summary(split) -> DataFrame:
    """Sizes, class counts, removed classes and stratification of a split."""
    return split.data.sparkSession.createDataFrame(
        [
            (
                split.original_rows,
                split.original_classes,
                split.n_rows,
                split.n_classes,
                split.n_train,
                split.n_test,
                split.original_classes - split.n_classes,
                split.stratified,
            )
        ],
        "original_rows bigint, original_classes bigint, rows bigint, classes bigint, train_size bigint,"
        " test_size bigint, classes_removed bigint, stratified boolean",
    )


def quality_band(df: DataFrame) -> DataFrame:
    """Band of ``test_r2`` and overfit flag against ``train_r2``."""
    band = F.lit(R2_LOWEST)
    for limit, name in reversed(R2_BANDS):
        band = F.when(F.col("test_r2") >= limit, name).otherwise(band)
    return df.withColumn("band", F.when(F.col("test_r2").isNotNull(), band)).withColumn(
        "overfit", F.coalesce(F.col("train_r2") - F.col("test_r2") > OVERFIT_GAP, F.lit(False))
    )

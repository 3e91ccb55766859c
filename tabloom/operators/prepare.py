"""Feature preparation: coercion, imputation, encoding, target statistics."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, nan_to_null, null_count, quoted
from ..functions.names import Task, select_task, tidy_columns
from ..functions.sizing import SMALL_ROWS, cut_lineage, join_by_size
from ..functions.statistics import exact_quantiles, most_frequent, value_counts, wide_aggregate

# Histogram sizing of a regression target.
HISTOGRAM_EACH_VALUE = 10
HISTOGRAM_MAX_BINS = 20


def split_by_kind(df: DataFrame) -> DataFrame:
    """Each column with its role in preparation: numeric, text, or other."""
    rows = [(i, f.name, feature_kind(f.dataType)) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, kind string")


def feature_kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "text"


def coerce_numeric(c: Column) -> Column:
    """Numeric reading of a value; what does not parse becomes null."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(col(target).isNotNull())


# --- codes ------------------------------------------------------------------


def code_table(counts: DataFrame, rows: int | None) -> DataFrame:
    """``(column_name, value, code)``: codes follow the sorted order of the values.

    ``rows`` is the number of distinct (column, value) pairs.  Up to a bound a window
    per column numbers them.  Beyond, the values are range-sorted once, the sorted
    rows are checkpointed so that their places are fixed, and each partition starts
    at the sum of the counts before it: one row per partition and column is ranked,
    never a whole column.
    """
    values = counts.select("column_name", "value")
    if rows is not None and rows <= SMALL_ROWS:
        order = Window.partitionBy("column_name").orderBy("value")
        return values.withColumn("code", F.row_number().over(order) - 1)
    ordered = cut_lineage(
        values.orderBy("column_name", "value").select(
            "column_name",
            "value",
            F.spark_partition_id().alias("__part"),
            F.monotonically_increasing_id().alias("__seq"),
        )
    )
    starts = ordered.groupBy("column_name", "__part").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__seq").alias("__first")
    )
    before = Window.partitionBy("column_name").orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = starts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    joined = ordered.join(starts.drop("__n"), ["column_name", "__part"])
    return joined.select(
        "column_name",
        "value",
        (F.col("__before") + F.col("__seq") - F.col("__first")).cast("int").alias("code"),
    )


def encode(df: DataFrame, name: str, codes: DataFrame, rows: int | None, out: str, unseen: int | None) -> DataFrame:
    """Replace the text column ``name`` by its code in ``out``.

    Values without a code get ``unseen`` (``None`` leaves them null).
    """
    table = codes.where(F.col("column_name") == name).select(
        F.col("value").alias("__value"), F.col("code").alias("__code")
    )
    keyed = df.withColumn("__value", col(name).cast("string"))
    joined = join_by_size(keyed, table, "__value", "left", rows)
    code = F.col("__code") if unseen is None else F.coalesce(F.col("__code"), F.lit(unseen))
    return joined.withColumn(out, code.cast("double")).drop("__value", "__code")


# --- fitted preparation -------------------------------------------------------


@dataclass
class Preparation:
    """What was learned from the training rows; applied unchanged when scoring."""

    task: Task
    kinds: dict[str, str]
    medians: dict[str, float]
    modes: dict[str, str]
    codes: DataFrame
    code_counts: dict[str, int]
    dropped: list[str] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return [p for p in self.task.predictors if p not in self.dropped]

    @property
    def numeric(self) -> list[str]:
        return [p for p in self.features if self.kinds[p] == "numeric"]

    @property
    def text(self) -> list[str]:
        return [p for p in self.features if self.kinds[p] == "text"]

    @property
    def boolean(self) -> list[str]:
        return [p for p in self.features if self.kinds[p] == "boolean"]

    @property
    def n_classes(self) -> int:
        return self.code_counts.get(self.task.target, 0)

    def feature_types(self) -> dict[str, str]:
        out = {}
        for p in self.features:
            if self.kinds[p] == "text":
                out[p] = f"categorical (encoded: {self.code_counts[p]} categories)"
            else:
                out[p] = f"numeric ({'bool' if self.kinds[p] == 'boolean' else 'double'})"
        return out

    def class_labels(self) -> DataFrame:
        """``(code, value)`` of the target classes."""
        return self.codes.where(F.col("column_name") == self.task.target).select("code", "value")

    # -- transformation --

    def impute(self, df: DataFrame, impute_from: str = "training") -> DataFrame:
        """Fill missing features with the stored statistics, or with the batch's own."""
        medians, modes = self.medians, self.modes
        if impute_from == "batch":
            medians = {**medians, **_medians(df, self.numeric)}
            modes = {**modes, **_modes(df, self.text + self.boolean)}
        elif impute_from != "training":
            raise ValueError("impute_from is 'training' or 'batch'")
        used = {f: self.kinds[f] for f in self.features}
        # Plain SQL strings: wide tables have one expression per column.
        out: list = []
        for name in df.columns:
            kind, c = used.get(name), quoted(name)
            if kind == "numeric":
                number = f"nanvl(try_cast({c} AS double), cast(null AS double))"
                out.append(F.expr(f"coalesce({number}, {float(medians[name])!r}D) AS {c}"))
            elif kind == "boolean":
                most = "1.0D" if modes[name] == "true" else "0.0D"
                out.append(F.expr(f"coalesce(cast({c} AS double), {most}) AS {c}"))
            elif kind == "text":
                out.append(F.coalesce(col(name).cast("string"), F.lit(modes.get(name))).alias(name))
            else:
                out.append(c)
        return df.select(*out)

    def transform_features(self, df: DataFrame, impute_from: str = "training") -> DataFrame:
        """Imputed and encoded features in place; unseen categories take code 0."""
        require_columns(df, self.features)
        out = self.impute(nan_to_null(df), impute_from)
        order = [quoted(c) for c in out.columns]
        for c in self.text:
            out = encode(out, c, self.codes, self.code_counts[c], c, unseen=0)
        return out.select(*order)

    def transform_target(self, df: DataFrame) -> DataFrame:
        """Rows with a usable target, plus it as ``label``."""
        target = self.task.target
        if self.task.kind == "regression":
            out = df.withColumn("label", coerce_numeric(col(target)))
        else:
            out = encode(df, target, self.codes, self.n_classes, "label", unseen=None)
        return out.where(F.col("label").isNotNull())

    def transform(self, df: DataFrame) -> DataFrame:
        return self.transform_features(self.transform_target(df))

    def assemble(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns, ``label`` when present, and the feature vector.

        Codes stay plain numbers: the vector carries no category metadata.
        """
        vector = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(self.features))], outputCol="features")
        label = ["label"] if "label" in df.columns else []
        kept = [quoted(k) for k in keep] + label
        staged = df.selectExpr(
            *kept, *[f"cast({quoted(f)} AS double) AS __f{i}" for i, f in enumerate(self.features)]
        )
        return vector.transform(staged).select(*kept, "features")

    # -- persistence --

    def save(self, path: str) -> None:
        spark = self.codes.sparkSession
        state = {
            "target": self.task.target,
            "predictors": list(self.task.predictors),
            "kind": self.task.kind,
            "kinds": self.kinds,
            "medians": self.medians,
            "modes": self.modes,
            "code_counts": self.code_counts,
            "dropped": self.dropped,
        }
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.text(f"{path}/state")
        self.codes.write.parquet(f"{path}/codes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Preparation:
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        return Preparation(
            task=Task(state["target"], tuple(state["predictors"]), state["kind"]),
            kinds=state["kinds"],
            medians=state["medians"],
            modes=state["modes"],
            codes=spark.read.parquet(f"{path}/codes"),
            code_counts=state["code_counts"],
            dropped=state["dropped"],
        )


def _medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    if not columns:
        return {}
    null = "cast(null AS double)"
    numbers = df.selectExpr(
        *[f"nanvl(try_cast({quoted(c)} AS double), {null}) AS {quoted(c)}" for c in columns]
    )
    return {c: q[0] for c, q in exact_quantiles(numbers, columns, [0.5]).items() if q[0] is not None}


def _modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    if not columns:
        return {}
    rows = most_frequent(value_counts(df, columns)).collect()  # one row per column
    return {r["column_name"]: r["value"] for r in rows}


def fit_preparation(df: DataFrame, target: str, predictors: Sequence[str], kind: str = "classification") -> Preparation:
    """Learn medians, most frequent values and codes from the rows with a target.

    Numeric medians take one aggregate, all text statistics one shuffle of already
    combined values.  Predictors without any value cannot be imputed and are dropped.
    """
    data = nan_to_null(tidy_columns(df))
    task = select_task(data, target, predictors, kind)
    require_columns(data, [target, *predictors])
    schema = {f.name: f.dataType for f in data.schema}
    kinds = {p: feature_kind(schema[p]) for p in task.predictors}
    usable = (
        data.where(coerce_numeric(col(task.target)).isNotNull())
        if kind == "regression"
        else drop_missing_target(data, task.target)
    )
    numeric = [p for p in task.predictors if kinds[p] == "numeric"]
    # Truth columns are filled with their most frequent value, too.
    text = [p for p in task.predictors if kinds[p] in ("text", "boolean")]
    medians = _medians(usable, numeric)
    encoded = text + ([task.target] if kind == "classification" else [])
    spark = df.sparkSession
    modes: dict[str, str] = {}
    code_counts: dict[str, int] = {}
    codes = spark.createDataFrame([], "column_name string, value string, code int")
    if encoded:
        counts = value_counts(usable, encoded)
        # One row per encoded column.
        per_column = counts.groupBy("column_name").agg(
            F.count(F.lit(1)).alias("values"),
            F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("v"))).alias("best"),
        ).collect()
        code_counts = {r["column_name"]: r["values"] for r in per_column}
        modes = {r["column_name"]: r["best"]["v"] for r in per_column if r["column_name"] in text}
        codes = code_table(counts, sum(code_counts.values()))
        if sum(code_counts.values()) <= SMALL_ROWS:
            codes = spark.createDataFrame(codes.collect(), "column_name string, value string, code int")
    dropped = [p for p in numeric if p not in medians] + [p for p in text if p not in modes]
    return Preparation(task, kinds, medians, modes, codes, code_counts, dropped)


def prepare(df: DataFrame, target: str, predictors: Sequence[str], kind: str = "classification"):
    """Fit on ``df`` and return ``(preparation, prepared rows)``."""
    preparation = fit_preparation(df, target, predictors, kind)
    return preparation, preparation.transform(tidy_columns(df))


def check_complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raise when any of ``columns`` still has a null; otherwise return ``df``."""
    left = wide_aggregate(df, {c: F.count_if(col(c).isNull() | F.isnan(col(c).cast("double"))) for c in columns})
    bad = {c: n for c, n in left.items() if n}
    if bad:
        raise ValueError(f"missing values are left after preparation: {bad}")
    return df


# --- target statistics --------------------------------------------------------


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Count and percentage per class, over rows that have one."""
    labelled = df.where(col(target).isNotNull())
    total = labelled.count()
    sizes = labelled.groupBy(col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("class", "n", F.round(F.col("n") * 100.0 / F.lit(total), 2).alias("pct"))


def target_statistics(df: DataFrame, target: str) -> DataFrame:
    y = coerce_numeric(col(target))
    return df.agg(
        F.count(y).alias("n"),
        F.min(y).alias("target_min"),
        F.max(y).alias("target_max"),
        F.avg(y).alias("target_mean"),
        F.stddev_samp(y).alias("target_std"),
    )


def target_histogram(df: DataFrame, target: str) -> DataFrame:
    """Equal-width histogram of a numeric target, empty bins included.

    One bin per value up to ten values, then half the distinct values plus one, at
    most twenty; the last bin is closed.  A constant target gives no rows.
    """
    y = coerce_numeric(col(target))
    numbers = df.select(y.alias("y")).where(F.col("y").isNotNull())
    facts = numbers.agg(
        F.min("y").alias("lo"), F.max("y").alias("hi"), F.approx_count_distinct("y").alias("about")
    ).first()
    spark = df.sparkSession
    schema = "bin int, bin_label string, n bigint, pct double"
    if facts["lo"] is None:
        return spark.createDataFrame([], schema)
    # Beyond 38 distinct values the bin count is at its maximum: a sketch far above
    # that settles it without a distinct shuffle.
    distinct = facts["about"] if facts["about"] > 1_000 else numbers.agg(F.count_distinct("y")).first()[0]
    bins = distinct if distinct <= HISTOGRAM_EACH_VALUE else min(HISTOGRAM_MAX_BINS, distinct // 2 + 1)
    if bins <= 1:
        return spark.createDataFrame([], schema)
    lo, hi = facts["lo"], facts["hi"]
    place = F.least(F.floor((F.col("y") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    counted = numbers.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (hi - lo) / bins
    edges = spark.createDataFrame(
        [(i, f"{lo + i * width:.2f}-{hi if i == bins - 1 else lo + (i + 1) * width:.2f}") for i in range(bins)],
        "bin int, bin_label string",
    )
    total = F.sum("n").over(Window.partitionBy())
    return (
        edges.join(counted, "bin", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .select("bin", "bin_label", "n", F.round(F.col("n") * 100.0 / total, 2).alias("pct"))
    )


def preparation_report(df: DataFrame, preparation: Preparation) -> DataFrame:
    """One row: sizes and missing values before and after, imputation flag, dropped features."""
    data = nan_to_null(tidy_columns(df))
    task = preparation.task
    before = wide_aggregate(
        data,
        {
            "rows": F.count(F.lit(1)),
            "nulls": F.coalesce(F.sum(null_count([*task.predictors, task.target])), F.lit(0)),
        },
    )
    after = wide_aggregate(
        preparation.transform(data),
        {
            "rows": F.count(F.lit(1)),
            "nulls": F.coalesce(F.sum(null_count([*preparation.features, "label"])), F.lit(0)),
        },
    )
    return df.sparkSession.createDataFrame(
        [
            (
                before["rows"],
                after["rows"],
                before["rows"] - after["rows"],
                len(preparation.features),
                before["nulls"],
                after["nulls"],
                before["nulls"] > 0,
                ", ".join(preparation.dropped),
                json.dumps(preparation.feature_types(), sort_keys=True),
            )
        ],
        "original_rows bigint, rows_after bigint, dropped_rows bigint, features int, nulls_before bigint,"
        " nulls_after bigint, imputation_applied boolean, dropped_features string, feature_types string",
    )

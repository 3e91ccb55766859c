"""Data-quality profile: validation report, cleaning analysis, type descriptions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    col,
    nan_to_null,
    null_count,
    numeric_columns,
    rows_from_aggregate,
    strip_text,
    text_columns,
)
from ..functions.statistics import distinct_counts, wide_aggregate

# Quality and size thresholds.
MISSING_LIMIT_PCT = 50
MINIMUM_ROWS = 10
SMALL_TABLE_ROWS = 100
LARGE_TABLE_ROWS = 10_000
MANY_COLUMNS = 50
# When a numeric column is worth scaling, and how.
SCALE_MIN_DISTINCT = 5
SCALE_RANGE = 100
SCALE_STD = 10
SCALE_MAX_WITH_NEGATIVES = 1000
STANDARD_RANGE = 1000
STANDARD_STD = 100
# Column-type description.
DISCRETE_MAX_DISTINCT = 10


def column_quality(df: DataFrame) -> DataFrame:
    """One row per column: type, missing count and percentage, over-half flag.

    A single aggregate without a shuffle of rows.
    """
    data = nan_to_null(df)
    exprs = []
    for i, c in enumerate(data.columns):
        exprs += [
            F.count(F.lit(1)).alias(f"__{i}_total_rows"),
            (F.count(F.lit(1)) - F.count(col(c))).alias(f"__{i}_missing_count"),
        ]
    types = {f.name: f.dataType.simpleString() for f in data.schema}
    rows = rows_from_aggregate(
        data.agg(*exprs), data.columns, [("total_rows", "bigint"), ("missing_count", "bigint")]
    )
    pct = F.col("missing_count") * 100.0 / F.col("total_rows")
    kind = F.element_at(
        F.create_map(*[x for n, t in types.items() for x in (F.lit(n), F.lit(t))]), F.col("column_name")
    )
    return rows.select(
        "position",
        "column_name",
        kind.alias("data_type"),
        "total_rows",
        "missing_count",
        F.round(pct, 2).alias("missing_pct"),
        (pct > MISSING_LIMIT_PCT).alias("over_half_missing"),
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Only the columns with missing values."""
    return (
        column_quality(df)
        .where(F.col("missing_count") > 0)
        .select("column_name", "missing_count", "missing_pct")
    )


def grouped_rows(df: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies in ``__n`` (null equals null)."""
    return df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))


def table_quality(df: DataFrame) -> DataFrame:
    """One row: size, duplicate rows, columns over half missing, validity.

    Copies are combined before the shuffle, and the missing counts are taken from
    the combined rows, so the table is scanned and shuffled once.
    """
    data = nan_to_null(df)
    exprs = [
        F.coalesce(F.sum("__n"), F.lit(0)).alias("total_rows"),
        F.count("__n").alias("distinct_rows"),
    ]
    exprs += [
        F.sum(F.when(col(c).isNull(), F.col("__n")).otherwise(0)).alias(f"__m{i}")
        for i, c in enumerate(data.columns)
    ]
    over_half = F.lit(0)
    for i in range(len(data.columns)):
        share = F.col(f"__m{i}") * 100.0 / F.col("total_rows")
        over_half = over_half + F.coalesce((share > MISSING_LIMIT_PCT).cast("int"), F.lit(0))
    facts = grouped_rows(data).agg(*exprs).withColumn("columns_over_half_missing", over_half)
    return facts.select(
        F.col("total_rows").cast("bigint").alias("total_rows"),
        F.lit(len(data.columns)).alias("total_columns"),
        (F.col("total_rows") - F.col("distinct_rows")).cast("bigint").alias("duplicate_rows"),
        "columns_over_half_missing",
        (F.col("total_rows") < MINIMUM_ROWS).alias("too_few_rows"),
        (
            (F.col("columns_over_half_missing") == 0) & (F.col("total_rows") >= MINIMUM_ROWS)
        ).alias("is_valid"),
    )


def quality_warnings(df: DataFrame) -> DataFrame:
    """Warning rows behind ``is_valid``: one per bad column, one for a tiny table."""
    columns = column_quality(df)
    share = F.col("missing_count") * 100.0 / F.col("total_rows")
    per_column = columns.where("over_half_missing").select(
        "column_name",
        F.format_string("column '%s' has %.1f%% missing values", "column_name", share).alias("warning"),
    )
    tiny = columns.where((F.col("position") == 0) & (F.col("total_rows") < MINIMUM_ROWS)).select(
        F.lit(None).cast("string").alias("column_name"),
        F.lit(f"the table has fewer than {MINIMUM_ROWS} rows").alias("warning"),
    )
    return per_column.unionByName(tiny)


def size_hints(df: DataFrame) -> DataFrame:
    """Advice by table size; no row when nothing applies."""
    n_columns = len(df.columns)
    hints = F.array_compact(
        F.array(
            F.when(
                F.col("total_rows") < SMALL_TABLE_ROWS, F.lit("small table: prefer simple models")
            ).when(
                F.col("total_rows") > LARGE_TABLE_ROWS, F.lit("large table: forests and linear machines do well")
            ),
            F.when(
                F.lit(n_columns > MANY_COLUMNS), F.lit("many columns: consider reducing dimensions")
            ),
        )
    )
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.lit(n_columns).alias("total_columns"), F.explode(hints).alias("hint")
    )


def dataset_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows and columns before and after, and the change."""
    sides = before.agg(F.count(F.lit(1)).alias("rows_before"), F.lit(0).cast("bigint").alias("rows_after")).unionAll(
        after.agg(F.lit(0).cast("bigint").alias("rows_before"), F.count(F.lit(1)).alias("rows_after"))
    )
    return sides.agg(F.sum("rows_before").alias("rows_before"), F.sum("rows_after").alias("rows_after")).select(
        "rows_before",
        "rows_after",
        (F.col("rows_after") - F.col("rows_before")).alias("rows_change"),
        F.lit(len(before.columns)).alias("columns_before"),
        F.lit(len(after.columns)).alias("columns_after"),
        F.lit(len(after.columns) - len(before.columns)).alias("columns_change"),
    )


def needs_scaling(lo: Column, hi: Column, std: Column, distinct: Column) -> Column:
    """Whether a numeric column would gain from scaling."""
    wide = (
        (hi - lo > SCALE_RANGE)
        | (std > SCALE_STD)
        | ((lo < 0) & (hi > SCALE_MAX_WITH_NEGATIVES))
    )
    return F.coalesce((distinct > SCALE_MIN_DISTINCT) & wide, F.lit(False))


def scaling_method(lo: Column, hi: Column, std: Column) -> Column:
    """Which scaler suits: spread out, non-negative, or the rest."""
    return (
        F.when((hi - lo > STANDARD_RANGE) | (std > STANDARD_STD), "standard")
        .when(lo >= 0, "minmax")
        .otherwise("robust")
    )


def numeric_profile(
    df: DataFrame, columns: Sequence[str] | None = None, exact_distinct: bool = True
) -> DataFrame:
    """Range, sample deviation, extremes and scaling advice per numeric column."""
    data = nan_to_null(df)
    columns = list(columns) if columns is not None else numeric_columns(data)
    exprs = []
    for i, c in enumerate(columns):
        v = col(c).cast("double")
        exprs += [
            F.min(v).alias(f"__{i}_lo"),
            F.max(v).alias(f"__{i}_hi"),
            F.stddev_samp(v).alias(f"__{i}_std"),
        ]
    facts = rows_from_aggregate(
        data.agg(*exprs), columns, [("lo", "double"), ("hi", "double"), ("std", "double")]
    ).join(F.broadcast(distinct_counts(data, columns, exact_distinct)), "column_name")
    lo, hi, std, distinct = (F.col(x) for x in ("lo", "hi", "std", "distinct_values"))
    return facts.select(
        "column_name",
        "distinct_values",
        F.round(hi - lo, 2).alias("value_range"),
        F.round(std, 2).alias("std"),
        F.round(lo, 2).alias("min_value"),
        F.round(hi, 2).alias("max_value"),
        needs_scaling(lo, hi, std, distinct).alias("needs_scaling"),
        F.when(needs_scaling(lo, hi, std, distinct), scaling_method(lo, hi, std)).alias("method"),
    )


@dataclass
class CleaningAnalysis:
    """What cleaning a table would need."""

    summary: DataFrame
    numeric: DataFrame
    recommendations: DataFrame


def _row_facts(data: DataFrame) -> dict:
    """Row- and column-level counts from one pass over the distinct rows."""
    width = len(data.columns)
    nulls = null_count(data.columns)
    n = F.col("__n")

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n).otherwise(0)), F.lit(0))

    exprs = {
        "rows": F.coalesce(F.sum(n), F.lit(0)),
        "distinct": F.count(n),
        "empty": rows_where(nulls == width),
        "sparse": rows_where(nulls * 2 > width),
    }
    for i, c in enumerate(data.columns):
        exprs[f"v{i}"] = F.count(col(c))
    for c in text_columns(data):
        exprs["s" + c] = F.bool_or(strip_text(col(c)) != col(c))
    return wide_aggregate(grouped_rows(data), exprs)


def analyze_cleaning(df: DataFrame, exact_distinct: bool = True) -> CleaningAnalysis:
    """Count what each cleaning step would change and recommend the steps that help."""
    spark = df.sparkSession
    data = nan_to_null(df)
    facts = _row_facts(data)
    empty_columns = [c for i, c in enumerate(data.columns) if facts[f"v{i}"] == 0]
    padded = [c for c in text_columns(data) if facts["s" + c]]
    numeric = (
        numeric_profile(data, exact_distinct=exact_distinct)
        if numeric_columns(data)
        else None
    )
    # One row per numeric column: schema-sized, so it may come to the driver.
    advice = {r["column_name"]: r for r in numeric.collect()} if numeric is not None else {}
    scalable = [c for c in data.columns if c in advice and advice[c]["needs_scaling"]]
    duplicates = facts["rows"] - facts["distinct"]
    summary = spark.createDataFrame(
        [
            (
                facts["rows"],
                len(data.columns),
                facts["empty"],
                duplicates,
                facts["sparse"],
                len(empty_columns),
                ", ".join(empty_columns),
                len(padded),
                ", ".join(padded),
                len(scalable),
                ", ".join(scalable),
            )
        ],
        "total_rows bigint, total_columns int, empty_rows bigint, duplicate_rows bigint,"
        " rows_many_missing bigint, empty_columns int, empty_column_names string,"
        " padded_columns int, padded_column_names string, scalable_columns int,"
        " scalable_column_names string",
    )
    steps = [
        ("remove_empty_rows", facts["empty"], f"{facts['empty']} empty rows would be removed"),
        ("remove_duplicates", duplicates, f"{duplicates} duplicate rows would be removed"),
        (
            "remove_rows_many_missing",
            facts["sparse"],
            f"{facts['sparse']} rows with too little data would be removed",
        ),
        ("remove_empty_cols", len(empty_columns), f"{len(empty_columns)} columns would be removed"),
        ("clean_text_spaces", len(padded), f"spaces would be stripped in: {', '.join(padded)}"),
        ("normalize_data", len(scalable), f"columns would be scaled: {', '.join(scalable)}"),
    ]
    helpful = [s for s in steps if s[1]] or [("no_cleaning", 0, "no operation needed")]
    recommendations = spark.createDataFrame(
        [(i + 1, kind, count, kind != "no_cleaning", text) for i, (kind, count, text) in enumerate(helpful)],
        "position int, step string, affected bigint, recommended boolean, impact string",
    )
    return CleaningAnalysis(summary, numeric, recommendations)


def column_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A readable type per column: categorical, discrete, continuous, or empty."""
    data = nan_to_null(df)
    columns = list(columns) if columns is not None else data.columns
    numeric, text = set(numeric_columns(data)), set(text_columns(data))
    exprs = []
    for i, c in enumerate(columns):
        v = col(c)
        if c in numeric:
            d = v.cast("double")
            exprs += [
                F.min(v).cast("string").alias(f"__{i}_lo"),
                F.max(v).cast("string").alias(f"__{i}_hi"),
                F.bool_and(d == F.floor(d)).alias(f"__{i}_whole"),
            ]
        else:
            none = F.lit(None).cast("string")
            exprs += [
                F.max(none).alias(f"__{i}_lo"),
                F.max(none).alias(f"__{i}_hi"),
                F.max(F.lit(None).cast("boolean")).alias(f"__{i}_whole"),
            ]
        exprs.append(F.count(v).alias(f"__{i}_valid"))
        kind = "numeric" if c in numeric else "text" if c in text else "other"
        exprs.append(F.max(F.lit(kind)).alias(f"__{i}_kind"))
    facts = rows_from_aggregate(
        data.agg(*exprs),
        columns,
        [("lo", "string"), ("hi", "string"), ("whole", "boolean"), ("valid", "bigint"), ("kind", "string")],
    ).join(F.broadcast(distinct_counts(data, columns)), "column_name")
    discrete = (F.col("distinct_values") <= DISCRETE_MAX_DISTINCT) & F.col("whole")
    text_form = (
        F.when(F.col("kind") == "text", F.format_string("Categorical (%d unique values)", "distinct_values"))
        .when(F.col("kind") == "other", F.lit("Mixed"))
        .when(F.col("valid") == 0, F.lit("No valid data"))
        .when(discrete, F.format_string("Discrete numeric (%s-%s)", "lo", "hi"))
        .otherwise(
            F.format_string(
                "Continuous numeric (%.2f-%.2f)", F.col("lo").cast("double"), F.col("hi").cast("double")
            )
        )
    )
    return facts.select("column_name", "distinct_values", text_form.alias("description"))

"""Profile and target queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import profile, target
from .inputs import DIRTY_COLUMNS, DIRTY_SQL, NULLS_SQL, dirty, table

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
TYPES = {
    "l_orderkey": "bigint",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_linenumber": "int",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_tax": "double",
    "l_returnflag": "string",
    "l_linestatus": "string",
}
DIRTY_TYPES = {"custkey": "bigint", "total": "double", "status": "string", "priority": "string", "note": "string"}


def _per_column(names, select: str, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, {select.format(c=c)} FROM {source}"
        for i, c in enumerate(names)
    )


def validation_columns(spark: SparkSession, folder: str) -> DataFrame:
    return profile.column_quality(dirty(spark, folder))


VALIDATION_COLUMNS = f"""WITH {DIRTY_SQL}, f AS ({_per_column(
    DIRTY_COLUMNS, "count(*) AS total_rows, count(*) - count({c}) AS missing_count", "dirty")})
SELECT position, column_name, CASE column_name {" ".join(
    f"WHEN '{c}' THEN '{t}'" for c, t in DIRTY_TYPES.items())} END AS data_type,
 total_rows, missing_count, round(missing_count * 100.0::DOUBLE / total_rows, 2) AS missing_pct,
 missing_count * 100.0::DOUBLE / total_rows > 50 AS over_half_missing FROM f"""


def validation_table(spark: SparkSession, folder: str) -> DataFrame:
    return profile.table_quality(dirty(spark, folder))


VALIDATION_TABLE = f"""WITH {DIRTY_SQL}, f AS (SELECT count(*) AS total_rows,
 {" + ".join(f"(count({c}) * 2 < count(*))::INT" for c in DIRTY_COLUMNS)} AS columns_over_half_missing FROM dirty),
 d AS (SELECT count(*) AS distinct_rows FROM (SELECT DISTINCT * FROM dirty))
SELECT total_rows, 5 AS total_columns, total_rows - distinct_rows AS duplicate_rows, columns_over_half_missing,
 total_rows < 10 AS too_few_rows, columns_over_half_missing = 0 AND total_rows >= 10 AS is_valid FROM f, d"""


def validation_warnings(spark: SparkSession, folder: str) -> DataFrame:
    return profile.quality_warnings(dirty(spark, folder))


VALIDATION_WARNINGS = f"""WITH {DIRTY_SQL}, f AS ({_per_column(
    DIRTY_COLUMNS, "count(*) AS t, count(*) - count({c}) AS m", "dirty")})
SELECT column_name, printf('column ''%s'' has %.1f%% missing values', column_name, m * 100.0::DOUBLE / t) AS warning
FROM f WHERE m * 2 > t"""


def missing_values(spark: SparkSession, folder: str) -> DataFrame:
    return profile.missing_values(dirty(spark, folder))


MISSING_VALUES = f"""WITH {DIRTY_SQL}, f AS ({_per_column(
    DIRTY_COLUMNS, "count(*) AS t, count(*) - count({c}) AS m", "dirty")})
SELECT column_name, m AS missing_count, round(m * 100.0::DOUBLE / t, 2) AS missing_pct FROM f WHERE m > 0"""


def cleaning_summary(spark: SparkSession, folder: str) -> DataFrame:
    return profile.analyze_cleaning(dirty(spark, folder)).summary


CLEANING_SUMMARY = f"""WITH {DIRTY_SQL},
 d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM dirty))
SELECT count(*) AS total_rows, 5 AS total_columns, count(*) FILTER ({NULLS_SQL} = 5) AS empty_rows,
 count(*) - (SELECT n FROM d) AS duplicate_rows, count(*) FILTER ({NULLS_SQL} > 2.5) AS rows_many_missing,
 1 AS empty_columns, 'note' AS empty_column_names,
 bool_or(trim(status) <> status)::INT AS padded_columns,
 CASE WHEN bool_or(trim(status) <> status) THEN 'status' ELSE '' END AS padded_column_names,
 2 AS scalable_columns, 'custkey, total' AS scalable_column_names FROM dirty
HAVING max(custkey) - min(custkey) > 100 AND max(total) - min(total) > 100 AND count(note) = 0"""


def cleaning_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    return profile.analyze_cleaning(dirty(spark, folder)).recommendations.select(
        "position", "step", "affected", "recommended"
    )


CLEANING_RECOMMENDATIONS = f"""WITH {DIRTY_SQL}, r AS (
 SELECT 1 AS o, 'remove_empty_rows' AS step, count(*) FILTER ({NULLS_SQL} = 5) AS affected FROM dirty
 UNION ALL SELECT 2, 'remove_duplicates', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) FROM dirty
 UNION ALL SELECT 3, 'remove_rows_many_missing', count(*) FILTER ({NULLS_SQL} > 2.5) FROM dirty
 UNION ALL SELECT 4, 'remove_empty_cols', (count(note) = 0)::BIGINT FROM dirty
 UNION ALL SELECT 5, 'clean_text_spaces', bool_or(trim(status) <> status)::BIGINT FROM dirty
 UNION ALL SELECT 6, 'normalize_data', (max(custkey) - min(custkey) > 100)::BIGINT
   + (max(total) - min(total) > 100)::BIGINT FROM dirty)
SELECT (row_number() OVER (ORDER BY o))::INT AS position, step, affected, true AS recommended FROM r WHERE affected > 0"""


def numeric_advice(spark: SparkSession, folder: str) -> DataFrame:
    return profile.numeric_profile(table(spark, folder, "lineitem").select(*NUMERIC))


def _numeric_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, min({c})::DOUBLE AS lo,"
        f" max({c})::DOUBLE AS hi, stddev_samp({c}) AS sd FROM lineitem"
        for c in NUMERIC
    )
    needs = "(distinct_values > 5 AND (hi - lo > 100 OR sd > 10 OR (lo < 0 AND hi > 1000)))"
    return f"""WITH f AS ({parts})
SELECT column_name, distinct_values, round(hi - lo, 2) AS value_range, round(sd, 2) AS std,
 round(lo, 2) AS min_value, round(hi, 2) AS max_value, {needs} AS needs_scaling,
 CASE WHEN NOT {needs} THEN NULL WHEN hi - lo > 1000 OR sd > 100 THEN 'standard'
  WHEN lo >= 0 THEN 'minmax' ELSE 'robust' END AS method FROM f"""


def dataset_delta(spark: SparkSession, folder: str) -> DataFrame:
    before = dirty(spark, folder)
    return profile.dataset_delta(before, before.drop("note").dropDuplicates())


DATASET_DELTA = f"""WITH {DIRTY_SQL}, a AS (SELECT count(*) AS n FROM dirty),
 b AS (SELECT count(*) AS n FROM (SELECT DISTINCT custkey, total, status, priority FROM dirty))
SELECT a.n AS rows_before, b.n AS rows_after, b.n - a.n AS rows_change, 5 AS columns_before, 4 AS columns_after,
 -1 AS columns_change FROM a, b"""


def column_types(spark: SparkSession, folder: str) -> DataFrame:
    return profile.column_types(table(spark, folder, "lineitem").select(*TYPES))


def _types_sql() -> str:
    parts = []
    for c, t in TYPES.items():
        if t == "string":
            text = "printf('Categorical (%d unique values)', count(DISTINCT {c}))"
        else:
            text = (
                "CASE WHEN count(DISTINCT {c}) <= 10 AND bool_and({c} = floor({c}))"
                " THEN concat('Discrete numeric (', min({c}), '-', max({c}), ')')"
                " ELSE printf('Continuous numeric (%.2f-%.2f)', min({c})::DOUBLE, max({c})::DOUBLE) END"
            )
        parts.append(
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, {text.format(c=c)} AS description"
            " FROM lineitem"
        )
    return " UNION ALL ".join(parts)


def size_hints(spark: SparkSession, folder: str) -> DataFrame:
    return profile.size_hints(table(spark, folder, "lineitem"))


SIZE_HINTS = """SELECT count(*) AS total_rows, 11 AS total_columns,
 CASE WHEN count(*) < 100 THEN 'small table: prefer simple models'
  ELSE 'large table: forests and linear machines do well' END AS hint
FROM lineitem HAVING count(*) < 100 OR count(*) > 10000"""


# --- targets -------------------------------------------------------------------

_TARGETS = {
    "l_linenumber": ("int", True),
    "l_quantity": ("double", True),
    "l_extendedprice": ("double", True),
    "l_returnflag": ("string", False),
    "l_orderkey": ("bigint", True),
}


def _target_input(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").selectExpr(
        *_TARGETS, "CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_discount END AS gaps", "1 AS constant"
    )
    return lines


def _target_cte() -> str:
    kinds = {**_TARGETS, "gaps": ("double", True), "constant": ("int", True)}
    parts = []
    for c, (kind, numeric) in kinds.items():
        whole = f"coalesce(bool_and({c} = floor({c})), false)" if numeric else "false"
        order = "v" if numeric else "v::VARCHAR"
        cast = "v::VARCHAR"
        parts.append(
            f"SELECT '{c}' AS column_name, count(*) AS total_values, count({c}) AS valid_values,"
            f" count(*) - count({c}) AS missing_values, '{kind}' AS data_type, {str(numeric).lower()} AS is_numeric,"
            f" {whole} AS whole, count(DISTINCT {c}) AS n,"
            f" (SELECT string_agg({cast}, '|' ORDER BY {order}) FROM (SELECT DISTINCT {c} AS v FROM t WHERE {c} IS NOT NULL"
            f" ORDER BY {order} LIMIT 10)) AS sample_values FROM t"
        )
    return (
        f"t AS (SELECT {', '.join(_TARGETS)}, CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_discount END AS gaps,"
        f" 1 AS constant FROM lineitem), p AS ({' UNION ALL '.join(parts)}),"
        " c AS (SELECT *, NOT is_numeric OR n <= 20 AS is_categorical, is_numeric AND whole AND n <= 10 AS is_discrete,"
        " NOT (is_numeric AND n > 50) AND n >= 2 AS classification_compatible,"
        " is_numeric AND n <> 1 AS regression_compatible,"
        " CASE WHEN is_numeric AND n > 50 THEN printf('Too many unique categories (%d). Recommended maximum: 20', n)"
        " WHEN n < 2 THEN 'At least 2 different categories are needed' ELSE '' END AS classification_notes,"
        " concat_ws('. ', CASE WHEN NOT is_numeric THEN 'The target must be numeric for regression' END,"
        " CASE WHEN is_numeric AND n = 1 THEN 'All values are equal, there is nothing to predict' END,"
        " CASE WHEN is_numeric AND n < 5 THEN printf('Few unique values (%d). Consider classification', n) END)"
        " AS regression_notes FROM p),"
        " r AS (SELECT *, classification_compatible AND regression_compatible AS both_ok, is_numeric AND n > 10 AS many,"
        " CASE WHEN classification_compatible AND regression_compatible AND is_numeric AND n > 10 THEN 'regression'"
        " WHEN classification_compatible THEN 'classification' WHEN regression_compatible THEN 'regression'"
        " ELSE 'none' END AS recommendation,"
        " CASE WHEN classification_compatible AND regression_compatible AND is_numeric AND n > 10"
        " THEN 'continuous numeric column with many values'"
        " WHEN classification_compatible AND regression_compatible THEN 'categorical or discrete column'"
        " WHEN classification_compatible THEN 'only classification is possible'"
        " WHEN regression_compatible THEN 'only regression is possible' ELSE 'no model type is possible' END AS reason"
        " FROM c)"
    )


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    return target.analyze_targets(_target_input(spark, folder))


def target_profile(spark: SparkSession, folder: str) -> DataFrame:
    return target.target_profile(_target_input(spark, folder)).selectExpr(
        "column_name",
        "data_type",
        "total_values",
        "valid_values",
        "missing_values",
        "distinct_values",
        "array_join(sample_values, '|') AS sample_values",
    )


TARGET_PROFILE = f"""WITH {_target_cte()} SELECT column_name, data_type, total_values, valid_values, missing_values,
 n AS distinct_values, sample_values FROM p"""


TYPED = {
    "amount": "CAST(o_totalprice / 1000 AS DECIMAL(12, 2))",
    "day": "CAST(o_orderdate AS DATE)",
    "ratio": "CAST((o_orderkey % 90 - 15) / 4 AS FLOAT)",
}


def target_profile_types(spark: SparkSession, folder: str) -> DataFrame:
    """Decimals, dates and short floats in the order of their own type."""
    data = table(spark, folder, "orders").selectExpr(*[f"{e} AS {n}" for n, e in TYPED.items()])
    return target.target_profile(data).selectExpr(
        "column_name", "valid_values", "distinct_values", "array_join(sample_values, '|') AS sample_values"
    )


TARGET_PROFILE_TYPES = " UNION ALL ".join(
    f"""SELECT '{n}' AS column_name, (SELECT count(*) FROM orders) AS valid_values, count(*) AS distinct_values,
 array_to_string(list(v::VARCHAR ORDER BY v)[1:10], '|') AS sample_values FROM (SELECT DISTINCT {e} AS v FROM orders)"""
    for n, e in TYPED.items()
)


def target_compatibility(spark: SparkSession, folder: str) -> DataFrame:
    return _targets(spark, folder).select(
        "column_name",
        "is_numeric",
        "is_categorical",
        "is_discrete",
        "classification_compatible",
        "classification_notes",
        "regression_compatible",
        "regression_notes",
    )


TARGET_COMPATIBILITY = f"""WITH {_target_cte()} SELECT column_name, is_numeric, is_categorical, is_discrete,
 classification_compatible, classification_notes, regression_compatible, regression_notes FROM c"""


def target_recommendation(spark: SparkSession, folder: str) -> DataFrame:
    return _targets(spark, folder).select("column_name", "recommendation", "reason")


TARGET_RECOMMENDATION = f"WITH {_target_cte()} SELECT column_name, recommendation, reason FROM r"


def target_availability(spark: SparkSession, folder: str) -> DataFrame:
    return _targets(spark, folder).select(
        "column_name",
        "classification_status",
        "classification_message",
        "regression_status",
        "regression_message",
        "summary",
    )


TARGET_AVAILABILITY = f"""WITH {_target_cte()} SELECT column_name,
 CASE WHEN NOT classification_compatible THEN 'unavailable' WHEN recommendation = 'classification' THEN 'recommended'
  ELSE 'available' END AS classification_status,
 CASE WHEN NOT classification_compatible THEN concat('Not suitable for classification: ', classification_notes)
  WHEN recommendation = 'classification' THEN printf('Recommended for classification (%d categories)', n)
  ELSE printf('Suitable for classification (%d categories)', n) END AS classification_message,
 CASE WHEN NOT regression_compatible THEN 'unavailable' WHEN recommendation = 'regression' THEN 'recommended'
  ELSE 'available' END AS regression_status,
 CASE WHEN NOT regression_compatible THEN concat('Not suitable for regression: ', regression_notes)
  WHEN recommendation = 'regression' THEN 'Recommended for regression (continuous numeric column)'
  WHEN regression_notes <> '' THEN concat('Suitable for regression, classification is preferred. ', regression_notes)
  ELSE 'Suitable for regression, classification is preferred' END AS regression_message,
 concat('Column ''', column_name, ''': ', n, ' unique values ',
  CASE WHEN is_numeric THEN concat('(numeric - ', data_type, ')') ELSE '(categorical/text)' END,
  CASE WHEN missing_values > 0 THEN concat('. ', missing_values, ' missing values') ELSE '' END) AS summary FROM r"""

QUERIES = {
    "validation_columns": (validation_columns, VALIDATION_COLUMNS),
    "validation_table": (validation_table, VALIDATION_TABLE),
    "validation_warnings": (validation_warnings, VALIDATION_WARNINGS),
    "missing_values": (missing_values, MISSING_VALUES),
    "cleaning_summary": (cleaning_summary, CLEANING_SUMMARY),
    "cleaning_recommendations": (cleaning_recommendations, CLEANING_RECOMMENDATIONS),
    "numeric_advice": (numeric_advice, _numeric_sql()),
    "dataset_delta": (dataset_delta, DATASET_DELTA),
    "column_types": (column_types, _types_sql()),
    "size_hints": (size_hints, SIZE_HINTS),
    "target_profile": (target_profile, TARGET_PROFILE),
    "target_profile_types": (target_profile_types, TARGET_PROFILE_TYPES),
    "target_compatibility": (target_compatibility, TARGET_COMPATIBILITY),
    "target_recommendation": (target_recommendation, TARGET_RECOMMENDATION),
    "target_availability": (target_availability, TARGET_AVAILABILITY),
}

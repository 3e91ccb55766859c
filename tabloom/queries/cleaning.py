"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean
from .inputs import DIRTY_SQL, KEYED_SQL, NULLS_SQL, dirty, table

ALL_STEPS = clean.CleaningOptions(
    remove_empty_rows=True,
    remove_rows_many_missing=True,
    remove_empty_cols=True,
    remove_duplicates=True,
    clean_text_spaces=True,
    normalize_data=True,
)
_COLUMNS = "custkey, total, status, priority, note"


def drop_empty_rows(spark: SparkSession, folder: str) -> DataFrame:
    return clean.drop_empty_rows(dirty(spark, folder))


def drop_sparse_rows(spark: SparkSession, folder: str) -> DataFrame:
    return clean.drop_sparse_rows(dirty(spark, folder))


def drop_empty_columns(spark: SparkSession, folder: str) -> DataFrame:
    return clean.drop_empty_columns(dirty(spark, folder))


def drop_duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    return clean.drop_duplicate_rows(dirty(spark, folder))


def strip_text(spark: SparkSession, folder: str) -> DataFrame:
    return clean.strip_text_columns(dirty(spark, folder, key=True))


def _scaled(method: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        data = dirty(spark, folder, key=True).select("o_orderkey", "total")
        return clean.scale(data, ["total"], method).select("o_orderkey", F.round("total", 6).alias("total"))

    return run


def _scaled_sql(centre: str, spread: str) -> str:
    return f"""WITH {KEYED_SQL}, f AS (SELECT {centre} AS a, {spread} AS b FROM keyed)
SELECT o_orderkey, round((total - a) / CASE WHEN b = 0 THEN 1 ELSE b END, 6) AS total FROM keyed, f"""


def _manual(spark: SparkSession, folder: str) -> clean.CleaningResult:
    return clean.clean(dirty(spark, folder), ALL_STEPS, protected=["total", "status"])


def clean_manual(spark: SparkSession, folder: str) -> DataFrame:
    return _manual(spark, folder).data.withColumn("total", F.round("total", 6))


def clean_manual_report(spark: SparkSession, folder: str) -> DataFrame:
    return _manual(spark, folder).report


_KEPT = f"""{DIRTY_SQL},
 kept AS (SELECT custkey, total, status, priority FROM dirty WHERE {NULLS_SQL} < 5 AND {NULLS_SQL} <= 2.5),
 one AS (SELECT DISTINCT custkey, total, status, priority FROM kept)"""
CLEAN_MANUAL = f"""WITH {_KEPT}, f AS (SELECT avg(total) AS a, stddev_pop(total) AS b FROM one)
SELECT custkey, round((total - a) / b, 6) AS total, trim(status) AS status, priority FROM one, f"""
CLEAN_MANUAL_REPORT = f"""WITH {_KEPT}
SELECT 1 AS position, 'remove_empty_rows' AS step, count(*) AS affected, '' AS columns FROM dirty WHERE {NULLS_SQL} = 5
UNION ALL SELECT 2, 'remove_rows_many_missing', count(*), '' FROM dirty WHERE {NULLS_SQL} < 5 AND {NULLS_SQL} > 2.5
UNION ALL SELECT 3, 'remove_empty_cols', 1, 'note'
UNION ALL SELECT 4, 'remove_duplicates', (SELECT count(*) FROM kept) - (SELECT count(*) FROM one), ''
UNION ALL SELECT 5, 'clean_text_spaces', 1, 'status'
UNION ALL SELECT 6, 'normalize_data', 1, 'total'"""


def clean_automatic(spark: SparkSession, folder: str) -> DataFrame:
    out = clean.clean_automatically(dirty(spark, folder)).data
    return out.withColumn("total", F.round("total", 6)).withColumn("custkey", F.round("custkey", 6))


def clean_automatic_report(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_automatically(dirty(spark, folder)).report


_NULLS4 = NULLS_SQL.replace(" + (note IS NULL)::INT", "")
_AUTO = f"""{DIRTY_SQL},
 one AS (SELECT DISTINCT custkey, total, status, priority FROM dirty WHERE {NULLS_SQL} < 5),
 dense AS (SELECT * FROM one WHERE {_NULLS4} <= 2)"""
CLEAN_AUTOMATIC = f"""WITH {_AUTO}, f AS (SELECT avg(total) AS a, stddev_pop(total) AS b, avg(custkey) AS c,
 stddev_pop(custkey) AS d FROM dense)
SELECT round((custkey - c) / d, 6) AS custkey, round((total - a) / b, 6) AS total, trim(status) AS status, priority
FROM dense, f"""
CLEAN_AUTOMATIC_REPORT = f"""WITH {_AUTO}
SELECT 1 AS position, 'remove_empty_rows' AS step, count(*) AS affected, '' AS columns FROM dirty WHERE {NULLS_SQL} = 5
UNION ALL SELECT 2, 'remove_empty_cols', 1, 'note'
UNION ALL SELECT 3, 'remove_duplicates',
 (SELECT count(*) FROM dirty WHERE {NULLS_SQL} < 5) - (SELECT count(*) FROM one), ''
UNION ALL SELECT 4, 'remove_rows_many_missing', (SELECT count(*) FROM one) - (SELECT count(*) FROM dense), ''
UNION ALL SELECT 5, 'clean_text_spaces', 1, 'status'
UNION ALL SELECT 6, 'normalize_data', 2, 'custkey, total'"""


def skip_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    chosen = ["o_orderkey", "o_totalprice", "o_orderpriority", "not_there"]
    return clean.skip_cleaning(table(spark, folder, "orders"), chosen).data


QUERIES = {
    "drop_empty_rows": (drop_empty_rows, f"WITH {DIRTY_SQL} SELECT {_COLUMNS} FROM dirty WHERE {NULLS_SQL} < 5"),
    "drop_sparse_rows": (drop_sparse_rows, f"WITH {DIRTY_SQL} SELECT {_COLUMNS} FROM dirty WHERE {NULLS_SQL} <= 2.5"),
    "drop_empty_columns": (drop_empty_columns, f"WITH {DIRTY_SQL} SELECT custkey, total, status, priority FROM dirty"),
    "drop_duplicate_rows": (drop_duplicate_rows, f"WITH {DIRTY_SQL} SELECT DISTINCT {_COLUMNS} FROM dirty"),
    "strip_text": (
        strip_text,
        f"WITH {KEYED_SQL} SELECT o_orderkey, custkey, total, trim(status) AS status, priority, note FROM keyed",
    ),
    "scale_standard": (_scaled("standard"), _scaled_sql("avg(total)", "stddev_pop(total)")),
    "scale_minmax": (_scaled("minmax"), _scaled_sql("min(total)", "max(total) - min(total)")),
    "scale_robust": (
        _scaled("robust"),
        _scaled_sql("median(total)", "quantile_cont(total, 0.75) - quantile_cont(total, 0.25)"),
    ),
    "clean_manual": (clean_manual, CLEAN_MANUAL),
    "clean_manual_report": (clean_manual_report, CLEAN_MANUAL_REPORT),
    "clean_automatic": (clean_automatic, CLEAN_AUTOMATIC),
    "clean_automatic_report": (clean_automatic_report, CLEAN_AUTOMATIC_REPORT),
    "skip_cleaning": (skip_cleaning, "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders"),
}

"""Projection, preparation and split queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.names import select_task
from ..functions.statistics import most_frequent, value_counts
from ..operators import prepare, split
from ..operators.evaluate import training_summary
from ..operators.profile import column_quality
from ..plans.training import check_prepared
from ..sources.tables import check_structure, column_list, preview
from .inputs import KEYED_SQL, dirty, split_sql, table

RARE = "CASE WHEN o_orderkey = 1 THEN 'Z' ELSE o_orderstatus END"


def select_columns(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    task = select_task(orders, "o_orderstatus", ["o_totalprice", "o_orderpriority", "not_there"])
    return orders.select(*[col(c) for c in task.columns])


def drop_missing_target(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.drop_missing_target(dirty(spark, folder, key=True), "priority").select("o_orderkey", "priority")


def drop_rare_classes(spark: SparkSession, folder: str) -> DataFrame:
    data = table(spark, folder, "orders").selectExpr("o_orderkey", f"{RARE} AS label")
    return split.drop_rare_classes(data, "label").select("o_orderkey", "label")


def column_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Role of each column with the number of its values."""
    data = dirty(spark, folder)
    kinds = prepare.split_by_kind(data).drop("position")
    return column_quality(data).join(F.broadcast(kinds), "column_name").selectExpr(
        "column_name", "kind", "total_rows - missing_count AS values"
    )


COLUMN_KINDS = f"""WITH {KEYED_SQL}, t AS (SELECT * FROM keyed UNION ALL SELECT * FROM keyed WHERE o_orderkey % 50 = 0)
SELECT 'custkey' AS column_name, 'numeric' AS kind, count(custkey) AS values FROM t
UNION ALL SELECT 'total', 'numeric', count(total) FROM t UNION ALL SELECT 'status', 'text', count(status) FROM t
UNION ALL SELECT 'priority', 'text', count(priority) FROM t UNION ALL SELECT 'note', 'text', count(note) FROM t"""


def column_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Columns under their cleaned names, with the number of their values."""
    data = table(spark, folder, "part").withColumnRenamed("p_name", "  p   name  ")
    names = column_list(data).withColumnRenamed("data_type", "listed_type")
    return column_quality(data).select("position", "total_rows").join(F.broadcast(names), "position").selectExpr(
        "position", "column_name", "listed_type", "total_rows"
    )


COLUMN_LISTING = """SELECT p AS position, n AS column_name, t AS listed_type, (SELECT count(*) FROM part) AS total_rows
FROM (VALUES (0, 'p_partkey', 'bigint'), (1, 'p name', 'string'), (2, 'p_brand', 'string'), (3, 'p_type', 'string'),
 (4, 'p_size', 'int'), (5, 'p_retailprice', 'double')) v(p, n, t)"""


def structure_check(spark: SparkSession, folder: str) -> DataFrame:
    return check_structure(table(spark, folder, "orders"))


def preview_rows(spark: SparkSession, folder: str) -> DataFrame:
    return preview(table(spark, folder, "documents").select("doc_id", "lang", "text"), key=["doc_id"])


PREVIEW = """SELECT doc_id, lang, CASE WHEN length(text) > 50 THEN concat(substring(text, 1, 50), '...') ELSE text END
 AS text FROM documents ORDER BY doc_id LIMIT 5"""

MESSY = "CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE CAST(o_custkey AS STRING) END"


def coerce_numeric(spark: SparkSession, folder: str) -> DataFrame:
    data = table(spark, folder, "orders").selectExpr("o_orderkey", f"{MESSY} AS amount")
    return data.select("o_orderkey", prepare.coerce_numeric(col("amount")).alias("amount"))


def impute_median(spark: SparkSession, folder: str) -> DataFrame:
    data = dirty(spark, folder, key=True)
    fitted = prepare.fit_preparation(data, "o_orderkey", ["total"], "regression")
    return fitted.impute(data.select("o_orderkey", "total")).select("o_orderkey", F.round("total", 6).alias("total"))


def impute_mode(spark: SparkSession, folder: str) -> DataFrame:
    data = dirty(spark, folder, key=True)
    fitted = prepare.fit_preparation(data, "o_orderkey", ["priority"], "regression")
    return fitted.impute(data.select("o_orderkey", "priority"))


MODE_SQL = "(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
IMPUTE_MODE = f"""WITH {KEYED_SQL} SELECT o_orderkey, coalesce(priority, {MODE_SQL.format(c="priority", t="keyed")})
 AS priority FROM keyed"""


def mode_table(spark: SparkSession, folder: str) -> DataFrame:
    """Most frequent value of several text columns in one shuffle."""
    return most_frequent(value_counts(table(spark, folder, "part"), ["p_brand", "p_type", "p_name"]))


MODE_TABLE = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {MODE_SQL.format(c=c, t='part')} AS value" for c in ("p_brand", "p_type", "p_name")
)


def encode_features(spark: SparkSession, folder: str) -> DataFrame:
    data = table(spark, folder, "part")
    fitted = prepare.fit_preparation(data, "p_retailprice", ["p_brand", "p_type", "p_name"], "regression")
    return fitted.transform_features(data).select("p_partkey", "p_brand", "p_type", "p_name")


_CODES = ", ".join(
    f"c{i} AS (SELECT {c}, (row_number() OVER (ORDER BY {c}) - 1)::DOUBLE AS k FROM (SELECT DISTINCT {c} FROM part))"
    for i, c in enumerate(("p_brand", "p_type", "p_name"))
)
ENCODE_FEATURES = f"""WITH {_CODES} SELECT p_partkey, c0.k AS p_brand, c1.k AS p_type, c2.k AS p_name
FROM part JOIN c0 USING (p_brand) JOIN c1 USING (p_type) JOIN c2 USING (p_name)"""


def encode_target(spark: SparkSession, folder: str) -> DataFrame:
    """A numeric target is coded by its text, so 10 comes before 2."""
    data = table(spark, folder, "part")
    fitted = prepare.fit_preparation(data, "p_size", ["p_retailprice"])
    return fitted.transform_target(data).select("p_partkey", "p_size", "label")


ENCODE_TARGET = """WITH c AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::DOUBLE AS label
 FROM (SELECT DISTINCT p_size::VARCHAR AS v FROM part))
SELECT p_partkey, p_size, label FROM part JOIN c ON p_size::VARCHAR = v"""


def class_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.class_distribution(dirty(spark, folder), "priority")


CLASS_DISTRIBUTION = f"""WITH {KEYED_SQL}, t AS (SELECT priority FROM keyed
 UNION ALL SELECT priority FROM keyed WHERE o_orderkey % 50 = 0)
SELECT priority AS class, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct
FROM t WHERE priority IS NOT NULL GROUP BY priority"""


def target_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.target_histogram(table(spark, folder, "lineitem"), "l_extendedprice")


def target_histogram_discrete(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.target_histogram(table(spark, folder, "lineitem"), "l_tax")


def _histogram_sql(c: str) -> str:
    return f"""WITH f AS (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, count(*) AS total,
 CASE WHEN count(DISTINCT {c}) > 10 THEN least(20, count(DISTINCT {c}) // 2 + 1) ELSE count(DISTINCT {c}) END AS k
 FROM lineitem), b AS (SELECT least(floor(({c} - lo) / (hi - lo) * k), k - 1)::INT AS bin, count(*) AS n
 FROM lineitem, f GROUP BY 1), s AS (SELECT unnest(range(k))::INT AS bin FROM f)
SELECT s.bin, printf('%.2f-%.2f', lo + s.bin * ((hi - lo) / k), CASE WHEN s.bin = k - 1 THEN hi
 ELSE lo + (s.bin + 1) * ((hi - lo) / k) END) AS bin_label, coalesce(n, 0) AS n,
 round(coalesce(n, 0) * 100.0::DOUBLE / total, 2) AS pct FROM s CROSS JOIN f LEFT JOIN b ON s.bin = b.bin"""


def target_statistics(spark: SparkSession, folder: str) -> DataFrame:
    out = prepare.target_statistics(dirty(spark, folder), "total")
    return out.select("n", "target_min", "target_max", *[F.round(c, 4).alias(c) for c in ("target_mean", "target_std")])


TARGET_STATISTICS = f"""WITH {KEYED_SQL}, t AS (SELECT total FROM keyed
 UNION ALL SELECT total FROM keyed WHERE o_orderkey % 50 = 0)
SELECT count(total) AS n, min(total) AS target_min, max(total) AS target_max, round(avg(total), 4) AS target_mean,
 round(stddev_samp(total), 4) AS target_std FROM t"""

_PREDICTORS = ["total", "priority", "note"]


def preparation_report(spark: SparkSession, folder: str) -> DataFrame:
    data = dirty(spark, folder, key=True)
    fitted = prepare.fit_preparation(data, "status", _PREDICTORS)
    return prepare.preparation_report(data, fitted)


PREPARATION_REPORT = f"""WITH {KEYED_SQL} SELECT count(*) AS original_rows, count(status) AS rows_after,
 count(*) - count(status) AS dropped_rows, 2 AS features,
 4 * count(*) - count(total) - count(priority) - count(note) - count(status) AS nulls_before,
 0::BIGINT AS nulls_after, true AS imputation_applied, 'note' AS dropped_features,
 concat('{{"priority": "categorical (encoded: ', count(DISTINCT priority) FILTER (status IS NOT NULL),
 ' categories)", "total": "numeric (double)"}}') AS feature_types FROM keyed"""


def prepared_table(spark: SparkSession, folder: str) -> DataFrame:
    """Coerced, imputed and coded rows, checked to have nothing missing."""
    data = dirty(spark, folder, key=True)
    fitted = prepare.fit_preparation(data, "status", _PREDICTORS)
    return check_prepared(data, fitted).select("o_orderkey", F.round("total", 6).alias("total"), "priority", "label")


PREPARED_TABLE = f"""WITH {KEYED_SQL}, u AS (SELECT * FROM keyed WHERE status IS NOT NULL),
 m AS (SELECT median(total) AS med, {MODE_SQL.format(c="priority", t="u")} AS mo FROM u),
 p AS (SELECT priority, (row_number() OVER (ORDER BY priority) - 1)::DOUBLE AS k
   FROM (SELECT DISTINCT priority FROM u WHERE priority IS NOT NULL)),
 s AS (SELECT status, (row_number() OVER (ORDER BY status) - 1)::DOUBLE AS label FROM (SELECT DISTINCT status FROM u))
SELECT o_orderkey, round(coalesce(total, med), 6) AS total, p.k AS priority, label
FROM u CROSS JOIN m JOIN p ON p.priority = coalesce(u.priority, mo) JOIN s ON s.status = u.status"""


def split_stratified(spark: SparkSession, folder: str) -> DataFrame:
    data = table(spark, folder, "orders").selectExpr("o_orderkey", f"{RARE} AS label")
    return split.train_test_split(data, ["o_orderkey"], "label").data.select("o_orderkey", "label", "is_test")


_LABELLED = f"labelled AS (SELECT o_orderkey, {RARE} AS label FROM orders)"
_COMMON = f"""{_LABELLED}, common AS (SELECT * FROM labelled WHERE label IN
 (SELECT label FROM labelled GROUP BY label HAVING count(*) >= 2))"""
SPLIT_STRATIFIED = f"""WITH {_COMMON}, {split_sql("common", "o_orderkey", "label")}
SELECT o_orderkey, label, is_test FROM flagged"""


def split_plain(spark: SparkSession, folder: str) -> DataFrame:
    data = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return split.train_test_split(data, ["o_orderkey"]).data.select("o_orderkey", "is_test")


SPLIT_PLAIN = f"""WITH src AS (SELECT o_orderkey FROM orders), {split_sql("src", "o_orderkey", None)}
SELECT o_orderkey, is_test FROM flagged"""


def split_summary(spark: SparkSession, folder: str) -> DataFrame:
    data = table(spark, folder, "orders").selectExpr("o_orderkey", f"{RARE} AS label")
    return training_summary(split.train_test_split(data, ["o_orderkey"], "label"))


SPLIT_SUMMARY = f"""WITH {_COMMON}, a AS (SELECT count(*) AS r, count(DISTINCT label) AS c FROM labelled),
 b AS (SELECT count(*) AS r, count(DISTINCT label) AS c FROM common)
SELECT a.r AS original_rows, a.c AS original_classes, b.r AS rows, b.c AS classes, b.r - (b.r + 4) // 5 AS train_size,
 (b.r + 4) // 5 AS test_size, a.c - b.c AS classes_removed, true AS stratified FROM a, b"""

QUERIES = {
    "select_columns": (select_columns, "SELECT o_orderstatus, o_totalprice, o_orderpriority FROM orders"),
    "drop_missing_target": (
        drop_missing_target,
        f"WITH {KEYED_SQL} SELECT o_orderkey, priority FROM keyed WHERE priority IS NOT NULL",
    ),
    "drop_rare_classes": (drop_rare_classes, f"WITH {_COMMON} SELECT o_orderkey, label FROM common"),
    "column_kinds": (column_kinds, COLUMN_KINDS),
    "column_listing": (column_listing, COLUMN_LISTING),
    "structure_check": (
        structure_check,
        "SELECT 6 AS columns, count(*) > 0 AS has_rows, count(*) > 0 AS is_valid FROM orders",
    ),
    "preview_rows": (preview_rows, PREVIEW),
    "coerce_numeric": (
        coerce_numeric,
        f"SELECT o_orderkey, TRY_CAST({MESSY} AS DOUBLE) AS amount FROM orders",
    ),
    "impute_median": (
        impute_median,
        f"WITH {KEYED_SQL} SELECT o_orderkey, round(coalesce(total, (SELECT median(total) FROM keyed)), 6) AS total FROM keyed",
    ),
    "impute_mode": (impute_mode, IMPUTE_MODE),
    "mode_table": (mode_table, MODE_TABLE),
    "encode_features": (encode_features, ENCODE_FEATURES),
    "encode_target": (encode_target, ENCODE_TARGET),
    "class_distribution": (class_distribution, CLASS_DISTRIBUTION),
    "target_histogram": (target_histogram, _histogram_sql("l_extendedprice")),
    "target_histogram_discrete": (target_histogram_discrete, _histogram_sql("l_tax")),
    "target_statistics": (target_statistics, TARGET_STATISTICS),
    "preparation_report": (preparation_report, PREPARATION_REPORT),
    "prepared_table": (prepared_table, PREPARED_TABLE),
    "split_stratified": (split_stratified, SPLIT_STRATIFIED),
    "split_plain": (split_plain, SPLIT_PLAIN),
    "split_summary": (split_summary, SPLIT_SUMMARY),
}

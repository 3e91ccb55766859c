"""Scoring, registry and retraining queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns
from ..functions.sizing import shared_folder
from ..operators import score
from ..operators.prepare import fit_preparation
from ..operators.retrain import (
    REGRESSION_METRICS,
    align_records,
    append_records,
    compare_metrics,
    stored_kinds,
)
from ..plans.training import retrain, train
from ..sources.registry import list_models, load_metadata, load_model, save_model
from ..sources.tables import records_from_json
from .inputs import split_sql, table
from .models import FEATURES, embedding_columns

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
NOW = datetime(2024, 3, 9, 14, 5, 0)


# --- scoring ------------------------------------------------------------------------


def compatibility(spark: SparkSession, folder: str) -> DataFrame:
    """A table without one feature and with another as text, against a fitted preparation."""
    part = table(spark, folder, "part")
    fitted = fit_preparation(part, "p_retailprice", ["p_size", "p_type", "p_brand"], "regression")
    other = part.selectExpr("p_partkey", "CAST(p_size AS STRING) AS p_size", "p_type")
    return score.check_compatibility(other, fitted)


COMPATIBILITY = """SELECT false AS compatible, 'p_brand' AS missing_columns,
 '''p_size'' should be numeric but is categorical' AS type_warnings,
 CASE WHEN count(*) < 5 THEN 'only ' || count(*) || ' rows; at least 5 are recommended' END AS few_rows_warning,
 3 AS required_columns, 3 AS available_columns FROM part"""


def scoring_features(spark: SparkSession, folder: str) -> DataFrame:
    """New rows with gaps and unseen types, prepared with the statistics of other rows."""
    part = table(spark, folder, "part")
    fitted = fit_preparation(
        part.where("p_partkey % 2 = 0"), "p_retailprice", ["p_size", "p_type"], "regression"
    )
    new = part.where("p_partkey % 2 = 1").selectExpr(
        "p_partkey",
        "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS p_size",
        "CASE WHEN p_partkey % 5 = 0 THEN 'UNSEEN' WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS p_type",
    )
    return fitted.transform_features(new)


SCORING_FEATURES = """WITH t AS (SELECT * FROM part WHERE p_partkey % 2 = 0),
m AS (SELECT median(p_size)::DOUBLE AS med, (SELECT p_type FROM t GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 1) AS mo FROM t),
c AS (SELECT p_type, (row_number() OVER (ORDER BY p_type) - 1)::DOUBLE AS k FROM (SELECT DISTINCT p_type FROM t)),
n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS s,
 CASE WHEN p_partkey % 5 = 0 THEN 'UNSEEN' WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS y
 FROM part WHERE p_partkey % 2 = 1)
SELECT p_partkey, coalesce(s::DOUBLE, med) AS p_size, coalesce(k, 0) AS p_type
FROM n CROSS JOIN m LEFT JOIN c ON c.p_type = coalesce(y, mo)"""


def _price_model(spark: SparkSession, folder: str):
    return train(table(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity"], "linear_regression", KEY)


def _price_raw(spark: SparkSession, folder: str) -> DataFrame:
    trained = _price_model(spark, folder)
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return score.raw_predictions(lines, trained.fitted, trained.preparation)


_LINE_ID = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
_PRICE = f"""src AS (SELECT {_LINE_ID} AS id, l_quantity AS x, l_extendedprice AS y FROM lineitem),
{split_sql("src", "id", None)},
w AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM flagged WHERE NOT is_test),
scored AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, a + b * l_quantity AS p FROM lineitem, w)"""


def score_regression(spark: SparkSession, folder: str) -> DataFrame:
    out = score.present_regression(_price_raw(spark, folder))
    for c in (score.PREDICTION, score.LOWER, score.UPPER):
        out = out.withColumn(c, F.round(c, 3))
    return out


SCORE_REGRESSION = f"""WITH {_PRICE}, s AS (SELECT stddev_pop(p) AS sd FROM scored)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, round(p, 3) AS "Prediccion",
 round(p - sd, 3) AS "Confianza_Inferior", round(p + sd, 3) AS "Confianza_Superior" FROM scored, s"""


def score_regression_statistics(spark: SparkSession, folder: str) -> DataFrame:
    out = score.regression_statistics(_price_raw(spark, folder))
    return out.select(*[F.round(c, 3).alias(c) if c != "total_predictions" else F.col(c) for c in out.columns])


SCORE_REGRESSION_STATISTICS = f"""WITH {_PRICE} SELECT count(*) AS total_predictions, round(avg(p), 3) AS prediction_mean,
 round(stddev_pop(p), 3) AS prediction_std, round(min(p), 3) AS prediction_min, round(max(p), 3) AS prediction_max FROM scored"""

FLAG_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _flag_raw(spark: SparkSession, folder: str):
    """Return flag by naive Bayes on four numbers, scored on every line."""
    lines = table(spark, folder, "lineitem")
    trained = train(lines, "l_returnflag", FLAG_FEATURES, "naive_bayes", KEY)
    new = lines.select("l_orderkey", "l_partkey", *FLAG_FEATURES)
    return score.raw_predictions(new, trained.fitted, trained.preparation), trained.preparation


_CELLS = " + ".join(f"-0.5 * ln(2 * pi() * v{i}) - 0.5 * ({c} - m{i}) ** 2 / v{i}" for i, c in enumerate(FLAG_FEATURES))
_FLAG = f"""src AS (SELECT {_LINE_ID} AS id, l_returnflag AS label, {", ".join(FLAG_FEATURES)} FROM lineitem),
{split_sql("src", "id", "label")},
smooth AS (SELECT 1e-9 * greatest({", ".join(f"var_pop({c})" for c in FLAG_FEATURES)}) AS s FROM flagged WHERE NOT is_test),
stats AS (SELECT label AS c, ln(count(*) / sum(count(*)) OVER ()) AS lp,
 {", ".join(f"avg({c}) AS m{i}, var_pop({c}) + any_value(s) AS v{i}" for i, c in enumerate(FLAG_FEATURES))}
 FROM flagged, smooth WHERE NOT is_test GROUP BY label),
lines AS (SELECT row_number() OVER () AS rid, l_orderkey, l_partkey, {", ".join(FLAG_FEATURES)} FROM lineitem),
joint AS (SELECT rid, l_orderkey, l_partkey, {", ".join(FLAG_FEATURES)}, c, lp + {_CELLS} AS ll FROM lines, stats),
best AS (SELECT *, max(ll) OVER (PARTITION BY rid) AS top FROM joint),
share AS (SELECT *, exp(ll - top) / sum(exp(ll - top)) OVER (PARTITION BY rid) AS p FROM best),
nb AS (SELECT rid, l_orderkey, l_partkey, {", ".join(FLAG_FEATURES)}, arg_max(c, ll) AS pred, max(p) AS conf,
 max(p) FILTER (c = 'A') AS pa, max(p) FILTER (c = 'N') AS pn, max(p) FILTER (c = 'R') AS pr
 FROM share GROUP BY ALL)"""


def score_classification(spark: SparkSession, folder: str) -> DataFrame:
    raw, preparation = _flag_raw(spark, folder)
    return score.present_classes(raw, preparation)


SCORE_CLASSIFICATION = f"""WITH {_FLAG} SELECT l_orderkey, l_partkey, {", ".join(FLAG_FEATURES)},
 CASE pred WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS "Prediccion_Numerica", pred AS "Prediccion",
 round(conf * 100, 2) AS "Confianza", round(pa * 100, 2) AS "Prob_A", round(pn * 100, 2) AS "Prob_N",
 round(pr * 100, 2) AS "Prob_R" FROM nb"""


def score_classification_statistics(spark: SparkSession, folder: str) -> DataFrame:
    raw, _ = _flag_raw(spark, folder)
    return score.classification_statistics(raw)


SCORE_CLASSIFICATION_STATISTICS = f"""WITH {_FLAG} SELECT count(*) AS total_predictions,
 count(DISTINCT pred) AS unique_predictions, round(avg(conf) * 100, 2) AS avg_confidence FROM nb"""


def prediction_distribution(spark: SparkSession, folder: str) -> DataFrame:
    raw, preparation = _flag_raw(spark, folder)
    return score.prediction_distribution(score.present_classes(raw, preparation))


PREDICTION_DISTRIBUTION = f"""WITH {_FLAG} SELECT pred AS prediction, count(*) AS n,
 round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM nb GROUP BY pred"""


def class_mapping(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return score.class_mapping(fit_preparation(part, "p_brand", ["p_size"]))


CLASS_MAPPING = """SELECT (row_number() OVER (ORDER BY p_brand) - 1)::INT AS code, p_brand AS class
FROM (SELECT DISTINCT p_brand FROM part)"""


# --- registry -----------------------------------------------------------------------


def model_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Train, store and list a model."""
    root = shared_folder(spark, "registry")
    trained = train(embedding_columns(spark, folder), "label", FEATURES, "naive_bayes", ["vec_id"])
    save_model(spark, root, trained, "embeddings by label!", NOW)
    return list_models(spark, root).selectExpr(
        "model_name",
        "model_type",
        "task_type",
        "target_column",
        "n_features",
        "n_classes",
        "created_at_formatted",
        "cast(metrics['train_size'] AS bigint) AS train_size",
        "cast(metrics['test_size'] AS bigint) AS test_size",
    )


MODEL_LISTING = """SELECT 'embeddingsbylabel' AS model_name, 'naive_bayes' AS model_type, 'classification' AS task_type,
 'label' AS target_column, 64 AS n_features, count(DISTINCT label)::INT AS n_classes,
 '09/03/2024 14:05' AS created_at_formatted, count(*) - (count(*) + 4) // 5 AS train_size,
 (count(*) + 4) // 5 AS test_size FROM embeddings"""


def stored_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Store a regression, load it in full and score with the loaded parts."""
    root = shared_folder(spark, "registry")
    name = save_model(spark, root, _price_model(spark, folder), "prices", NOW)
    fitted, preparation, _ = load_model(spark, root, name)
    lines = table(spark, folder, "lineitem").select("l_quantity").distinct()
    raw = score.raw_predictions(lines, fitted, preparation)
    return raw.select("__row.l_quantity", F.round("prediction", 3).alias("prediction"))


STORED_MODEL_SCORES = f"""WITH {_PRICE} SELECT DISTINCT l_quantity, round(p, 3) AS prediction FROM scored"""


# --- retraining ---------------------------------------------------------------------

_RECORD_FIELDS = ["o_orderkey", "o_totalprice", "o_orderpriority"]


def json_records(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of a customer packed as a JSON array of new records, and unfolded again."""
    return _records(table(spark, folder, "orders"))


def _new_records(spark: SparkSession, folder: str) -> DataFrame:
    """The orders with odd keys, as records that come in later."""
    return _records(table(spark, folder, "orders").where("o_orderkey % 2 = 1"))


def _records(orders: DataFrame) -> DataFrame:
    # Arrays are packed per order and line, so no array grows with a customer.
    packed = orders.select(
        F.to_json(
            F.array(
                F.struct(
                    F.col("o_orderstatus").alias("target_value"),
                    F.col("o_orderkey").cast("string").alias("o_orderkey"),
                    F.when(F.col("o_orderkey") % 13 == 0, "unknown")
                    .otherwise(F.col("o_totalprice").cast("string"))
                    .alias("o_totalprice"),
                    "o_orderpriority",
                )
            )
        ).alias("records")
    )
    return records_from_json(packed, "records", "o_orderstatus", _RECORD_FIELDS)


JSON_RECORDS = """SELECT o_orderstatus, o_orderkey::VARCHAR AS o_orderkey,
 CASE WHEN o_orderkey % 13 = 0 THEN 'unknown' ELSE o_totalprice::VARCHAR END AS o_totalprice, o_orderpriority
FROM orders"""


def _original(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").where("o_orderkey % 2 = 0").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_custkey"
    )


def align_new_records(spark: SparkSession, folder: str) -> DataFrame:
    original = _original(spark, folder)
    kinds = stored_kinds(original, ["o_orderstatus", *_RECORD_FIELDS])
    return align_records(_new_records(spark, folder), kinds)


ALIGN = """SELECT o_orderstatus, o_orderkey::DOUBLE AS o_orderkey,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderpriority
FROM orders WHERE o_orderkey % 2 = 1"""


def append_new_records(spark: SparkSession, folder: str) -> DataFrame:
    original = _original(spark, folder)
    kinds = stored_kinds(original, ["o_orderstatus", *_RECORD_FIELDS])
    return append_records(original, align_records(_new_records(spark, folder), kinds), kinds)


APPEND = """SELECT o_orderkey::DOUBLE AS o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 13 = 0
 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderpriority,
 CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS o_custkey FROM orders"""


def retrain_lineage(spark: SparkSession, folder: str) -> DataFrame:
    """Retrain a stored ridge regression and report what it was trained on."""
    root = shared_folder(spark, "registry")
    orders = table(spark, folder, "orders")
    first = train(
        orders.where("o_orderkey % 2 = 0"),
        "o_totalprice",
        ["o_orderpriority", "o_custkey"],
        "ridge_regression",
        ["o_orderkey"],
        alpha=10.0,
    )
    name = save_model(spark, root, first, "prices", NOW)
    records = orders.where("o_orderkey % 2 = 1").selectExpr(
        "CAST(o_totalprice AS STRING) AS o_totalprice", "o_orderpriority", "CAST(o_custkey AS STRING) AS o_custkey", "o_orderkey"
    )
    again = retrain(orders.where("o_orderkey % 2 = 0"), records, load_metadata(spark, root, name), ["o_orderkey"])
    final = save_model(spark, root, again, "prices_again", NOW)
    return spark.createDataFrame([load_metadata(spark, root, final)], _LINEAGE_SCHEMA).selectExpr(
        "model_name",
        "retrained_from",
        "original_records",
        "new_records_added",
        "total_records",
        "cast(metrics['train_size'] AS bigint) AS train_size",
        "get_json_object(model_params, '$.alpha') AS alpha",
    )


_LINEAGE_SCHEMA = (
    "model_name string, retrained_from string, original_records bigint, new_records_added bigint,"
    " total_records bigint, metrics map<string,double>, model_params string"
)
RETRAIN = """SELECT 'prices_again' AS model_name, 'prices' AS retrained_from,
 count(*) FILTER (o_orderkey % 2 = 0) AS original_records, count(*) FILTER (o_orderkey % 2 = 1) AS new_records_added,
 count(*) AS total_records, count(*) - (count(*) + 4) // 5 AS train_size, '10.0' AS alpha FROM orders"""


def compare_models(spark: SparkSession, folder: str) -> DataFrame:
    """Two fixed price formulas as old and new model."""
    lines = table(spark, folder, "lineitem")

    def metrics(factor: str) -> DataFrame:
        error = F.expr(f"l_extendedprice - l_quantity * {factor}")
        row = lines.agg(
            F.avg(error * error).alias("test_mse"),
            F.avg(F.abs(error)).alias("test_mae"),
            (1.0 - F.avg(error * error) / F.var_pop("l_extendedprice")).alias("test_r2"),
        )
        return row.selectExpr(
            "stack(3, 'test_mse', test_mse, 'test_mae', test_mae, 'test_r2', test_r2) AS (metric, value)"
        )

    out = compare_metrics(metrics("1400.0D"), metrics("1500.0D"), REGRESSION_METRICS)
    for c in numeric_columns(out):
        if c != "position":
            out = out.withColumn(c, F.round(c, 3))
    return out


COMPARE = """WITH e AS (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 1400.0::DOUBLE AS o,
 l_extendedprice - l_quantity * 1500.0::DOUBLE AS n FROM lineitem),
f AS (SELECT 0 AS position, 'test_r2' AS metric, 1 - avg(o * o) / var_pop(y) AS old_value, 1 - avg(n * n) / var_pop(y) AS new_value, 1 AS s FROM e
 UNION ALL SELECT 1, 'test_mse', avg(o * o), avg(n * n), -1 FROM e
 UNION ALL SELECT 2, 'test_mae', avg(abs(o)), avg(abs(n)), -1 FROM e)
SELECT position, metric, round(old_value, 3) AS old_value, round(new_value, 3) AS new_value,
 round(s * (new_value - old_value), 3) AS improvement,
 CASE WHEN s * (new_value - old_value) > 0.0001 THEN 'better' WHEN s * (new_value - old_value) < -0.0001 THEN 'worse'
  WHEN new_value = old_value THEN 'identical' ELSE 'minimal' END AS verdict FROM f"""

QUERIES = {
    "compatibility": (compatibility, COMPATIBILITY),
    "scoring_features": (scoring_features, SCORING_FEATURES),
    "score_regression": (score_regression, SCORE_REGRESSION),
    "score_regression_statistics": (score_regression_statistics, SCORE_REGRESSION_STATISTICS),
    "score_classification": (score_classification, SCORE_CLASSIFICATION),
    "score_classification_statistics": (score_classification_statistics, SCORE_CLASSIFICATION_STATISTICS),
    "prediction_distribution": (prediction_distribution, PREDICTION_DISTRIBUTION),
    "class_mapping": (class_mapping, CLASS_MAPPING),
    "model_listing": (model_listing, MODEL_LISTING),
    "stored_model_scores": (stored_model_scores, STORED_MODEL_SCORES),
    "json_records": (json_records, JSON_RECORDS),
    "align_new_records": (align_new_records, ALIGN),
    "append_new_records": (append_new_records, APPEND),
    "retrain_lineage": (retrain_lineage, RETRAIN),
    "compare_models": (compare_models, COMPARE),
}

"""Model and evaluation queries."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate
from ..operators.models import (
    coefficient_table,
    equation,
    fit_spark_model,
    importance_table,
    model_parameters,
    top_importance,
)
from ..plans.training import TrainedModel, predictions, train
from .inputs import split_sql, table

DIMENSIONS = 64


def embedding_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings with one column per dimension."""
    data = table(spark, folder, "embeddings")
    return data.selectExpr(
        "vec_id", "label", *[f"cast(embedding[{i}] AS double) AS e{i}" for i in range(DIMENSIONS)]
    )


FEATURES = [f"e{i}" for i in range(DIMENSIONS)]


def _embedding_model(spark: SparkSession, folder: str, model: str, **params) -> TrainedModel:
    return train(embedding_columns(spark, folder), "label", FEATURES, model, ["vec_id"], **params)


# --- naive Bayes ------------------------------------------------------------------


def naive_bayes(spark: SparkSession, folder: str) -> DataFrame:
    trained = _embedding_model(spark, folder, "naive_bayes")
    scored = trained.fitted.predict(trained.split.test)
    return scored.select(
        F.col("__id").alias("vec_id"), "label", "prediction", F.round(F.array_max("probability"), 6).alias("confidence")
    )


_EMBED = """src AS (SELECT vec_id, (dense_rank() OVER (ORDER BY label::VARCHAR) - 1)::DOUBLE AS label,
 embedding::DOUBLE[] AS e FROM embeddings)"""
_EMBED_SPLIT = f"{_EMBED}, {split_sql('src', 'vec_id', 'label')}"
_NB = f"""{_EMBED_SPLIT},
cells AS (SELECT vec_id, label, is_test, unnest(e) AS x, unnest(range(len(e))) AS j FROM flagged),
smooth AS (SELECT 1e-9 * max(v) AS s FROM (SELECT var_pop(x) AS v FROM cells WHERE NOT is_test GROUP BY j)),
stats AS (SELECT label AS c, j, avg(x) AS m, var_pop(x) + (SELECT s FROM smooth) AS v
 FROM cells WHERE NOT is_test GROUP BY label, j),
prior AS (SELECT label AS c, ln(count(*) / sum(count(*)) OVER ()) AS lp FROM flagged WHERE NOT is_test GROUP BY label),
joint AS (SELECT vec_id, label, c, any_value(lp) + sum(-0.5 * ln(2 * pi() * v) - 0.5 * (x - m) * (x - m) / v) AS ll
 FROM cells JOIN stats USING (j) JOIN prior USING (c) WHERE is_test GROUP BY vec_id, label, c),
top AS (SELECT *, max(ll) OVER (PARTITION BY vec_id) AS best FROM joint),
nb AS (SELECT vec_id, label, arg_max(c, ll) AS prediction, round(1 / sum(exp(ll - best)), 6) AS confidence
 FROM top GROUP BY vec_id, label)"""


# --- neighbours -------------------------------------------------------------------


def knn(spark: SparkSession, folder: str) -> DataFrame:
    trained = _embedding_model(spark, folder, "knn", n_neighbors=5)
    scored = trained.fitted.predict(trained.split.test)
    return scored.select(
        F.col("__id").alias("vec_id"), "label", "prediction", F.round(F.array_max("probability"), 6).alias("confidence")
    )


_PAIRS = f"""{_EMBED_SPLIT},
near AS (SELECT q.vec_id, q.label AS truth, t.label, row_number() OVER (PARTITION BY q.vec_id
 ORDER BY list_distance(q.e, t.e), t.vec_id) AS r, list_distance(q.e, t.e) AS d
 FROM flagged q JOIN flagged t ON q.is_test AND NOT t.is_test)"""
KNN = f"""WITH {_PAIRS},
votes AS (SELECT vec_id, truth, label, count(*) AS n FROM near WHERE r <= 5 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS p FROM votes)
SELECT vec_id, truth AS label, label AS prediction, round(n / 5.0::DOUBLE, 6) AS confidence FROM best WHERE p = 1"""


def knn_weighted(spark: SparkSession, folder: str) -> DataFrame:
    trained = _embedding_model(spark, folder, "knn", n_neighbors=7, weights="distance")
    scored = trained.fitted.predict(trained.split.test)
    return scored.select(F.col("__id").alias("vec_id"), "prediction")


KNN_WEIGHTED = f"""WITH {_PAIRS},
votes AS (SELECT vec_id, label, sum(1 / d) AS w FROM near WHERE r <= 7 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(w, 12) DESC, label) AS p FROM votes)
SELECT vec_id, label AS prediction FROM best WHERE p = 1"""


def knn_regression(spark: SparkSession, folder: str) -> DataFrame:
    """Small integer features, so most distances are tied and settled by key."""
    data = table(spark, folder, "part")
    trained = train(data, "p_retailprice", ["p_size", "p_type"], "knn_regressor", ["p_partkey"], n_neighbors=5)
    return predictions(trained).select(
        F.col("__id").alias("p_partkey"), "label", F.round("prediction", 6).alias("prediction")
    )


KNN_REGRESSION = f"""WITH c AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS k
 FROM (SELECT DISTINCT p_type FROM part)),
src AS (SELECT p_partkey, p_retailprice AS label, p_size AS x, k AS y FROM part JOIN c USING (p_type)),
{split_sql("src", "p_partkey", None)},
near AS (SELECT q.p_partkey, q.label AS truth, t.label, row_number() OVER (PARTITION BY q.p_partkey
 ORDER BY sqrt(((q.x - t.x) ** 2 + (q.y - t.y) ** 2)::DOUBLE), t.p_partkey) AS r
 FROM flagged q JOIN flagged t ON q.is_test AND NOT t.is_test)
SELECT p_partkey, truth AS label, round(avg(label), 6) AS prediction FROM near WHERE r <= 5 GROUP BY p_partkey, truth"""


# --- linear models ----------------------------------------------------------------


def _price_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    lines = table(spark, folder, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(lines)
    return rows.select("features", "label"), rows.count()


def _linear(model: str, digits: int, **params):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows, n = _price_rows(spark, folder)
        fitted = fit_spark_model(rows, model, model_parameters(model, params), n, 0)
        return coefficient_table(spark, fitted, ["l_quantity"]).select(
            "position", "term", F.round("coefficient", digits).alias("coefficient")
        )

    return run


def _linear_sql(slope: str, digits: int) -> str:
    return f"""WITH f AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my,
 var_pop(l_quantity) AS vx, covar_pop(l_extendedprice, l_quantity) AS cxy FROM lineitem),
 w AS (SELECT {slope} AS b, mx, my FROM f)
SELECT 0 AS position, '(intercept)' AS term, round(my - b * mx, {digits}) AS coefficient FROM w
UNION ALL SELECT 1, 'l_quantity', round(b, {digits}) FROM w"""


def linear_equation(spark: SparkSession, folder: str) -> DataFrame:
    rows, n = _price_rows(spark, folder)
    fitted = fit_spark_model(rows, "linear_regression", model_parameters("linear_regression", {}), n, 0)
    return equation(coefficient_table(spark, fitted, ["l_quantity"]), "l_extendedprice")


LINEAR_EQUATION = """SELECT concat('l_extendedprice = ', printf('%.4f', regr_intercept(l_extendedprice, l_quantity)),
 CASE WHEN regr_slope(l_extendedprice, l_quantity) < 0 THEN ' - ' ELSE ' + ' END,
 printf('%.4f', abs(regr_slope(l_extendedprice, l_quantity))), ' × l_quantity') AS equation FROM lineitem"""

PRICE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _metrics(target: str, features: list[str], model: str, **params):
    """Metrics of one training run on order lines."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        data = table(spark, folder, "lineitem")
        return train(data, target, features, model, LINE_KEY, **params).metric_table()

    return run


def _document_model(model: str, **params):
    """Quality of a document from its length, language and source."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
        data = docs.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")
        return train(data, "quality", ["n_chars", "lang", "source"], model, ["doc_id"], **params).metric_table()

    return run


def importance_top(spark: SparkSession, folder: str) -> DataFrame:
    trained = _embedding_model(spark, folder, "random_forest", n_estimators=50, max_depth=5)
    return top_importance(importance_table(spark, trained.fitted, FEATURES), 10)


# --- evaluation -------------------------------------------------------------------

# A fixed guess of the return flag, so that every class metric can be written in SQL.
GUESS = "CASE WHEN l_linestatus = 'F' AND l_quantity > 25 THEN 'R' WHEN l_linestatus = 'F' THEN 'A' ELSE 'X' END"


def _guessed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr("l_returnflag AS label", f"{GUESS} AS prediction")


_G = f"g AS (SELECT l_returnflag AS label, {GUESS} AS prediction FROM lineitem)"
_CLASSES = """k AS (SELECT label AS class FROM g UNION SELECT prediction FROM g),
h AS (SELECT label AS class, count(*) AS support, count(*) FILTER (label = prediction) AS hits FROM g GROUP BY 1),
p AS (SELECT prediction AS class, count(*) AS predicted FROM g GROUP BY 1),
r AS (SELECT class, coalesce(hits, 0) AS hits, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted
 FROM k LEFT JOIN h USING (class) LEFT JOIN p USING (class)),
m AS (SELECT class, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END::DOUBLE AS precision,
 CASE WHEN support > 0 THEN hits / support ELSE 0 END::DOUBLE AS recall,
 2.0::DOUBLE * hits / (predicted + support) AS f1, support FROM r)"""


def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.accuracy(_guessed(spark, folder)).select("n", F.round("accuracy", 9).alias("accuracy"))


def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion_matrix(_guessed(spark, folder))


CONFUSION = f"""WITH {_G}, k AS (SELECT label AS c FROM g UNION SELECT prediction FROM g),
n AS (SELECT label, prediction, count(*) AS n FROM g GROUP BY ALL)
SELECT a.c AS label, b.c AS prediction, coalesce(n, 0) AS n FROM k a CROSS JOIN k b
LEFT JOIN n ON n.label = a.c AND n.prediction = b.c"""


def _round9(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 9))
    return df


def class_report(spark: SparkSession, folder: str) -> DataFrame:
    return _round9(evaluate.class_report(_guessed(spark, folder)), ["precision", "recall", "f1"])


CLASS_REPORT = f"""WITH {_G}, {_CLASSES} SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall,
 round(f1, 9) AS f1, support FROM m"""


def averaged_report(spark: SparkSession, folder: str) -> DataFrame:
    return _round9(evaluate.averaged_report(_guessed(spark, folder)), ["precision", "recall", "f1"])


AVERAGED_REPORT = f"""WITH {_G}, {_CLASSES}
SELECT 'macro avg' AS average, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall,
 round(avg(f1), 9) AS f1, sum(support)::BIGINT AS support FROM m
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9),
 round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), sum(support)::BIGINT FROM m
UNION ALL SELECT 'accuracy', round(avg((label = prediction)::INT), 9), round(avg((label = prediction)::INT), 9),
 round(avg((label = prediction)::INT), 9), count(*) FROM g"""


def macro_micro(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluate.macro_micro(_guessed(spark, folder))
    return _round9(out, out.columns)


MACRO_MICRO = f"""WITH {_G}, {_CLASSES}, a AS (SELECT round(avg((label = prediction)::INT), 9) AS acc FROM g)
SELECT round(avg(precision), 9) AS precision_macro, round(avg(recall), 9) AS recall_macro, round(avg(f1), 9) AS f1_macro,
 any_value(acc) AS precision_micro, any_value(acc) AS recall_micro, any_value(acc) AS f1_micro FROM m, a"""


def nb_class_report(spark: SparkSession, folder: str) -> DataFrame:
    """Class report of a trained naive Bayes model on its test rows."""
    trained = _embedding_model(spark, folder, "naive_bayes")
    return _round9(evaluate.class_report(predictions(trained)), ["precision", "recall", "f1"])


NB_CLASS_REPORT = f"""WITH {_NB}, g AS (SELECT label, prediction FROM nb), {_CLASSES.replace("h AS", "hh AS").replace(
    "JOIN h ", "JOIN hh ").replace("p AS (SELECT prediction", "pp AS (SELECT prediction").replace("JOIN p ", "JOIN pp ")}
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM m"""

PRICE_GUESS = "l_quantity * 1450.0"


def _priced(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        *LINE_KEY[:-1], "l_extendedprice AS label", f"CAST({PRICE_GUESS} AS DOUBLE) AS prediction"
    )


_PRICE_METRICS = f"""SELECT count(*) AS n, avg((l_extendedprice - {PRICE_GUESS}) ** 2) AS mse,
 avg(abs(l_extendedprice - {PRICE_GUESS})) AS mae, var_pop(l_extendedprice) AS v FROM lineitem"""


def regression_report(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluate.regression_report(_priced(spark, folder))
    return out.select("n", *[F.round(c, d).alias(c) for c, d in (("mse", 1), ("rmse", 5), ("mae", 5), ("r2", 9))])


REGRESSION_REPORT = f"""WITH f AS ({_PRICE_METRICS})
SELECT n, round(mse, 1) AS mse, round(sqrt(mse), 5) AS rmse, round(mae, 5) AS mae, round(1 - mse / v, 9) AS r2 FROM f"""


def prediction_sample(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.prediction_sample(_priced(spark, folder), LINE_KEY[:-1])


PREDICTION_SAMPLE = f"""SELECT {", ".join(LINE_KEY[:-1])}, l_extendedprice AS label,
 ({PRICE_GUESS})::DOUBLE AS prediction FROM lineitem ORDER BY ALL LIMIT 10"""


def quality_band(spark: SparkSession, folder: str) -> DataFrame:
    """Bands per return flag, the first half of the orders as training side."""
    rows = table(spark, folder, "lineitem").selectExpr(
        "l_returnflag", "l_orderkey % 2 AS half", "l_extendedprice AS y", f"CAST({PRICE_GUESS} AS DOUBLE) AS p"
    )
    r2 = 1.0 - F.avg((F.col("y") - F.col("p")) ** 2) / F.var_pop("y")
    sides = rows.groupBy("l_returnflag").pivot("half", [0, 1]).agg(r2)
    named = sides.select("l_returnflag", F.col("0").alias("train_r2"), F.col("1").alias("test_r2"))
    return evaluate.quality_band(named).select("l_returnflag", "band", "overfit")


QUALITY_BAND = f"""WITH f AS (SELECT l_returnflag, l_orderkey % 2 AS half,
 1 - avg((l_extendedprice - {PRICE_GUESS}) ** 2) / var_pop(l_extendedprice) AS r2 FROM lineitem GROUP BY ALL),
 w AS (SELECT a.l_returnflag, a.r2 AS train_r2, b.r2 AS test_r2 FROM f a JOIN f b
  ON a.l_returnflag = b.l_returnflag AND a.half = 0 AND b.half = 1)
SELECT l_returnflag, CASE WHEN test_r2 >= 0.8 THEN 'excellent' WHEN test_r2 >= 0.6 THEN 'good'
 WHEN test_r2 >= 0.3 THEN 'fair' ELSE 'poor' END AS band, train_r2 - test_r2 > 0.1 AS overfit FROM w"""

QUERIES = {
    "naive_bayes": (naive_bayes, f"WITH {_NB} SELECT vec_id, label, prediction, confidence FROM nb"),
    "naive_bayes_class_report": (nb_class_report, NB_CLASS_REPORT),
    "knn": (knn, KNN),
    "knn_weighted": (knn_weighted, KNN_WEIGHTED),
    "knn_regression": (knn_regression, KNN_REGRESSION),
    "linear_regression": (_linear("linear_regression", 4), _linear_sql("cxy / vx", 4)),
    "linear_no_intercept": (
        _linear("linear_regression", 4, fit_intercept=False),
        """WITH w AS (SELECT sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) AS b FROM lineitem)
SELECT 0 AS position, '(intercept)' AS term, 0.0::DOUBLE AS coefficient UNION ALL
SELECT 1, 'l_quantity', round(b, 4) FROM w""",
    ),
    "ridge_regression": (
        _linear("ridge_regression", 3, alpha=100.0),
        _linear_sql("n * cxy / (n * vx + 100.0)", 3),
    ),
    "lasso_regression": (
        _linear("lasso_regression", 3, alpha=100.0),
        _linear_sql("sign(cxy) * greatest(abs(cxy) - 100.0, 0) / vx", 3),
    ),
    "elastic_net": (
        _linear("elastic_net", 3, alpha=10.0, l1_ratio=0.7),
        _linear_sql("sign(cxy) * greatest(abs(cxy) - 7.0, 0) / (vx + 3.0)", 3),
    ),
    "linear_equation": (linear_equation, LINEAR_EQUATION),
    "decision_tree": (_metrics("l_returnflag", ["l_quantity", "l_linestatus", "l_tax"], "decision_tree", max_depth=5), None),
    "random_forest": (_document_model("random_forest", n_estimators=50, max_depth=5), None),
    "logistic_regression": (_document_model("logistic_regression"), None),
    "linear_svc": (_document_model("svm"), None),
    "decision_tree_regressor": (
        _metrics("l_extendedprice", PRICE_FEATURES, "decision_tree_regressor", max_depth=5),
        None,
    ),
    "random_forest_regressor": (
        _metrics("l_extendedprice", PRICE_FEATURES, "random_forest_regressor", n_estimators=50, max_depth=5),
        None,
    ),
    "linear_svr": (_metrics("l_extendedprice", PRICE_FEATURES, "svr"), None),
    "importance_top": (importance_top, None),
    "accuracy": (
        accuracy,
        f"WITH {_G} SELECT count(*) AS n, round(avg((label = prediction)::INT), 9) AS accuracy FROM g",
    ),
    "confusion_matrix": (confusion_matrix, CONFUSION),
    "class_report": (class_report, CLASS_REPORT),
    "averaged_report": (averaged_report, AVERAGED_REPORT),
    "macro_micro": (macro_micro, MACRO_MICRO),
    "regression_report": (regression_report, REGRESSION_REPORT),
    "prediction_sample": (prediction_sample, PREDICTION_SAMPLE),
    "quality_band": (quality_band, QUALITY_BAND),
}

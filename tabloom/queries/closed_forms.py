"""Fitted models against values that SQL computes from the same rows.

Trees meet an exhaustive split search, linear models of three correlated features the
normal equations or cyclic descent on the Gram matrix, logistic regression Newton's
method, the support-vector models the least loss on either side of a binary feature.
Forests draw their rows, so they are held against a step that every draw must find.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.margins import fit_svc, fit_svr
from ..operators.models import (
    coefficient_table,
    fit_spark_model,
    importance_table,
    model_parameters,
    top_importance,
)
from .inputs import table


def _rows(spark: SparkSession, folder: str, features: dict[str, str], label: str) -> DataFrame:
    named = [f"{e} AS {n}" for n, e in features.items()]
    data = table(spark, folder, "lineitem").selectExpr(*named, f"CAST({label} AS DOUBLE) AS label")
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(data)


def _fit(rows: DataFrame, model: str, n_classes: int = 0, **params):
    return fit_spark_model(rows, model, model_parameters(model, params), rows.count(), n_classes)


# --- trees of one split -------------------------------------------------------------

# Few-valued features, so every threshold between two values is a candidate.
SPLIT_FEATURES = {"f0": "floor(l_quantity / 5)", "f1": "l_linenumber"}
SPLIT_CLASS = (
    "CASE WHEN l_quantity >= 30 AND l_linenumber < 5 THEN 2 WHEN l_returnflag = 'A' THEN 0"
    " WHEN l_linenumber > 5 THEN 2 ELSE 1 END"
)
SPLIT_PRICE = "l_extendedprice"


def _one_split(model: str, n_classes: int, label: str, **params):
    """Prediction of each combination of feature values."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = _rows(spark, folder, SPLIT_FEATURES, label)
        fitted = _fit(rows, model, n_classes, max_depth=1, **params)
        out = fitted.predict(rows.dropDuplicates(["f0", "f1"]))
        value = F.round(F.array_max("probability"), 9) if n_classes else F.round("prediction", 3)
        return out.select(
            F.col("f0").cast("bigint").alias("f0"),
            F.col("f1").cast("bigint").alias("f1"),
            *([F.col("prediction").cast("int").alias("prediction")] if n_classes else []),
            value.alias("confidence" if n_classes else "prediction"),
        )

    return run


def _split_cte(label: str, gain: str, sums: Sequence[str]) -> str:
    """CTEs up to ``best``: the feature and value after which the rows part best."""
    below = ", ".join(f"sum({s}) OVER w AS l_{s}" for s in sums)
    total = ", ".join(f"sum({s}) OVER (PARTITION BY f) AS t_{s}" for s in sums)
    per_value = ", ".join(
        {"n": "count(*) AS n", "s": "sum(y) AS s"}.get(s, f"count(*) FILTER (y = {s[1:]}) AS {s}") for s in sums
    )
    return f"""src AS (SELECT {", ".join(f"{e}::BIGINT AS {n}" for n, e in SPLIT_FEATURES.items())},
 ({label})::DOUBLE AS y FROM lineitem),
tall AS (SELECT 0 AS f, f0 AS v, y FROM src UNION ALL SELECT 1, f1, y FROM src),
cells AS (SELECT f, v, {per_value} FROM tall GROUP BY f, v),
sides AS (SELECT f, v, {below}, {total} FROM cells WINDOW w AS (PARTITION BY f ORDER BY v)),
best AS (SELECT f, v FROM sides WHERE l_n < t_n ORDER BY {gain} DESC, f, v LIMIT 1),
leaf AS (SELECT f0, f1, y, CASE WHEN f = 0 THEN f0 ELSE f1 END <= v AS low FROM src, best)"""


# Both criteria differ from these sums by constants of the whole table only.
_GINI = " + ".join(
    f"l_c{c}::DOUBLE * l_c{c} / l_n + (t_c{c} - l_c{c})::DOUBLE * (t_c{c} - l_c{c}) / (t_n - l_n)" for c in range(3)
)
SPLIT_CLASS_SQL = f"""WITH {_split_cte(SPLIT_CLASS, _GINI, ["n", "c0", "c1", "c2"])},
votes AS (SELECT low, y, count(*) AS n, sum(count(*)) OVER (PARTITION BY low) AS size FROM leaf GROUP BY low, y),
said AS (SELECT low, arg_max(y, n)::INT AS prediction, round(max(n / size::DOUBLE), 9) AS confidence FROM votes GROUP BY low)
SELECT DISTINCT f0, f1, prediction, confidence FROM leaf JOIN said USING (low)"""
SPLIT_PRICE_SQL = f"""WITH {_split_cte(SPLIT_PRICE, "l_s * l_s / l_n + (t_s - l_s) * (t_s - l_s) / (t_n - l_n)", ["n", "s"])},
said AS (SELECT low, round(avg(y), 3) AS prediction FROM leaf GROUP BY low)
SELECT DISTINCT f0, f1, prediction FROM leaf JOIN said USING (low)"""


# --- forests ------------------------------------------------------------------------

STEP = "l_linenumber >= 4"


def _forest_step(model: str, n_classes: int, label: str):
    """Every tree must part the rows at the step, so all agree and use one feature."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = _rows(spark, folder, SPLIT_FEATURES, label)
        fitted = _fit(rows, model, n_classes, n_estimators=20, max_depth=1)
        used = importance_table(spark, fitted, list(SPLIT_FEATURES)).where("importance = 1.0").first()
        return fitted.predict(rows.dropDuplicates(["f0", "f1"])).select(
            *[F.col(f).cast("bigint").alias(f) for f in SPLIT_FEATURES],
            F.round("prediction", 6).alias("prediction"),
            F.lit(used["feature"] if used else None).cast("string").alias("used"),
        )

    return run


def _step_sql(label: str) -> str:
    values = ", ".join(f"{e}::BIGINT AS {n}" for n, e in SPLIT_FEATURES.items())
    return f"SELECT DISTINCT {values}, ({label})::DOUBLE AS prediction, 'f1' AS used FROM lineitem"


STEP_CLASS = f"CASE WHEN {STEP} THEN 1 ELSE 0 END"
STEP_VALUE = f"CASE WHEN {STEP} THEN 20 ELSE 10 END"


# --- three correlated features --------------------------------------------------------

CORRELATED = {
    "x1": "l_quantity",
    "x2": "l_quantity * (1 + 10 * l_discount)",
    "x3": "l_quantity * l_quantity / 50",
}
CORRELATED_LABEL = "l_extendedprice / 1000"


def _three(model: str, digits: int, **params):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        fitted = _fit(_rows(spark, folder, CORRELATED, CORRELATED_LABEL), model, **params)
        return coefficient_table(spark, fitted, list(CORRELATED)).select(
            "position", "term", F.round("coefficient", digits).alias("coefficient")
        )

    return run


_GRAM = f"""src AS (SELECT {", ".join(f"{e} AS {n}" for n, e in CORRELATED.items())}, {CORRELATED_LABEL} AS y FROM lineitem),
g AS (SELECT count(*) AS n, avg(y) AS my, {", ".join(f"avg(x{i}) AS m{i}, covar_pop(x{i}, y) AS r{i}" for i in (1, 2, 3))},
 {", ".join(f"covar_pop(x{i}, x{j}) AS a{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))} FROM src)"""


def _terms(weights: str, digits: int) -> str:
    """Rows of the coefficient table from ``weights``, a relation of w1, w2, w3."""
    rest = " ".join(f"UNION ALL SELECT {i}, 'x{i}', round(w{i}, {digits}) FROM {weights}" for i in (1, 2, 3))
    return f"""SELECT 0 AS position, '(intercept)' AS term,
 round(my - w1 * m1 - w2 * m2 - w3 * m3, {digits}) AS coefficient FROM {weights}, g {rest}"""


def _normal_equations(ridge: str, digits: int) -> str:
    """Cramer's rule on the centred Gram matrix plus ``ridge`` on its diagonal."""

    def det(column: int) -> str:
        a = {
            (i, j): f"r{i}" if j == column else f"(a{i}{j} + {ridge})" if i == j else f"a{i}{j}"
            for i in (1, 2, 3)
            for j in (1, 2, 3)
        }
        return " + ".join(
            f"{a[1, p]} * ({a[2, q]} * {a[3, r]} - {a[2, r]} * {a[3, q]})" for p, q, r in ((1, 2, 3), (2, 3, 1), (3, 1, 2))
        )

    solved = ", ".join(f"({det(i)}) / ({det(0)}) AS w{i}" for i in (1, 2, 3))
    return f"WITH {_GRAM}, w AS (SELECT {solved} FROM g) {_terms('w', digits)}"


def _descent(l1: float, l2: float, digits: int, rounds: int = 20_000) -> str:
    """Cyclic coordinate descent for ``1/(2n)·SSE + l1·|w| + l2/2·|w|²``."""

    def step(i: int, done: dict[int, str]) -> str:
        others = " - ".join(f"a{i}{j} * {done.get(j, f'w{j}')}" for j in (1, 2, 3) if j != i)
        z = f"(r{i} - {others})"
        return f"sign({z}) * greatest(abs({z}) - {l1}, 0) / (a{i}{i} + {l2})"

    return f"""WITH RECURSIVE {_GRAM}, d AS (
 SELECT 0 AS k, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS w3
 UNION ALL SELECT k + 1, u1, u2, {step(3, {1: "u1", 2: "u2"})} FROM (
  SELECT *, {step(2, {1: "u1"})} AS u2 FROM (SELECT *, {step(1, {})} AS u1 FROM d, g WHERE k < {rounds}))),
 w AS (SELECT * FROM d WHERE k = {rounds}) {_terms("w", digits)}"""


def importance_linear(spark: SparkSession, folder: str) -> DataFrame:
    """The two features of largest absolute coefficient."""
    fitted = _fit(_rows(spark, folder, CORRELATED, CORRELATED_LABEL), "ridge_regression", alpha=1000.0)
    top = top_importance(importance_table(spark, fitted, list(CORRELATED)), 2)
    return top.select("position", "feature", F.round("importance", 4).alias("importance"))


def tree_importance(spark: SparkSession, folder: str) -> DataFrame:
    """A tree of one split uses one feature, whose importance is one."""
    rows = _rows(spark, folder, SPLIT_FEATURES, SPLIT_CLASS)
    return top_importance(importance_table(spark, _fit(rows, "decision_tree", 3, max_depth=1), list(SPLIT_FEATURES)))


_ridge = _normal_equations("1000.0 / n", 4)
IMPORTANCE_LINEAR = f"""SELECT position - 1 AS position, term AS feature, coefficient AS importance FROM ({_ridge})
WHERE position > 0 ORDER BY abs(coefficient) DESC LIMIT 2"""
TREE_IMPORTANCE = f"""WITH {_split_cte(SPLIT_CLASS, _GINI, ["n", "c0", "c1", "c2"])}
SELECT i::INT AS position, concat('f', i) AS feature, (i = f)::INT::DOUBLE AS importance FROM best, range(2) t(i)"""


# --- logistic regression ----------------------------------------------------------------

BINARY = {"x": "CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END"}
BINARY_LABEL = "CASE WHEN l_returnflag = 'R' OR (l_quantity > 25 AND l_returnflag = 'N') THEN 1 ELSE 0 END"


def logistic_penalised(spark: SparkSession, folder: str) -> DataFrame:
    """Chance of the label on either side of a binary feature, strongly penalised."""
    rows = _rows(spark, folder, BINARY, BINARY_LABEL)
    out = _fit(rows, "logistic_regression", 2, C=0.001).predict(rows.dropDuplicates(["x"]))
    return out.select(F.col("x").cast("int").alias("x"), F.round(F.col("probability")[1], 4).alias("chance"))


# The penalty is w²/2 on the weight only, the loss C times the sum over the rows.
LOGISTIC_SQL = f"""WITH RECURSIVE c AS (SELECT 0.001::DOUBLE * count(*) FILTER (x = 0) AS n0, 0.001::DOUBLE * count(*) FILTER (x = 1) AS n1,
 0.001::DOUBLE * count(*) FILTER (x = 0 AND y = 1) AS p0, 0.001::DOUBLE * count(*) FILTER (x = 1 AND y = 1) AS p1
 FROM (SELECT {BINARY["x"]} AS x, {BINARY_LABEL} AS y FROM lineitem)),
it AS (SELECT 0 AS k, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b
 UNION ALL SELECT k + 1, w - (h00 * gw - h1 * gb) / (h00 * hw - h1 * h1), b - (hw * gb - h1 * gw) / (h00 * hw - h1 * h1)
 FROM (SELECT *, n1 * s1 - p1 + w AS gw, n0 * s0 - p0 + n1 * s1 - p1 AS gb, n1 * s1 * (1 - s1) + 1 AS hw,
  n1 * s1 * (1 - s1) AS h1, n0 * s0 * (1 - s0) + n1 * s1 * (1 - s1) AS h00
  FROM (SELECT *, 1 / (1 + exp(-b)) AS s0, 1 / (1 + exp(-b - w)) AS s1 FROM it, c WHERE k < 50)))
SELECT 0 AS x, round(1 / (1 + exp(-b)), 4) AS chance FROM it WHERE k = 50
UNION ALL SELECT 1, round(1 / (1 + exp(-b - w)), 4) FROM it WHERE k = 50"""


# --- support vectors --------------------------------------------------------------------


def svc_groups(spark: SparkSession, folder: str) -> DataFrame:
    """With a weak penalty the hinge loss is least at the majority of either side."""
    rows = _rows(spark, folder, BINARY, BINARY_LABEL)
    out = fit_svc(rows, C=1.0).predict(rows.dropDuplicates(["x"]))
    return out.select(F.col("x").cast("int").alias("x"), F.col("prediction").cast("int").alias("prediction"))


SVC_GROUPS = f"""SELECT x::INT AS x, (2 * sum(y) > count(*))::INT AS prediction
FROM (SELECT {BINARY["x"]} AS x, {BINARY_LABEL} AS y FROM lineitem) GROUP BY x"""

SVR_LABEL = "CASE WHEN l_quantity > 25 THEN l_extendedprice / 2000 ELSE l_extendedprice / 1000 END"


def svr_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Loss per row that the fit reaches."""
    rows = _rows(spark, folder, BINARY, SVR_LABEL)
    n = rows.count()
    return rows.sparkSession.createDataFrame(
        [(n, round(fit_svr(rows).objective / n, 2))], "n bigint, loss double"
    )


# The tube is narrow against the spread, so medians give the least loss to all digits kept.
SVR_GROUPS = f"""WITH src AS (SELECT {BINARY["x"]} AS x, {SVR_LABEL} AS y FROM lineitem),
m AS (SELECT x, median(y) AS m FROM src GROUP BY x),
w AS (SELECT max(m) - min(m) AS w FROM m)
SELECT count(*) AS n, round((sum(greatest(abs(y - m) - 0.1, 0)) + 0.5 * any_value(w * w)) / count(*), 2) AS loss
FROM src JOIN m USING (x), w"""


# --- support vectors on three features --------------------------------------------------

# Features of two values, so that SQL searches on eight kinds of rows.
THREE = {
    "x1": "CASE WHEN l_quantity > 20 THEN 1.0 ELSE 0.0 END",
    "x2": "CASE WHEN l_linenumber > 3 THEN 1.0 ELSE -1.0 END",
    "x3": "CASE WHEN l_discount > 0.04 THEN 2.0 ELSE 0.0 END",
}
THREE_CLASS = "CASE WHEN l_returnflag = 'R' OR l_linenumber = 5 THEN 1 WHEN l_quantity > 33 THEN 1 ELSE 0 END"
THREE_VALUE = "floor(l_extendedprice / 8000)"
# The weight of the loss shrinks with the rows, so that the penalty counts at any size.
THREE_C = 2.0


def _three_margins(fit, label: str):
    """Objective of the fit per unit of loss weight, and whether its gap is closed."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = _rows(spark, folder, THREE, label)
        n = rows.count()
        gap, objective = fit(rows, THREE_C / n)
        return spark.createDataFrame([(n, round(objective, 3), gap < 1e-4)], "n bigint, objective double, closed boolean")

    return run


def _svc_three(rows: DataFrame, C: float) -> tuple[float, float]:
    fitted = fit_svc(rows, C)
    w = F.array(*[F.lit(float(c)) for c in fitted.weights[0, :-1]])
    dot = F.aggregate(F.zip_with(F.array(*THREE), w, lambda a, b: a * b), F.lit(float(fitted.weights[0, -1])), lambda a, v: a + v)
    hinge = F.greatest(F.lit(0.0), 1 - (2 * F.col("label") - 1) * dot)
    return fitted.gap, 0.5 * float((fitted.weights[0, :-1] ** 2).sum()) + C * rows.agg(F.sum(hinge)).first()[0]


def _svr_three(rows: DataFrame, C: float) -> tuple[float, float]:
    fitted = fit_svr(rows, C)
    return fitted.gap, fitted.objective


def _three_sql(label: str, loss: str, rounds: int = 160) -> str:
    """A search on a grid that closes in: all 81 neighbours, then half the distance."""
    grid = "range(-1, 2) a(d1), range(-1, 2) b(d2), range(-1, 2) c(d3), range(-1, 2) d(d0)"
    return f"""WITH RECURSIVE src AS (SELECT {", ".join(f"{e} AS {n}" for n, e in THREE.items())}, ({label})::DOUBLE AS y FROM lineitem),
kinds AS (SELECT x1, x2, x3, y, count(*)::DOUBLE AS n FROM src GROUP BY ALL), total AS (SELECT sum(n) AS n FROM kinds),
packed AS (SELECT list({{'x1': x1, 'x2': x2, 'x3': x3, 'y': y, 'n': {THREE_C} * kinds.n / total.n}} ORDER BY x1, x2, x3, y) AS ks FROM kinds, total),
near AS (SELECT d1, d2, d3, d0 FROM {grid}),
spot AS (SELECT 0 AS k, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS w3, 0.0::DOUBLE AS b, 2.0::DOUBLE AS s
 UNION ALL
 SELECT k + 1, m.w1, m.w2, m.w3, m.b, CASE WHEN m.still THEN s / 2 ELSE s END FROM (
  SELECT k, s, arg_min({{'w1': v1, 'w2': v2, 'w3': v3, 'b': v0, 'still': still}}, {{'o': o, 'm': NOT still}}) AS m FROM (
   SELECT k, s, v1, v2, v3, v0, still, 0.5 * (v1 * v1 + v2 * v2 + v3 * v3) + list_sum(list_transform(ks, lambda r: r.n * {loss})) AS o FROM (
    SELECT k, s, w1 + s * d1 AS v1, w2 + s * d2 AS v2, w3 + s * d3 AS v3, b + s * d0 AS v0,
     d1 = 0 AND d2 = 0 AND d3 = 0 AND d0 = 0 AS still FROM spot, near WHERE k < {rounds}), packed) GROUP BY k, s)),
best AS (SELECT w1 AS v1, w2 AS v2, w3 AS v3, b AS v0 FROM spot WHERE k = {rounds})
SELECT total.n::BIGINT AS n, round(0.5 * (v1 * v1 + v2 * v2 + v3 * v3) + list_sum(list_transform(ks, lambda r: r.n * {loss})), 3) AS objective,
 true AS closed FROM best, packed, total"""


_FIELD = "(v1 * r.x1 + v2 * r.x2 + v3 * r.x3 + v0)"

QUERIES = {
    "tree_split": (_one_split("decision_tree", 3, SPLIT_CLASS), SPLIT_CLASS_SQL),
    "tree_regressor_split": (_one_split("decision_tree_regressor", 0, SPLIT_PRICE), SPLIT_PRICE_SQL),
    "forest_step": (_forest_step("random_forest", 2, STEP_CLASS), _step_sql(STEP_CLASS)),
    "forest_regressor_step": (_forest_step("random_forest_regressor", 0, STEP_VALUE), _step_sql(STEP_VALUE)),
    "tree_importance": (tree_importance, TREE_IMPORTANCE),
    "linear_three": (_three("linear_regression", 4), _normal_equations("0.0", 4)),
    "ridge_three": (_three("ridge_regression", 4, alpha=1000.0), _ridge),
    "lasso_three": (_three("lasso_regression", 3, alpha=0.5), _descent(0.5, 0.0, 3)),
    "elastic_net_three": (_three("elastic_net", 3, alpha=1.0, l1_ratio=0.5), _descent(0.5, 0.5, 3)),
    "importance_linear": (importance_linear, IMPORTANCE_LINEAR),
    "logistic_penalised": (logistic_penalised, LOGISTIC_SQL),
    "svc_groups": (svc_groups, SVC_GROUPS),
    "svr_groups": (svr_groups, SVR_GROUPS),
    "svc_three": (
        _three_margins(_svc_three, THREE_CLASS),
        _three_sql(THREE_CLASS, f"greatest(0, 1 - (2 * r.y - 1) * {_FIELD})"),
    ),
    "svr_three": (
        _three_margins(_svr_three, THREE_VALUE),
        _three_sql(THREE_VALUE, f"greatest(0, abs(r.y - {_FIELD}) - 0.1)"),
    ),
}

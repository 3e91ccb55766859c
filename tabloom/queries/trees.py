"""Whole trees and forests against the same growth in SQL, one level after the other.

SQL searches every value of every feature at each node, draws the same rows and features
from the same hashes, and must arrive at the same thresholds and sizes.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trees
from ..operators.models import fit_tree_model, model_parameters
from ..operators.split import SEED
from .inputs import table

# A price has tens of thousands of values, the other features few.
FEATURES = {"f0": "l_quantity", "f1": "l_extendedprice", "f2": "l_linenumber", "f3": "floor(l_discount * 100 + 0.5)"}
KEY = "l_orderkey * 10 + l_linenumber"
CLASS = (
    "CASE WHEN l_returnflag = 'R' AND l_extendedprice > 31000 THEN 2 WHEN l_quantity > 21 AND l_linenumber < 4 THEN 1"
    " WHEN l_returnflag = 'A' THEN 2 ELSE 0 END"
)
# Whole numbers, so that sums do not depend on the order of the rows.
VALUE = "floor(l_extendedprice / 10) + CASE WHEN l_returnflag = 'R' THEN 700 ELSE 0 END * l_linenumber"


def _nodes(model: str, label: str, classes: int, **params):
    """The nodes of a fitted model."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        data = table(spark, folder, "lineitem").selectExpr(
            f"{KEY} AS __id", *[f"{e} AS {n}" for n, e in FEATURES.items()], f"CAST({label} AS DOUBLE) AS label"
        )
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data)
        fitted = fit_tree_model(rows, model, model_parameters(model, params), classes)
        return fitted.nodes(spark).select(
            "tree", "node", "feature", F.round("threshold", 6).alias("threshold"), F.col("n").cast("bigint").alias("n")
        )

    return run


def _mixed(value: str, times: int) -> str:
    for _ in range(times):
        value = f"(({value}) % {trees.PRIME} * (({value}) % {trees.PRIME}) % {trees.PRIME} * {trees.MIX_FACTOR} % {trees.PRIME})"
    return value


def _nodes_sql(label: str, classes: int, depth: int, n_trees: int = 1, wanted: int = 0, min_split: int = 2, min_leaf: int = 1) -> str:
    d = len(FEATURES)
    sums = [f"c{k}" for k in range(classes)] if classes else ["s"]
    per_value = [f"sum(w) FILTER (y = {k})" if classes else "sum(w * y)" for k in range(classes or 1)]
    per_value = ", ".join(f"coalesce({e}, 0)::DOUBLE AS {s}" for s, e in zip(sums, per_value))
    side = {
        "l": " + ".join(f"l_{s} * l_{s}" for s in sums),
        "r": " + ".join(f"(t_{s} - l_{s}) * (t_{s} - l_{s})" for s in sums),
    }
    drawn = n_trees > 1
    first = f"""src AS (SELECT {KEY} AS key, {", ".join(f"({e})::DOUBLE AS {n}" for n, e in FEATURES.items())},
 ({label})::DOUBLE AS y, ('0x' || substr(md5(concat({KEY}, '-{SEED}')), 1, 8))::BIGINT AS h FROM lineitem),
lots AS (SELECT *, h % {trees.PRIME} * {trees.MIX_FACTOR} + (tree + 1) * {trees.TREE_FACTOR} AS m0 FROM src, range({n_trees}) t(tree)),
mix1 AS (SELECT *, {_mixed("m0", 1)} AS m1 FROM lots), mix2 AS (SELECT *, {_mixed("m1", 1)} / {trees.PRIME}::DOUBLE AS u FROM mix1),
weighed AS (SELECT *, {" + ".join(f"(u >= {float(c)!r})::INT" for c in trees.POISSON) if drawn else "1"} AS w FROM mix2),
r0 AS (SELECT *, 1::BIGINT AS node FROM weighed WHERE w > 0)"""
    parts, found = [first], []
    for k in range(depth):
        tall = " UNION ALL ".join(f"SELECT tree, node, {f} AS f, {n} AS v, y, w FROM r{k}" for f, n in enumerate(FEATURES))
        chosen = "true"
        parts.append(f"tall{k} AS ({tall})")
        if wanted:
            mix = _mixed(f"(node * {trees.NODE_FACTOR} + f * {trees.FEATURE_FACTOR} + tree * {trees.TREE_FACTOR})", 1)
            parts.append(f"""pick{k} AS (SELECT tree, node, f FROM (SELECT tree, node, f,
 row_number() OVER (PARTITION BY tree, node ORDER BY {mix}, f) AS p FROM (SELECT DISTINCT tree, node FROM r{k}), range({d}) o(f)) WHERE p <= {wanted})""")
            chosen = f"(tree, node, f) IN (SELECT (tree, node, f) FROM pick{k})"
        below = ", ".join(f"sum({s}) OVER o AS l_{s}, sum({s}) OVER (PARTITION BY tree, node, f) AS t_{s}" for s in ["n", *sums])
        pure = f"greatest({', '.join(f't_{s}' for s in sums)}) = t_n" if classes else "false"
        parts.append(f"""cells{k} AS (SELECT tree, node, f, v, sum(w)::DOUBLE AS n, {per_value} FROM tall{k} WHERE {chosen} GROUP BY ALL),
sides{k} AS (SELECT tree, node, f, v, lead(v) OVER o AS nxt, {below} FROM cells{k} WINDOW o AS (PARTITION BY tree, node, f ORDER BY v)),
best{k} AS (SELECT * FROM sides{k} WHERE nxt IS NOT NULL AND t_n >= {min_split} AND NOT {pure} AND l_n >= {min_leaf} AND t_n - l_n >= {min_leaf}
 QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY ({side["l"]}) / l_n + ({side["r"]}) / (t_n - l_n) DESC, f, v) = 1),
r{k + 1} AS (SELECT r{k}.* EXCLUDE (node), 2 * r{k}.node + (CASE f {" ".join(f"WHEN {f} THEN {n}" for f, n in enumerate(FEATURES))} END > v)::INT AS node
 FROM r{k} JOIN best{k} USING (tree, node))""")
        parts.append(f"size{k} AS (SELECT tree, node, sum(w)::BIGINT AS n FROM r{k} GROUP BY ALL)")
        found.append(f"""SELECT size{k}.tree::INT AS tree, size{k}.node AS node, f::INT AS feature, round(v + (nxt - v) / 2, 6) AS threshold, n
 FROM size{k} LEFT JOIN best{k} USING (tree, node)""")
    found.append(f"SELECT tree::INT, node, NULL::INT, NULL::DOUBLE, sum(w)::BIGINT FROM r{depth} GROUP BY tree, node")
    return "WITH " + ",\n".join(parts) + "\n" + "\nUNION ALL ".join(found)


def _both(model: str, label: str, classes: int, depth: int, **params):
    wanted = math.isqrt(len(FEATURES) - 1) + 1 if model == "random_forest" else 0
    sql = _nodes_sql(
        label,
        classes,
        depth,
        params.get("n_estimators", 1),
        wanted,
        params.get("min_samples_split", 2),
        params.get("min_samples_leaf", 1),
    )
    return _nodes(model, label, classes, max_depth=depth, **params), sql


QUERIES = {
    "tree_nodes": _both("decision_tree", CLASS, 3, 4, min_samples_split=10, min_samples_leaf=2),
    "tree_regressor_nodes": _both("decision_tree_regressor", VALUE, 0, 3, min_samples_split=5),
    "forest_nodes": _both("random_forest", CLASS, 3, 3, n_estimators=8),
    "forest_regressor_nodes": _both("random_forest_regressor", VALUE, 0, 2, n_estimators=4, min_samples_split=10),
}

"""Input tables of the registered queries, and the same inputs as SQL.

The given tables have no missing values, copies or padding, so dirty inputs are
derived from ``orders`` by expressions both engines understand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


DIRTY_COLUMNS = {
    "custkey": "CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_custkey END",
    "total": "CASE WHEN o_orderkey % 101 = 0 OR o_orderkey % 53 = 0 OR o_orderkey % 7 = 0"
    " THEN NULL ELSE o_totalprice END",
    "status": "CASE WHEN o_orderkey % 101 = 0 OR o_orderkey % 53 = 0 THEN NULL"
    " WHEN o_orderkey % 2 = 0 THEN concat('  ', o_orderstatus, ' ') ELSE o_orderstatus END",
    "priority": "CASE WHEN o_orderkey % 101 = 0 OR o_orderkey % 53 = 0 OR o_orderkey % 3 = 0"
    " THEN NULL ELSE o_orderpriority END",
    "note": "CAST(NULL AS STRING)",
}
_SELECT = ", ".join(f"{e} AS {n}" for n, e in DIRTY_COLUMNS.items())
COPIES = "o_orderkey % 50 = 0"


def dirty(spark: SparkSession, folder: str, key: bool = False) -> DataFrame:
    """Orders with gaps, padding, an empty column and (without ``key``) copies."""
    orders = table(spark, folder, "orders")
    columns = [f"{e} AS {n}" for n, e in DIRTY_COLUMNS.items()]
    if key:
        return orders.selectExpr("o_orderkey", *columns)
    return orders.selectExpr(*columns).unionAll(orders.where(COPIES).selectExpr(*columns))


DIRTY_SQL = f"dirty AS (SELECT {_SELECT} FROM orders UNION ALL SELECT {_SELECT} FROM orders WHERE {COPIES})"
KEYED_SQL = f"keyed AS (SELECT o_orderkey, {_SELECT} FROM orders)"

# Number of missing cells in a row of ``dirty``.
NULLS_SQL = "(" + " + ".join(f"({c} IS NULL)::INT" for c in DIRTY_COLUMNS) + ")"


def split_sql(source: str, key: str, label: str | None, seed: int = 42) -> str:
    """CTEs ending in ``flagged``: the rows of ``source`` with ``is_test``.

    Proportional class quotas with largest remainders; the smallest key hashes of a
    class are its test rows.
    """
    lab = label or "0"
    return f"""
sized AS (SELECT {lab} AS cls, count(*) AS n FROM {source} GROUP BY 1),
totals AS (SELECT sum(n)::BIGINT AS n, ((sum(n) + 4) // 5)::BIGINT AS n_test FROM sized),
parts AS (SELECT s.cls, (s.n * t.n_test) // t.n AS base, (s.n * t.n_test) % t.n AS rest, t.n_test
          FROM sized s, totals t),
quotas AS (SELECT cls, base + (row_number() OVER (ORDER BY rest DESC, cls)
                  <= n_test - sum(base) OVER ())::INT AS quota FROM parts),
ranked AS (SELECT *, {lab} AS cls_, row_number() OVER (PARTITION BY {lab}
           ORDER BY md5(concat({key}, '-{seed}')), {key}) AS rk FROM {source}),
flagged AS (SELECT r.*, rk <= quota AS is_test FROM ranked r JOIN quotas q ON r.cls_ = q.cls)
"""

"""Association-mining queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizing import shared_folder
from ..operators import baskets, itemsets, rules
from ..plans.mining import Analysis, analyze_associations, analyze_baskets
from ..sources.tables import load_mining, save_mining
from .inputs import table

SUPPORT = 0.05
CONFIDENCE = 0.5
MAX_LEN = 3
N_RULES = 100


def _type_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line: order and part type."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, folder, "part").select("p_partkey", "p_type")
    return lines.join(part, lines.l_partkey == part.p_partkey).select("l_orderkey", "p_type")


def _type_baskets(spark: SparkSession, folder: str) -> baskets.Baskets:
    return baskets.row_baskets(_type_rows(spark, folder), "l_orderkey", "p_type", SUPPORT)


# --- transactions -------------------------------------------------------------------


def _text_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their distinct brands as separated text, some empty or missing."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, folder, "part").select("p_partkey", "p_brand")
    brands = (
        lines.join(part, lines.l_partkey == part.p_partkey)
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_set("p_brand")).alias("b"))
    )
    return brands.selectExpr(
        "l_orderkey",
        "CASE WHEN l_orderkey % 89 = 0 THEN NULL WHEN l_orderkey % 97 = 0 THEN ' , '"
        " WHEN l_orderkey % 2 = 0 THEN array_join(b, ' ; ') ELSE array_join(b, ',') END AS items_text",
    )


def transactions_text(spark: SparkSession, folder: str) -> DataFrame:
    return baskets.items_from_text(_text_rows(spark, folder), "items_text").select(
        "l_orderkey", F.array_join("items", ",").alias("items")
    )


TRANSACTIONS_TEXT = """SELECT l_orderkey, CASE WHEN l_orderkey % 97 = 0 THEN '' ELSE
 string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) END AS items
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 89 <> 0 GROUP BY l_orderkey"""


def _item_table(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '0' ELSE o_orderstatus END AS status",
        "CASE WHEN o_orderkey % 10 = 0 THEN ' ' ELSE concat(' ', o_orderpriority) END AS priority",
    )


_ITEMS = """items AS (SELECT o_orderkey,
 CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0 THEN concat('status=', o_orderstatus) END AS s,
 CASE WHEN o_orderkey % 10 <> 0 THEN concat('priority=', o_orderpriority) END AS p FROM orders)"""


def transactions_columns(spark: SparkSession, folder: str) -> DataFrame:
    out = baskets.items_from_columns(_item_table(spark, folder), ["status", "priority"])
    return out.select("o_orderkey", F.array_join("items", "|").alias("items"))


TRANSACTIONS_COLUMNS = f"""WITH {_ITEMS} SELECT o_orderkey, concat_ws('|', p, s) AS items FROM items
WHERE p IS NOT NULL OR s IS NOT NULL"""


def detected_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions from the columns found to be categorical, counted."""
    return baskets.column_baskets(table(spark, folder, "orders")).info()


def _detected_sql() -> str:
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    counts = " UNION ALL ".join(f"SELECT count(DISTINCT {c}) AS d FROM orders" for c in columns)
    return f"""WITH k AS ({counts}) SELECT 'item_columns' AS method, (SELECT count(*) FROM orders) AS transactions,
 sum(d) FILTER (d BETWEEN 2 AND 50)::BIGINT AS distinct_items FROM k"""


def transactions_rows(spark: SparkSession, folder: str) -> DataFrame:
    out = baskets.items_from_rows(_type_rows(spark, folder), "l_orderkey", "p_type")
    return out.select("l_orderkey", F.array_join("items", ",").alias("items"))


TRANSACTIONS_ROWS = """SELECT l_orderkey, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS items
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey"""


def basket_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _type_baskets(spark, folder).info()


# --- itemsets -----------------------------------------------------------------------

_SETS = f"""tx AS (SELECT DISTINCT l_orderkey AS tid, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT count(DISTINCT tid) AS n FROM tx),
s AS (SELECT item AS i1, '' AS i2, '' AS i3, item AS itemset, 1 AS length, count(*) AS freq FROM tx GROUP BY item
 UNION ALL SELECT a.item, b.item, '', concat(a.item, ', ', b.item), 2, count(*) FROM tx a JOIN tx b
  ON a.tid = b.tid AND a.item < b.item GROUP BY a.item, b.item
 UNION ALL SELECT a.item, b.item, c.item, concat(a.item, ', ', b.item, ', ', c.item), 3, count(*) FROM tx a JOIN tx b
  ON a.tid = b.tid AND a.item < b.item JOIN tx c ON c.tid = b.tid AND b.item < c.item GROUP BY a.item, b.item, c.item),
f AS (SELECT s.*, freq / n AS support, n FROM s, n WHERE freq / n >= {SUPPORT})"""


def _itemsets(algorithm: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = itemsets.frequent_itemsets(_type_baskets(spark, folder), SUPPORT, MAX_LEN, algorithm)
        return itemsets.itemset_text(found).select("itemset", "freq", F.round("support", 9).alias("support"), "length")

    return run


def itemsets_in_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The same itemsets when no level is taken to the driver."""
    found = itemsets.apriori(_type_baskets(spark, folder), SUPPORT, MAX_LEN, max_candidates=0)
    return itemsets.itemset_text(found).select("itemset", "freq", F.round("support", 9).alias("support"), "length")


ITEMSETS = f"WITH {_SETS} SELECT itemset, freq, round(support, 9) AS support, length FROM f"


def itemset_statistics(spark: SparkSession, folder: str) -> DataFrame:
    out = itemsets.itemset_statistics(itemsets.apriori(_type_baskets(spark, folder), SUPPORT, MAX_LEN))
    return out.select(
        "total_itemsets", F.round("max_support", 9).alias("max_support"), F.round("avg_support", 9).alias("avg_support")
    )


ITEMSET_STATISTICS = f"""WITH {_SETS} SELECT count(*) AS total_itemsets, round(max(support), 9) AS max_support,
 round(avg(support), 9) AS avg_support FROM f"""


def itemsets_by_length(spark: SparkSession, folder: str) -> DataFrame:
    return itemsets.itemsets_by_length(itemsets.apriori(_type_baskets(spark, folder), SUPPORT, MAX_LEN))


# --- rules --------------------------------------------------------------------------

_RULES = f"""{_SETS},
split AS (
 SELECT i1 AS a, i2 AS c, freq, n FROM f WHERE length = 2 UNION ALL SELECT i2, i1, freq, n FROM f WHERE length = 2
 UNION ALL SELECT i1, concat(i2, ', ', i3), freq, n FROM f WHERE length = 3
 UNION ALL SELECT i2, concat(i1, ', ', i3), freq, n FROM f WHERE length = 3
 UNION ALL SELECT i3, concat(i1, ', ', i2), freq, n FROM f WHERE length = 3
 UNION ALL SELECT concat(i2, ', ', i3), i1, freq, n FROM f WHERE length = 3
 UNION ALL SELECT concat(i1, ', ', i3), i2, freq, n FROM f WHERE length = 3
 UNION ALL SELECT concat(i1, ', ', i2), i3, freq, n FROM f WHERE length = 3),
r AS (SELECT a AS antecedents, c AS consequents, concat(a, ' => ', c) AS rule, x.freq / x.n AS support,
 x.freq / fa.freq AS confidence, (x.freq / fa.freq) / (fc.freq / x.n) AS lift,
 x.freq / x.n - fa.freq / x.n * (fc.freq / x.n) AS leverage,
 CASE WHEN x.freq = fa.freq THEN 'infinity'::DOUBLE ELSE (1 - fc.freq / x.n) / (1 - x.freq / fa.freq) END AS conviction
 FROM split x JOIN f fa ON fa.itemset = a JOIN f fc ON fc.itemset = c),
top AS (SELECT * FROM r WHERE confidence >= 0.1::DOUBLE ORDER BY confidence DESC, lift DESC, support DESC, rule LIMIT {N_RULES})"""
_MEASURES = ["support", "confidence", "lift", "leverage", "conviction"]
_MEASURES_SQL = ", ".join(f"round({m}, 6) AS {m}" for m in _MEASURES)


def _analysis(spark: SparkSession, folder: str, max_rules: int | None = N_RULES) -> Analysis:
    return analyze_baskets(
        _type_baskets(spark, folder), SUPPORT, CONFIDENCE, MAX_LEN, max_rules, algorithm="fpgrowth"
    )


def _rounded(df: DataFrame) -> DataFrame:
    for m in _MEASURES:
        if m in df.columns:
            df = df.withColumn(m, F.round(m, 6))
    return df


def rules_all(spark: SparkSession, folder: str) -> DataFrame:
    found = itemsets.fp_growth(_type_baskets(spark, folder), SUPPORT, MAX_LEN)
    n = table(spark, folder, "lineitem").agg(F.count_distinct("l_orderkey")).first()[0]
    return _rounded(rules.all_rules(found, n)).select("rule", *_MEASURES)


def rules_top(spark: SparkSession, folder: str) -> DataFrame:
    """The best rules of part types bought together, relaxing the confidence where needed."""
    return _rounded(_analysis(spark, folder).rules).select("rule", *_MEASURES)


def rules_unlimited(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_analysis(spark, folder, None).rules).select("rule", "confidence", "lift")


def rule_statistics(spark: SparkSession, folder: str) -> DataFrame:
    out = _analysis(spark, folder).statistics
    return out.select(
        *[F.round(c, 6).alias(c) if c.startswith(("avg", "max")) else F.col(c) for c in out.columns]
    )


RULE_STATISTICS = f"""WITH {_RULES} SELECT count(*) AS total_rules, round(avg(confidence), 6) AS avg_confidence,
 round(avg(lift), 6) AS avg_lift, round(avg(support), 6) AS avg_support, round(max(confidence), 6) AS max_confidence,
 round(max(lift), 6) AS max_lift, count(*) FILTER (confidence >= 0.8) AS high_confidence,
 count(*) FILTER (lift >= 1.5) AS high_lift FROM top"""


def rules_by_lift(spark: SparkSession, folder: str) -> DataFrame:
    out = rules.top_rules(_analysis(spark, folder, None).rules, "lift")
    return _rounded(out).select("rule", "support", "confidence", "lift", "conviction")


RULES_BY_LIFT = f"""WITH {_RULES} SELECT rule, round(support, 6) AS support, round(confidence, 6) AS confidence,
 round(lift, 6) AS lift, round(conviction, 6) AS conviction FROM r WHERE confidence >= {CONFIDENCE}
ORDER BY r.lift DESC, r.confidence DESC, r.support DESC, rule LIMIT 10"""


def lift_bands(spark: SparkSession, folder: str) -> DataFrame:
    return rules.lift_band(_analysis(spark, folder).rules).groupBy("lift_band").agg(F.count(F.lit(1)).alias("n"))


LIFT_BANDS = f"""WITH {_RULES} SELECT CASE WHEN lift >= 2 THEN 'excellent' WHEN lift >= 1.5 THEN 'good'
 WHEN lift >= 1.2 THEN 'fair' ELSE 'weak' END AS lift_band, count(*) AS n FROM top GROUP BY 1"""


def rules_export(spark: SparkSession, folder: str) -> DataFrame:
    return rules.export_rules(_analysis(spark, folder).rules, N_RULES)


RULES_EXPORT = f"""WITH {_RULES} SELECT row_number() OVER (ORDER BY confidence DESC, lift DESC, support DESC, rule)::INT
 AS "Regla_ID", antecedents AS "Antecedente", consequents AS "Consecuente", round(support, 4) AS "Soporte",
 round(confidence, 4) AS "Confianza", round(lift, 4) AS "Lift", round(leverage, 4) AS "Leverage",
 round(conviction, 4) AS "Conviction" FROM top"""


def analysis_for_target(spark: SparkSession, folder: str) -> DataFrame:
    """Column form, rules with the status among the consequents."""
    out = analyze_associations(
        _item_table(spark, folder),
        item_columns=["status", "priority"],
        min_support=0.02,
        min_confidence=0.3,
        target="status",
    )
    return _rounded(out.rules).select("rule", "support", "confidence", "lift")


ANALYSIS_FOR_TARGET = f"""WITH {_ITEMS}, k AS (SELECT * FROM items WHERE p IS NOT NULL OR s IS NOT NULL),
n AS (SELECT count(*) AS n FROM k),
a AS (SELECT p, count(*) AS f FROM k WHERE p IS NOT NULL GROUP BY p),
b AS (SELECT s, count(*) AS f FROM k WHERE s IS NOT NULL GROUP BY s),
ab AS (SELECT p, s, count(*) AS f FROM k WHERE p IS NOT NULL AND s IS NOT NULL GROUP BY p, s),
r AS (SELECT concat(p, ' => ', s) AS rule, true AS hit, ab.f / n AS support, ab.f / a.f AS confidence,
 (ab.f / a.f) / (b.f / n) AS lift FROM ab JOIN a USING (p) JOIN b USING (s), n WHERE ab.f / n >= 0.02
 UNION ALL SELECT concat(s, ' => ', p), false, ab.f / n, ab.f / b.f, (ab.f / b.f) / (a.f / n)
 FROM ab JOIN a USING (p) JOIN b USING (s), n WHERE ab.f / n >= 0.02),
top AS (SELECT * FROM r WHERE confidence >= 0.1::DOUBLE ORDER BY confidence DESC, lift DESC, support DESC, rule LIMIT 100)
SELECT rule, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM top WHERE hit"""


def stored_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """Rules read back from a stored analysis."""
    path = shared_folder(spark, "mining")
    done = _analysis(spark, folder)
    save_mining(done.itemsets, done.rules, path)
    return _rounded(load_mining(spark, path)[1]).select("rule", *_MEASURES)


_LONG_SUPPORT = 0.002
_LONG_COLUMNS = {
    "flag": "l_returnflag",
    "line": "CASE WHEN l_linenumber > 3 THEN 'late' ELSE 'early' END",
    "price": "CASE WHEN l_extendedprice > 30000 THEN 'high' ELSE 'low' END",
    "quantity": "CASE WHEN l_quantity > 25 THEN 'high' ELSE 'low' END",
    "rebate": "CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END",
    "status": "l_linestatus",
    "tax": "CASE WHEN l_tax > 0.04 THEN 'high' ELSE 'low' END",
}


def _itemsets_long(algorithm: str):
    """Itemsets of any length over seven columns of every line."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        lines = table(spark, folder, "lineitem").selectExpr(*(f"{x} AS {c}" for c, x in _LONG_COLUMNS.items()))
        found = itemsets.frequent_itemsets(
            baskets.column_baskets(lines, list(_LONG_COLUMNS)), _LONG_SUPPORT, None, algorithm
        )
        return itemsets.itemset_text(found).select("itemset", "freq", "length")

    return run


_LONG_ITEMS = ", ".join(f"'{c}=' || {c}" for c in _LONG_COLUMNS)
ITEMSETS_LONG = f"""WITH t AS (SELECT {", ".join(f"{x} AS {c}" for c, x in _LONG_COLUMNS.items())} FROM lineitem),
g AS (SELECT list_sort(list_filter([{_LONG_ITEMS}], lambda x: x IS NOT NULL)) AS items, count(*) AS freq
 FROM t GROUP BY CUBE ({", ".join(_LONG_COLUMNS)}))
SELECT array_to_string(items, ', ') AS itemset, freq, len(items)::INT AS length FROM g
WHERE len(items) > 0 AND freq >= {_LONG_SUPPORT}::DOUBLE * (SELECT count(*) FROM t)"""

_TOP_SQL = f"WITH {_RULES} SELECT rule, {_MEASURES_SQL} FROM top"
QUERIES = {
    "transactions_text": (transactions_text, TRANSACTIONS_TEXT),
    "transactions_columns": (transactions_columns, TRANSACTIONS_COLUMNS),
    "detected_columns": (detected_columns, _detected_sql()),
    "transactions_rows": (transactions_rows, TRANSACTIONS_ROWS),
    "basket_summary": (
        basket_summary,
        f"WITH {_SETS} SELECT 'rows' AS method, any_value(n) AS transactions, count(*) AS distinct_items FROM f WHERE length = 1",
    ),
    "itemsets_apriori": (_itemsets("apriori"), ITEMSETS),
    "itemsets_in_tables": (itemsets_in_tables, ITEMSETS),
    "itemsets_fpgrowth": (_itemsets("fpgrowth"), ITEMSETS),
    "itemsets_long_apriori": (_itemsets_long("apriori"), ITEMSETS_LONG),
    "itemsets_long_fpgrowth": (_itemsets_long("fpgrowth"), ITEMSETS_LONG),
    "itemset_statistics": (itemset_statistics, ITEMSET_STATISTICS),
    "itemsets_by_length": (itemsets_by_length, f"WITH {_SETS} SELECT length, count(*) AS n FROM f GROUP BY length"),
    "rules_all": (rules_all, f"WITH {_RULES} SELECT rule, {_MEASURES_SQL} FROM r"),
    "rules_top": (rules_top, _TOP_SQL),
    "rules_unlimited": (
        rules_unlimited,
        f"WITH {_RULES} SELECT rule, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM r"
        f" WHERE confidence >= {CONFIDENCE}",
    ),
    "rule_statistics": (rule_statistics, RULE_STATISTICS),
    "rules_by_lift": (rules_by_lift, RULES_BY_LIFT),
    "lift_bands": (lift_bands, LIFT_BANDS),
    "rules_export": (rules_export, RULES_EXPORT),
    "analysis_for_target": (analysis_for_target, ANALYSIS_FOR_TARGET),
    "stored_analysis": (stored_analysis, _TOP_SQL),
}

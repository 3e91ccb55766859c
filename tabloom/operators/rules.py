"""Association rules from frequent itemsets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import ranked
from ..functions.sizing import cut_lineage

# Defaults and the relaxation of the confidence threshold.
MIN_CONFIDENCE = 0.6
MAX_RULES = 100
RELAX_STEP = 0.1
RELAX_FLOOR = 0.1
RELAX_TRIES = 5
# What counts as high, and the lift bands.
HIGH_CONFIDENCE = 0.8
HIGH_LIFT = 1.5
LIFT_BANDS = [(2.0, "excellent"), (1.5, "good"), (1.2, "fair")]
LIFT_LOWEST = "weak"
TOP_RULES = 10
# Export column names.
EXPORT_COLUMNS = [
    "Regla_ID",
    "Antecedente",
    "Consecuente",
    "Soporte",
    "Confianza",
    "Lift",
    "Leverage",
    "Conviction",
]


def _with_confidence(splits: DataFrame, itemsets: DataFrame, min_confidence: float) -> DataFrame:
    """Splits whose antecedent is known and predicts its itemset well enough.

    ``splits`` has the itemset, its count and the places of the consequent's items.
    """
    sides = splits.select(
        "items",
        "freq",
        "places",
        F.filter("items", lambda x, i: ~F.array_contains("places", i)).alias("antecedents"),
    )
    left = itemsets.select(F.col("items").alias("antecedents"), F.col("freq").alias("freq_a"))
    return sides.join(left, "antecedents").where(F.col("freq") / F.col("freq_a") >= min_confidence)


def _grown(itemsets: DataFrame, min_confidence: float) -> DataFrame:
    """``antecedents, consequents, freq, freq_a`` of all rules of the wanted confidence.

    An item moved from the antecedent to the consequent never raises the confidence, so
    a consequent is tried only when both consequents it overlaps from were good enough.
    Each level is a table; no subset of an itemset is made that the level before did not
    lead to.
    """
    longer = itemsets.where("length >= 2")
    longest = longer.agg(F.max("length")).first()[0] or 0
    single = longer.select(
        "items", "freq", F.explode(F.expr("transform(items, (x, i) -> array(i))")).alias("places")
    )
    level = cut_lineage(_with_confidence(single, itemsets, min_confidence))
    rules = level
    for size in range(2, longest):
        if level.isEmpty():
            break
        begin = level.where(F.size("items") > size).select(
            "items", "freq", F.slice("places", 1, size - 2).alias("shared"), F.element_at("places", -1).alias("last")
        )
        other = begin.select("items", "shared", F.col("last").alias("next"))
        tried = begin.join(other, ["items", "shared"]).where("last < next").select(
            "items", "freq", F.concat("shared", F.array("last", "next")).alias("places")
        )
        level = cut_lineage(_with_confidence(tried, itemsets, min_confidence))
        rules = rules.unionByName(level)
    return rules.select(
        "antecedents",
        F.filter("items", lambda x, i: F.array_contains("places", i)).alias("consequents"),
        "freq",
        "freq_a",
    )


def all_rules(itemsets: DataFrame, n: int, min_confidence: float = 0.0) -> DataFrame:
    """Rules of at least ``min_confidence`` with their measures; by default every split.

    Consequents grow level by level (see :func:`_grown`).  ``itemsets`` holds the parts
    of its itemsets, as mining gives it; where parts are missing, rules are found as far
    as consequents grow through known antecedents and are known themselves.
    """
    right = itemsets.select(F.col("items").alias("consequents"), F.col("freq").alias("freq_c"))
    total = F.lit(float(n))
    confidence = F.col("freq") / F.col("freq_a")
    support_c = F.col("freq_c") / total
    return (
        _grown(itemsets, min_confidence)
        .join(right, "consequents")
        .select(
            "antecedents",
            "consequents",
            (F.col("freq") / total).alias("support"),
            confidence.alias("confidence"),
            (confidence / support_c).alias("lift"),
            (F.col("freq") / total - F.col("freq_a") / total * support_c).alias("leverage"),
            F.when(F.col("freq") == F.col("freq_a"), F.lit(float("inf")))
            .otherwise((1.0 - support_c) / (1.0 - confidence))
            .alias("conviction"),
            F.array_join("antecedents", ", ").alias("antecedents_text"),
            F.array_join("consequents", ", ").alias("consequents_text"),
        )
        .withColumn("rule", F.concat_ws(" => ", "antecedents_text", "consequents_text"))
    )


def _by_quality(first: str = "confidence") -> list:
    """Order of rules: confidence and lift, then support and text to settle ties."""
    second = "lift" if first == "confidence" else "confidence"
    return [F.desc(first), F.desc(second), F.desc("support"), F.asc("rule")]


def relaxed_thresholds(min_confidence: float) -> list[float]:
    """The thresholds tried in turn, from the wanted one down to the floor."""
    out = [min_confidence]
    for _ in range(RELAX_TRIES - 1):
        out.append(min(min_confidence, max(RELAX_FLOOR, out[-1] - RELAX_STEP)))
    return out


@dataclass
class RuleSet:
    """Chosen rules and the confidence threshold that was really used."""

    rules: DataFrame
    min_confidence: float
    threshold: float


def generate_rules(
    itemsets: DataFrame,
    n: int,
    min_confidence: float = MIN_CONFIDENCE,
    max_rules: int | None = MAX_RULES,
) -> RuleSet:
    """The best ``max_rules`` rules, relaxing the confidence when there are too few.

    Rules are ranked by confidence first, so trying lower thresholds one after the
    other is the same as taking the top of the lowest threshold needed.  The rules of
    single consequents, which every growth begins with, tell how low that is at most.
    """
    if max_rules == 0:
        return RuleSet(all_rules(itemsets.limit(0), n), min_confidence, min_confidence)
    if max_rules is None:
        return RuleSet(all_rules(itemsets, n, min_confidence), min_confidence, min_confidence)
    tried = relaxed_thresholds(min_confidence)
    whole = itemsets.where("length >= 2").select("items", F.col("freq").alias("of"))
    singles = whole.select(
        "of", F.posexplode("items").alias("place", "item"), F.col("items").alias("all")
    ).select("of", F.filter("all", lambda x, i: i != F.col("place")).alias("items"))
    enough = _reached(singles.join(itemsets, "items").select((F.col("of") / F.col("freq")).alias("confidence")), tried)
    low = next((t for i, t in enumerate(tried) if enough[i] >= max_rules), tried[-1])
    rules = cut_lineage(all_rules(itemsets, n, low))
    tried = [t for t in tried if t >= low]
    counts = _reached(rules, tried)
    used = next((t for i, t in enumerate(tried) if counts[i] >= max_rules), tried[-1])
    return RuleSet(rules.orderBy(*_by_quality()).limit(max_rules), min_confidence, used)


def _reached(rules: DataFrame, thresholds: list[float]) -> list[int]:
    """How many rules reach each threshold."""
    counts = [F.count_if(F.col("confidence") >= t).alias(f"t{i}") for i, t in enumerate(thresholds)]
    return list(rules.agg(*counts).first())


def rules_for_target(rules: DataFrame, target: str) -> DataFrame:
    """Rules with a ``target=value`` item among the consequents."""
    return rules.where(F.exists("consequents", lambda x: x.startswith(f"{target}=")))


def rule_statistics(rules: DataFrame) -> DataFrame:
    return rules.agg(
        F.count(F.lit(1)).alias("total_rules"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("lift").alias("avg_lift"),
        F.avg("support").alias("avg_support"),
        F.max("confidence").alias("max_confidence"),
        F.max("lift").alias("max_lift"),
        F.count_if(F.col("confidence") >= HIGH_CONFIDENCE).alias("high_confidence"),
        F.count_if(F.col("lift") >= HIGH_LIFT).alias("high_lift"),
    )


def top_rules(rules: DataFrame, metric: str = "confidence", k: int = TOP_RULES) -> DataFrame:
    """The ``k`` best rules by confidence or lift."""
    if metric not in ("confidence", "lift"):
        raise ValueError("rank rules by confidence or lift")
    return rules.orderBy(*_by_quality(metric)).limit(k).select(
        "rule", "antecedents_text", "consequents_text", "support", "confidence", "lift", "conviction"
    )


def lift_band(rules: DataFrame) -> DataFrame:
    band = F.lit(LIFT_LOWEST)
    for limit, name in reversed(LIFT_BANDS):
        band = F.when(F.col("lift") >= limit, name).otherwise(band)
    return rules.withColumn("lift_band", band)


def export_rules(rules: DataFrame, rows: int | None = None) -> DataFrame:
    """The flat export table, numbered by quality.

    ``rows`` is a known bound on the number of rules, such as the ``max_rules`` they
    were chosen by.
    """
    columns = [
        F.col("__rank").cast("int"),
        F.col("antecedents_text"),
        F.col("consequents_text"),
        *[F.round(m, 4) for m in ("support", "confidence", "lift", "leverage")],
        F.when(F.col("conviction") == float("inf"), F.col("conviction")).otherwise(F.round("conviction", 4)),
    ]
    numbered = ranked(rules, *_by_quality(), rows=rows)
    return numbered.select(*[c.alias(name) for c, name in zip(columns, EXPORT_COLUMNS)])

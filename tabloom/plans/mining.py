"""The complete association analysis."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.baskets import Baskets, column_baskets, text_baskets
from ..operators.itemsets import (
    frequent_itemsets,
    itemset_statistics,
    itemsets_by_length,
    mining_limits,
)
from ..operators.rules import (
    MAX_RULES,
    MIN_CONFIDENCE,
    RuleSet,
    generate_rules,
    rule_statistics,
    rules_for_target,
)

# Default support and sample sizes.
MIN_SUPPORT = 0.1
LISTED_ITEMSETS = 50
SAMPLE_TRANSACTIONS = 5


@dataclass
class Analysis:
    """Result tables of one run."""

    baskets: Baskets
    itemsets: DataFrame
    rules: DataFrame
    rule_set: RuleSet
    min_support: float
    max_len: int | None

    @property
    def statistics(self) -> DataFrame:
        return rule_statistics(self.rules)

    @property
    def itemset_statistics(self) -> DataFrame:
        return itemset_statistics(self.itemsets)

    @property
    def itemsets_by_length(self) -> DataFrame:
        return itemsets_by_length(self.itemsets)

    @property
    def listed_itemsets(self) -> DataFrame:
        return self.itemsets.orderBy("length", "items").limit(LISTED_ITEMSETS)

    @property
    def sample_transactions(self) -> DataFrame:
        return self.baskets.data.limit(SAMPLE_TRANSACTIONS)


def analyze_associations(
    df: DataFrame,
    transaction_column: str | None = None,
    item_columns: Sequence[str] | None = None,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    max_len: int | None = None,
    max_rules: int | None = MAX_RULES,
    target: str | None = None,
    algorithm: str = "apriori",
    guard: bool = False,
) -> Analysis:
    """Baskets, itemsets and rules of a table.

    The target filter comes after the limit on the number of rules.  ``guard`` asks for
    the cautious limits of :func:`mining_limits`; what was used stands in the result.
    """
    n_columns = len(item_columns) if item_columns else len(df.columns)
    min_support, max_len = mining_limits(n_columns, min_support, max_len, guard)
    if transaction_column:
        baskets = text_baskets(df, transaction_column)
    else:
        baskets = column_baskets(df, item_columns)
    return analyze_baskets(baskets, min_support, min_confidence, max_len, max_rules, target, algorithm)


def analyze_baskets(
    baskets: Baskets,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    max_len: int | None = None,
    max_rules: int | None = MAX_RULES,
    target: str | None = None,
    algorithm: str = "apriori",
) -> Analysis:
    """The same from ready baskets."""
    itemsets = frequent_itemsets(baskets, min_support, max_len, algorithm)
    chosen = generate_rules(itemsets, baskets.n, min_confidence, max_rules)
    rules = rules_for_target(chosen.rules, target) if target else chosen.rules
    return Analysis(baskets, itemsets, rules, chosen, min_support, max_len)

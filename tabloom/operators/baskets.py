"""Transactions as sorted arrays of distinct items."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.columns import col, strip_text
from ..functions.sizing import cut_lineage, join_by_size
from ..functions.statistics import distinct_counts

# Cell texts that are no item; distinct values of an item column.
NO_ITEM = ["", "0", "nan", "NaN"]
ITEM_COLUMN_MIN = 2
ITEM_COLUMN_MAX = 50
ITEM_COLUMNS_NEEDED = 2

# Rows of each kind from which equal ones are grouped.
EQUAL = 4


@dataclass
class Baskets:
    """Transactions in ``items`` and the number they are measured against.

    ``groups`` has the different ones with their ``freq`` where they are far fewer.
    """

    data: DataFrame
    n: int
    method: str
    groups: DataFrame | None = None

    def info(self) -> DataFrame:
        """One row: method, transactions, distinct items."""
        return self.data.select(F.explode("items").alias("i")).agg(
            F.lit(self.method).alias("method"),
            F.lit(self.n).cast("long").alias("transactions"),
            F.count_distinct("i").alias("distinct_items"),
        )


def items_from_text(df: DataFrame, column: str) -> DataFrame:
    """Split a text column at ``,`` and ``;`` into ``items``; null rows are dropped.

    A row without any item stays as an empty transaction.  Spaces do not separate.
    """
    parts = F.transform(F.split(F.translate(col(column), ";", ","), ","), strip_text)
    items = F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))
    return df.where(col(column).isNotNull()).select("*", items.alias("items"))


def items_from_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One ``column=value`` item per usable cell; rows without items are dropped."""
    cells = []
    for c in columns:
        text = strip_text(col(c).cast("string"))
        item = F.concat(F.lit(f"{c.strip()}="), text)
        cells.append(F.when(text.isNotNull() & ~text.isin(NO_ITEM), item))
    items = F.array_sort(F.array_distinct(F.array_compact(F.array(*cells))))
    return df.select("*", items.alias("items")).where(F.size("items") > 0)


def item_columns(df: DataFrame) -> list[str]:
    """Columns with 2 to 50 distinct values.

    Key-like columns are ruled out by a sketch; only the others are counted.
    """
    rows = distinct_counts(df, df.columns, exact=False).collect()
    found = {r["column_name"] for r in rows if ITEM_COLUMN_MIN <= r["distinct_values"] <= ITEM_COLUMN_MAX}
    return [c for c in df.columns if c in found]


def detect_item_columns(df: DataFrame) -> list[str]:
    found = item_columns(df)
    if len(found) < ITEM_COLUMNS_NEEDED:
        raise ValueError(
            f"{len(found)} columns with {ITEM_COLUMN_MIN} to {ITEM_COLUMN_MAX} distinct values; "
            f"{ITEM_COLUMNS_NEEDED} are needed. Name the transaction or item columns."
        )
    return found


def items_from_rows(df: DataFrame, tid: str, item: str) -> DataFrame:
    """One transaction per ``tid`` with all of its items."""
    items = F.array_sort(F.collect_set(col(item).cast("string")))
    return df.where(col(item).isNotNull()).groupBy(col(tid)).agg(items.alias("items"))


def text_baskets(df: DataFrame, column: str) -> Baskets:
    data = items_from_text(df, column).select("items")
    return Baskets(data, df.where(col(column).isNotNull()).count(), "transaction_column")


def column_baskets(df: DataFrame, columns: Sequence[str] | None = None) -> Baskets:
    """Baskets of a table's columns; rows that are often equal become items once."""
    chosen = list(columns) if columns else detect_item_columns(df)
    data = items_from_columns(df, chosen).select("items")
    # Items are made of the cells' texts.
    texts = df.select(*[col(c).cast("string").alias(c) for c in dict.fromkeys(chosen)])
    rows, kinds = texts.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*[col(c) for c in texts.columns]))).first()
    if EQUAL * kinds > rows:
        return Baskets(data, data.count(), "item_columns")
    counted = texts.groupBy(*[col(c) for c in texts.columns]).agg(F.count(F.lit(1)).alias("__freq"))
    groups = cut_lineage(
        items_from_columns(counted, chosen).groupBy("items").agg(F.sum("__freq").alias("freq"))
    )
    return Baskets(data, groups.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0], "item_columns", groups)


def row_baskets(df: DataFrame, tid: str, item: str, min_support: float) -> Baskets:
    """Baskets of a long table for mining at ``min_support``.

    Items below the support cannot be part of any result, so they are removed before
    rows are brought together: a transaction never holds more than the frequent
    items, however many rows its key has.  ``n`` still counts every transaction.
    The distinct pairs are spread over both columns and persisted, so ``df`` (often a
    join) is computed once for the three aggregates.
    """
    pairs = (
        df.select(col(tid).alias("tid"), col(item).cast("string").alias("item"))
        .where(F.col("tid").isNotNull() & F.col("item").isNotNull())
        .distinct()
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    n = pairs.agg(F.count_distinct("tid")).first()[0]
    frequent = (
        pairs.groupBy("item")
        .agg(F.count(F.lit(1)).alias("freq"))
        .where(F.col("freq") / F.lit(n) >= min_support)
        .select("item")
    )
    kept = frequent.count()
    data = (
        join_by_size(pairs, frequent, "item", "left_semi", kept)
        .groupBy("tid")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select("items")
    )
    return Baskets(data, n, "rows")

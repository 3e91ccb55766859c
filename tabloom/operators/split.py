"""Deterministic train/test split with exact class quotas.

Every row gets a hash of its key and a seed; each class gives its smallest hashes
to the test side until its quota is met.  Ranking whole classes would put a large
class into one task, so only bucket counts are ranked: a prefix of the hash is the
bucket, the bucket in which a quota ends is found from the counts, and only the
rows of that bucket (about ``n / buckets``) are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.ranking import ranked
from ..functions.sizing import join_by_size

# Minimum size, size bands, test share and seed.
MINIMUM_ROWS = 5
ONE_TEST_ROW_BELOW = 10
TENTH_BELOW = 25
TENTH_SHARE = 0.1
TEST_SHARE = 0.2
SEED = 42

# Rows per bucket that are cheap to rank in one task.
BUCKET_ROWS = 20_000


@dataclass
class Split:
    """The table with its ``is_test`` flag, and what was decided on the way."""

    data: DataFrame
    n_rows: int
    n_test: int
    n_train: int
    n_classes: int
    original_rows: int
    original_classes: int
    removed_classes: DataFrame | None
    stratified: bool

    @property
    def train(self) -> DataFrame:
        return self.data.where(~F.col("is_test")).drop("is_test")

    @property
    def test(self) -> DataFrame:
        return self.data.where(F.col("is_test")).drop("is_test")


def planned_test_rows(n: int) -> int | float:
    """Test rows as a count (small tables) or a share, from the size before filtering."""
    if n < MINIMUM_ROWS:
        raise ValueError(f"{n} rows: at least {MINIMUM_ROWS} are needed for training")
    if n < ONE_TEST_ROW_BELOW:
        return 1
    if n < TENTH_BELOW:
        return max(1, int(n * TENTH_SHARE))
    return TEST_SHARE


def drop_rare_classes(
    df: DataFrame, label: str, minimum: int = 2, rare_classes: int | None = None
) -> DataFrame:
    """Rows whose class has at least ``minimum`` rows; null labels are dropped.

    ``rare_classes`` is the number of such classes where the caller knows it.
    """
    rare = class_sizes(df, label).where(F.col("n") < minimum).select(col(label))
    return join_by_size(df.where(col(label).isNotNull()), rare, label, "left_anti", rare_classes)


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.where(col(label).isNotNull()).groupBy(col(label)).agg(F.count(F.lit(1)).alias("n"))


def class_quotas(
    sizes: DataFrame, label: str, n_rows: int, n_test: int, n_classes: int | None = None
) -> DataFrame:
    """Proportional test quota per class, remainders to the largest fractions.

    ``sizes`` has one row per class; ``n_classes`` is their number where known.
    """
    share = F.col("n") * F.lit(n_test)
    base = (share - share % F.lit(n_rows)) / F.lit(n_rows)
    parts = sizes.withColumn("base", base.cast("bigint")).withColumn("rest", share % F.lit(n_rows))
    given = parts.agg(F.coalesce(F.sum("base"), F.lit(0))).first()[0]
    return ranked(parts, F.col("rest").desc(), col(label), rows=n_classes).select(
        col(label),
        "n",
        (F.col("base") + (F.col("__rank") <= F.lit(n_test - given)).cast("int")).alias("quota"),
    )


def flag_smallest(
    df: DataFrame, label: str, quotas: DataFrame, key: Sequence[str], seed: int, n_rows: int,
    n_classes: int | None,
) -> DataFrame:
    """Flag the ``quota`` smallest key hashes of every class as ``is_test``."""
    digits = max(1, min(7, math.ceil(math.log(max(n_rows, 1) / BUCKET_ROWS + 1, 16))))
    digest = F.md5(F.concat_ws("-", *[col(k).cast("string") for k in key], F.lit(str(seed))))
    keyed = df.withColumn("__hash", digest).withColumn("__bucket", F.substring("__hash", 1, digits))
    buckets = keyed.groupBy(col(label), "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    running = Window.partitionBy(col(label)).orderBy("__bucket")
    cut = (
        buckets.withColumn("__upto", F.sum("__n").over(running))
        .join(quotas.select(col(label), "quota"), label)
        .where((F.col("__upto") >= F.col("quota")) & (F.col("__upto") - F.col("__n") < F.col("quota")))
        .select(
            col(label),
            F.col("__bucket").alias("__cut"),
            (F.col("quota") - F.col("__upto") + F.col("__n")).alias("__left"),
        )
    )
    marked = join_by_size(keyed, cut, label, "left", n_classes)
    clear = marked.where(F.col("__cut").isNull() | (F.col("__bucket") != F.col("__cut"))).withColumn(
        "is_test", F.coalesce(F.col("__bucket") < F.col("__cut"), F.lit(False))
    )
    edge_order = Window.partitionBy(col(label)).orderBy("__hash", *[col(k) for k in key])
    edge = marked.where(F.col("__bucket") == F.col("__cut")).withColumn(
        "is_test", F.row_number().over(edge_order) <= F.col("__left")
    )
    wanted = [col(c) for c in df.columns] + [F.col("is_test")]
    return clear.select(*wanted).unionAll(edge.select(*wanted))


def train_test_split(
    df: DataFrame, key: Sequence[str], label: str | None = None, seed: int = SEED
) -> Split:
    """Split ``df`` by row key; with ``label`` stratified by class.

    Classes with one row are removed first.  When the planned test side cannot hold
    every class, the split falls back to an unstratified one.
    """
    if label is None:
        n = df.count()
        sizes_row = {"classes": 1, "rows": n, "kept_rows": n, "kept_classes": 1}
        removed = None
    else:
        sizes = class_sizes(df, label)
        sizes_row = sizes.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.count("n").alias("classes"),
            F.coalesce(F.sum(F.when(F.col("n") >= 2, F.col("n"))), F.lit(0)).alias("kept_rows"),
            F.count_if(F.col("n") >= 2).alias("kept_classes"),
        ).first().asDict()
        removed = sizes.where(F.col("n") < 2)
        df = df.where(col(label).isNotNull())
        if sizes_row["kept_rows"] < sizes_row["rows"]:
            gone = sizes_row["classes"] - sizes_row["kept_classes"]
            df = drop_rare_classes(df, label, rare_classes=gone)
    plan = planned_test_rows(sizes_row["rows"])
    n, classes = sizes_row["kept_rows"], sizes_row["kept_classes"]
    n_test = plan if isinstance(plan, int) else math.ceil(round(plan * n, 9))
    if n_test >= n:
        raise ValueError(f"{n} rows are left after removing one-row classes; nothing to train on")
    stratified = label is not None and classes <= n_test and classes <= n - n_test
    if stratified:
        kept = sizes.where(F.col("n") >= 2)
        quotas = class_quotas(kept, label, n, n_test, classes)
        data = flag_smallest(df, label, quotas, key, seed, n, classes)
    else:
        one = df.withColumn("__all", F.lit(0))
        quotas = df.sparkSession.createDataFrame([(0, n_test)], "__all int, quota bigint")
        data = flag_smallest(one, "__all", quotas, key, seed, n, 1).drop("__all")
    return Split(
        data, n, n_test, n - n_test, classes, sizes_row["rows"], sizes_row["classes"], removed, stratified
    )

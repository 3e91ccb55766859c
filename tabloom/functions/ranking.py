"""Row numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizing import SMALL_ROWS, cut_lineage


def ranked(df: DataFrame, *order: Column, rows: int | None = None) -> DataFrame:
    """``df`` with ``__rank``, from 1 in the given order (which should have no ties).

    ``rows`` is a bound on the number of rows that the caller already knows.  Up to
    ``SMALL_ROWS`` a window numbers them.  Otherwise the rows are range-sorted and
    checkpointed, so that their places are fixed, and each partition starts at the
    count of those before it: only one row per partition is summed up in one task.
    """
    if rows is not None and rows <= SMALL_ROWS:
        return df.withColumn("__rank", F.row_number().over(Window.orderBy(*order)))
    placed = cut_lineage(
        df.orderBy(*order).select(
            "*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__seq")
        )
    )
    starts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__seq").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.join(starts, "__part").select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("__before") + F.col("__seq") - F.col("__first") + 1).alias("__rank"),
    )

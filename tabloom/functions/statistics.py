"""Column statistics that stay exact and distributed at any size.

Spark's own ``percentile``/``median``/``mode`` keep every distinct value of a
column in one aggregation buffer.  That is right for small tables and is used
there; above a row bound the same answers come from narrowing passes, each one a
partial aggregate without a wide shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col, quoted
from .sizing import SMALL_ROWS, collect_if_small

# Rows of all columns together up to which the in-buffer percentile is used: the one
# final buffer then holds some 100 MB at most, however wide the table is.
DIRECT_ROWS = 4_000_000
# Expressions per aggregate; wider requests are split over several passes.
WIDE = 400


def wide_aggregate(df: DataFrame, exprs: Mapping[str, Column]) -> dict:
    """Evaluate many scalar aggregates in as few passes as possible."""
    out: dict = {}
    names = list(exprs)
    for start in range(0, len(names), WIDE):
        part = names[start : start + WIDE]
        row = df.agg(*[exprs[n].alias(n) for n in part]).first()
        out.update({n: row[n] for n in part})
    return out


@dataclass
class _Target:
    """One wanted order statistic: the ``rank``-th smallest value of a column."""

    column: str
    rank: int
    low: float
    high: float
    value: float | None = None


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    direct_rows: int = DIRECT_ROWS,
    accuracy: int = 10_000,
    value_rows: int = SMALL_ROWS,
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation; all-null columns give ``None``.

    Up to ``direct_rows`` values in all columns this is one aggregate.  Beyond, a sketch brackets
    each wanted order statistic, one aggregate per round counts what lies below
    and inside the brackets and sketches again inside them, and once a bracket has
    few distinct values they are counted and walked.  No round moves more than the
    per-partition partial aggregates.
    """
    columns = list(columns)
    if not columns:
        return {}
    counts = wide_aggregate(df, {c: F.expr(f"count({quoted(c)})") for c in columns})
    if sum(counts.values()) <= direct_rows:
        probs = "array(" + ", ".join(f"{float(p)!r}D" for p in probabilities) + ")"
        got = wide_aggregate(
            df,
            {
                c: F.expr(f"percentile(cast({quoted(c)} AS double), {probs})")
                for c in columns
                if counts[c]
            },
        )
        return {c: list(got[c]) if counts[c] else [None] * len(probabilities) for c in columns}

    wanted: dict[tuple[str, int], _Target] = {}
    for c in columns:
        for p in probabilities:
            position = p * (counts[c] - 1)
            for rank in {math.floor(position), math.ceil(position)} if counts[c] else ():
                wanted[c, rank] = _Target(c, rank, -math.inf, math.inf)
    _narrow(df, list(wanted.values()), counts, accuracy, value_rows)

    out: dict[str, list[float | None]] = {}
    for c in columns:
        out[c] = []
        for p in probabilities:
            if not counts[c]:
                out[c].append(None)
                continue
            position = p * (counts[c] - 1)
            low = wanted[c, math.floor(position)].value
            high = wanted[c, math.ceil(position)].value
            out[c].append(low + (high - low) * (position - math.floor(position)))
    return out


def _inside(t: _Target) -> Column:
    c = col(t.column).cast("double")
    return (c >= F.lit(t.low)) & (c <= F.lit(t.high))


def _narrow(df, targets, counts, accuracy, value_rows) -> None:
    """Shrink the bracket of every target until its values can be walked."""
    below = {id(t): 0 for t in targets}
    inside = {id(t): counts[t.column] for t in targets}
    finer = {id(t): accuracy for t in targets}
    open_targets = list(targets)
    while open_targets:
        # Sketch bounds around the wanted rank, at twice the sketch's rank error.
        exprs = {}
        for i, t in enumerate(open_targets):
            n = inside[id(t)]
            centre = (t.rank - below[id(t)]) / max(n - 1, 1)
            margin = 2.0 / finer[id(t)] + 2.0 / n
            probs = F.array(F.lit(max(0.0, centre - margin)), F.lit(min(1.0, centre + margin)))
            exprs[f"b{i}"] = F.percentile_approx(
                F.when(_inside(t), col(t.column).cast("double")), probs, finer[id(t)]
            )
        bounds = wide_aggregate(df, exprs)
        old = {id(t): (t.low, t.high) for t in open_targets}
        for i, t in enumerate(open_targets):
            t.low, t.high = bounds[f"b{i}"]
        exprs = {}
        for i, t in enumerate(open_targets):
            c = col(t.column).cast("double")
            exprs[f"l{i}"] = F.count_if(c < F.lit(t.low))
            exprs[f"n{i}"] = F.count_if(_inside(t))
            exprs[f"d{i}"] = F.approx_count_distinct(F.when(_inside(t), c))
        facts = wide_aggregate(df, exprs)
        room = max(1, value_rows // (2 * len(open_targets)))
        ready = []
        for i, t in enumerate(open_targets):
            key, n_below, n_inside = id(t), facts[f"l{i}"], facts[f"n{i}"]
            if not n_below <= t.rank < n_below + n_inside:
                # The sketch missed: go back to the old bracket and sketch more finely.
                t.low, t.high = old[key]
                finer[key] *= 4
                continue
            if n_inside > inside[key] // 2:
                finer[key] *= 4
            below[key], inside[key] = n_below, n_inside
            if t.low == t.high:
                t.value = t.low
            elif n_inside <= room or facts[f"d{i}"] <= room:
                ready.append(t)
        _walk_values(df, ready, below, value_rows)
        open_targets = [t for t in open_targets if t.value is None]


def _walk_values(df, targets, below, value_rows) -> None:
    """Finish brackets that hold few distinct values."""
    if not targets:
        return
    tagged = df.select(
        F.explode(
            F.array_compact(
                F.array(
                    *[
                        F.when(
                            _inside(t),
                            F.struct(F.lit(i).alias("t"), col(t.column).cast("double").alias("v")),
                        )
                        for i, t in enumerate(targets)
                    ]
                )
            )
        ).alias("x")
    ).groupBy("x.t", "x.v").agg(F.count(F.lit(1)).alias("n"))
    rows = collect_if_small(tagged, value_rows)
    if rows is None:  # the distinct estimate was far off: keep narrowing
        return
    for i, t in enumerate(targets):
        seen = below[id(t)]
        for v, n in sorted((r["v"], r["n"]) for r in rows if r["t"] == i):
            seen += n
            if seen > t.rank:
                t.value = v
                break


def typed_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(__c, whole, number, text, n)``: every value of every column with its count.

    ``__c`` is the position in ``columns``; a value sits in the field of its type, so
    numbers are never turned into text before they are combined.  Floats and decimals
    have their size in ``number``, for the order, and their own digits in ``text``.
    One shuffle serves all columns, and equal values are combined before it.
    """
    types = {f.name: f.dataType for f in df.schema}
    structs = []
    for i, c in enumerate(columns):
        whole = isinstance(types[c], (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        number = isinstance(types[c], (T.DoubleType, T.FloatType, T.DecimalType))
        digits = not whole and not isinstance(types[c], T.DoubleType)
        # Adding zero makes a negative zero positive, as grouping does with numbers.
        value = col(c) + F.lit(0.0).cast("float") if isinstance(types[c], T.FloatType) else col(c)
        structs.append(
            F.struct(
                F.lit(i).alias("__c"),
                (col(c) if whole else F.lit(None)).cast("bigint").alias("whole"),
                (value if number else F.lit(None)).cast("double").alias("number"),
                (value if digits else F.lit(None)).cast("string").alias("text"),
            )
        )
    return (
        df.select(F.inline(F.array(*structs)))
        .where("whole IS NOT NULL OR number IS NOT NULL OR text IS NOT NULL")
        .groupBy("__c", "whole", "number", "text")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _column_name(columns: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("__c") + 1).alias("column_name")


def _value_text() -> Column:
    return F.coalesce("text", F.col("whole").cast("string"), F.col("number").cast("string"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, value, n)`` over all ``columns``, values as text, nulls left out."""
    return typed_counts(df, columns).select(
        _column_name(columns), _value_text().alias("value"), "n"
    )


def distinct_counts(
    df: DataFrame, columns: Sequence[str], exact: bool = True, exact_below: int = 1_000
) -> DataFrame:
    """``(column_name, distinct_values)`` for each column.

    ``exact=False`` takes one sketch pass and counts exactly only the columns whose
    estimate is small enough to matter for a threshold; the others keep the
    estimate, which saves shuffling every value of key-like columns.
    """
    spark = df.sparkSession
    schema = "column_name string, distinct_values bigint"
    columns = list(columns)
    if exact:
        counted = columns
        estimates: list[tuple[str, int]] = []
    else:
        sketch = wide_aggregate(df, {c: F.approx_count_distinct(col(c)) for c in columns})
        counted = [c for c in columns if sketch[c] <= exact_below]
        estimates = [(c, sketch[c]) for c in columns if c not in counted]
    # At most one row per column, so it is small enough to broadcast by construction.
    present = (
        F.broadcast(
            typed_counts(df, counted)
            .groupBy("__c")
            .agg(F.count(F.lit(1)).alias("distinct_values"))
            .select(_column_name(counted), "distinct_values")
        )
        if counted
        else spark.createDataFrame([], schema)
    )
    names = spark.createDataFrame([(c,) for c in counted], "column_name string")
    exact_part = names.join(present, "column_name", "left").select(
        "column_name", F.coalesce("distinct_values", F.lit(0)).alias("distinct_values")
    )
    if not estimates:
        return exact_part
    return exact_part.unionByName(spark.createDataFrame(estimates, schema))


def most_frequent(counts: DataFrame) -> DataFrame:
    """``(column_name, value)`` with the highest count, smallest value on ties."""
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("v")))
    return counts.groupBy("column_name").agg(best.alias("b")).select(
        "column_name", F.col("b.v").alias("value")
    )


def smallest_values(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """``(column_name, sample_values)``: the ``k`` smallest distinct values as text.

    The ranking is cut to ``k`` per partition before the shuffle.
    """
    order = Window.partitionBy("__c").orderBy("whole", "number", "text")
    ranked = typed_counts(df, columns).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    per_column = ranked.groupBy("__c").agg(
        F.array_sort(F.collect_list(F.struct("rank", _value_text().alias("value")))).alias("s")
    )
    return per_column.select(_column_name(columns), F.col("s.value").alias("sample_values"))

"""Cleaning: empty and sparse rows, empty columns, duplicates, spaces, scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.columns import (
    col,
    nan_to_null,
    null_count,
    numeric_columns,
    strip_text,
    text_columns,
)
from ..functions.statistics import distinct_counts, exact_quantiles, wide_aggregate
from .profile import SCALE_MAX_WITH_NEGATIVES, SCALE_MIN_DISTINCT, SCALE_RANGE, SCALE_STD

SCALERS = ("standard", "minmax", "robust")


# --- single steps -----------------------------------------------------------


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Rows with at least one value."""
    return df.where(null_count(df.columns) < len(df.columns))


def drop_sparse_rows(df: DataFrame) -> DataFrame:
    """Rows with at most half of their columns missing."""
    return df.where(null_count(df.columns) * 2 <= len(df.columns))


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without any value, from one aggregate."""
    counts = wide_aggregate(df, {c: F.count(col(c)) for c in df.columns})
    return [c for c in df.columns if counts[c] == 0]


def drop_empty_columns(df: DataFrame, protected: Sequence[str] = ()) -> DataFrame:
    gone = [c for c in empty_columns(df) if c not in set(protected)]
    return df.select(*[col(c) for c in df.columns if c not in gone])


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One copy of each row; nulls are equal to each other."""
    return df.dropDuplicates()


def strip_text_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    chosen = set(text_columns(df) if columns is None else columns)
    return df.select(
        *[strip_text(col(c)).alias(c) if c in chosen else col(c) for c in df.columns]
    )


@dataclass
class Scaling:
    """Fitted scalers: ``column -> (centre, divisor)``."""

    method: str
    parameters: dict[str, tuple[float, float]] = field(default_factory=dict)

    def expression(self, name: str) -> Column:
        centre, divisor = self.parameters[name]
        return (col(name).cast("double") - F.lit(centre)) / F.lit(divisor)

    def apply(self, df: DataFrame) -> DataFrame:
        """Nulls stay null; every scaled column becomes double."""
        return df.select(
            *[
                self.expression(c).alias(c) if c in self.parameters else col(c)
                for c in df.columns
            ]
        )


def fit_scaling(df: DataFrame, columns: Sequence[str], method: str = "standard") -> Scaling:
    """Learn centre and spread in one aggregate (two for ``robust`` on large tables).

    Standard uses the population deviation, minmax the range, robust the median and
    the interpolated quartile distance.  A spread of zero divides by one.
    """
    if method not in SCALERS:
        method = "standard"
    if method == "robust":
        quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        raw = {c: (q[1], q[2] - q[0]) for c, q in quartiles.items() if q[1] is not None}
    else:
        exprs = {}
        for c in columns:
            v = col(c).cast("double")
            centre, spread = (
                (F.avg(v), F.stddev_pop(v)) if method == "standard" else (F.min(v), F.max(v) - F.min(v))
            )
            exprs["c" + c], exprs["s" + c] = centre, spread
        got = wide_aggregate(df, exprs)
        raw = {c: (got["c" + c], got["s" + c]) for c in columns if got["c" + c] is not None}
    return Scaling(method, {c: (centre, spread or 1.0) for c, (centre, spread) in raw.items()})


def scale(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    return fit_scaling(df, columns, method).apply(df)


def columns_to_scale(
    df: DataFrame, columns: Sequence[str], negatives_rule: bool = True
) -> list[str]:
    """Columns whose spread calls for scaling.

    ``negatives_rule`` adds the clause for ranges from below zero to above 1000,
    which automatic cleaning leaves out.
    """
    if not columns:
        return []
    exprs = {}
    for c in columns:
        v = col(c).cast("double")
        exprs.update({"lo" + c: F.min(v), "hi" + c: F.max(v), "sd" + c: F.stddev_samp(v)})
    got = wide_aggregate(df, exprs)
    spread_out = []
    for c in columns:
        lo, hi, sd = got["lo" + c], got["hi" + c], got["sd" + c]
        if lo is None:
            continue
        if (
            hi - lo > SCALE_RANGE
            or (sd is not None and sd > SCALE_STD)
            or (negatives_rule and lo < 0 and hi > SCALE_MAX_WITH_NEGATIVES)
        ):
            spread_out.append(c)
    if not spread_out:
        return []
    # Only "more than five values" matters, so the sketch decides key-like columns.
    distinct = {
        r["column_name"]: r["distinct_values"]
        for r in distinct_counts(df, spread_out, exact=False).collect()
    }
    return [c for c in spread_out if distinct[c] > SCALE_MIN_DISTINCT]


# --- whole procedures -------------------------------------------------------


@dataclass(frozen=True)
class CleaningOptions:
    """Which steps of manual cleaning to run."""

    remove_empty_rows: bool = False
    remove_rows_many_missing: bool = False
    remove_empty_cols: bool = False
    remove_duplicates: bool = False
    clean_text_spaces: bool = False
    normalize_data: bool = False
    normalization_method: str = "standard"

    @property
    def any_step(self) -> bool:
        return (
            self.remove_empty_rows
            or self.remove_rows_many_missing
            or self.remove_empty_cols
            or self.remove_duplicates
            or self.clean_text_spaces
            or self.normalize_data
        )


@dataclass
class CleaningResult:
    data: DataFrame
    report: DataFrame


class _Report:
    def __init__(self) -> None:
        self.rows: list[tuple[int, str, int, str]] = []

    def add(self, step: str, affected: int, columns: Sequence[str] = ()) -> None:
        self.rows.append((len(self.rows) + 1, step, int(affected), ", ".join(columns)))

    def frame(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(
            self.rows, "position int, step string, affected bigint, columns string"
        )


def _count_duplicates(df: DataFrame) -> int:
    copies = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    row = copies.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("extra")).first()
    return row["extra"]


def _padded_columns(facts: dict, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if facts.get("padded:" + c)]


def clean(
    df: DataFrame,
    options: CleaningOptions,
    protected: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> CleaningResult:
    """Manual cleaning: empty rows, sparse rows, empty columns, duplicates, spaces, scaling.

    ``columns`` limits the table first; ``protected`` columns survive when empty and
    are the only ones scaled.  The report has one row per chosen step.  Row filters,
    column emptiness and padding are counted in one pass over the input; duplicates
    take one shuffle; only scaling needs the de-duplicated rows a second time.
    """
    data = nan_to_null(df if columns is None else df.select(*[col(c) for c in columns]))
    report = _Report()
    if not options.any_step:
        report.add("nothing_selected", 0)
        return CleaningResult(data, report.frame(df))

    width = len(data.columns)
    nulls = null_count(data.columns)
    keep_filled = (nulls < width) if options.remove_empty_rows else F.lit(True)
    keep_dense = (nulls * 2 <= width) if options.remove_rows_many_missing else F.lit(True)
    kept = keep_filled & keep_dense
    exprs = {
        "empty": F.count_if(~keep_filled),
        "sparse": F.count_if(keep_filled & ~keep_dense),
    }
    for i, c in enumerate(data.columns):
        exprs[f"v{i}"] = F.count(F.when(kept, col(c)))
    for c in text_columns(data):
        exprs["padded:" + c] = F.bool_or(F.when(kept, strip_text(col(c)) != col(c)))
    facts = wide_aggregate(data, exprs)

    out = data.where(kept)
    if options.remove_empty_rows:
        report.add("remove_empty_rows", facts["empty"])
    if options.remove_rows_many_missing:
        report.add("remove_rows_many_missing", facts["sparse"])
    if options.remove_empty_cols:
        empty = [c for i, c in enumerate(data.columns) if facts[f"v{i}"] == 0]
        gone = [c for c in empty if c not in set(protected)]
        held = [c for c in empty if c in set(protected)]
        out = out.select(*[col(c) for c in out.columns if c not in gone])
        report.add("remove_empty_cols", len(gone), gone)
        if held:
            report.add("kept_empty_cols", len(held), held)
    if options.remove_duplicates:
        report.add("remove_duplicates", _count_duplicates(out))
        out = drop_duplicate_rows(out)
    if options.clean_text_spaces:
        padded = _padded_columns(facts, text_columns(out))
        out = strip_text_columns(out, padded)
        report.add("clean_text_spaces", len(padded), padded)
    if options.normalize_data:
        candidates = [c for c in numeric_columns(out) if c in set(protected)]
        out, chosen = _scale_step(out, candidates, options.normalization_method, True)
        report.add("normalize_data", len(chosen), chosen)
    return CleaningResult(out, report.frame(df))


def clean_automatically(df: DataFrame, columns: Sequence[str] | None = None) -> CleaningResult:
    """Automatic cleaning, with every step on and its own order.

    Empty rows, empty columns (none protected), duplicates, sparse rows, spaces and
    standard scaling.  Sparse rows are judged on the columns that are left, so the
    outcome can differ from :func:`clean`.  ``columns`` limits what is scaled.
    """
    data = nan_to_null(df)
    report = _Report()
    width = len(data.columns)
    filled = null_count(data.columns) < width
    exprs = {"empty": F.count_if(~filled)}
    exprs.update({f"v{i}": F.count(col(c)) for i, c in enumerate(data.columns)})
    first = wide_aggregate(data, exprs)
    gone = [c for i, c in enumerate(data.columns) if first[f"v{i}"] == 0]
    out = data.where(filled).select(*[col(c) for c in data.columns if c not in gone])
    report.add("remove_empty_rows", first["empty"])
    report.add("remove_empty_cols", len(gone), gone)

    dense = null_count(out.columns) * 2 <= len(out.columns)
    copies = out.groupBy(*[col(c) for c in out.columns]).agg(F.count(F.lit(1)).alias("__n"))
    exprs = {
        "duplicates": F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)),
        "sparse": F.count_if(~dense),
    }
    for c in text_columns(out):
        exprs["padded:" + c] = F.bool_or(F.when(dense, strip_text(col(c)) != col(c)))
    second = wide_aggregate(copies, exprs)
    report.add("remove_duplicates", second["duplicates"])
    report.add("remove_rows_many_missing", second["sparse"])
    padded = _padded_columns(second, text_columns(out))
    out = strip_text_columns(drop_duplicate_rows(out).where(dense), padded)
    report.add("clean_text_spaces", len(padded), padded)

    candidates = [c for c in numeric_columns(out) if not columns or c in set(columns)]
    out, chosen = _scale_step(out, candidates, "standard", False)
    report.add("normalize_data", len(chosen), chosen)
    return CleaningResult(out, report.frame(df))


def _scale_step(
    df: DataFrame, candidates: Sequence[str], method: str, negatives_rule: bool
) -> tuple[DataFrame, list[str]]:
    """Decide and fit scaling over one persisted copy of the numeric candidates."""
    if not candidates:
        return df, []
    narrow = df.select(*[col(c) for c in candidates]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        chosen = columns_to_scale(narrow, candidates, negatives_rule)
        scaling = fit_scaling(narrow, chosen, method) if chosen else None
    finally:
        narrow.unpersist()
    return (scaling.apply(df) if scaling else df), chosen


def skip_cleaning(df: DataFrame, columns: Sequence[str]) -> CleaningResult:
    """Only project the chosen columns that exist."""
    report = _Report()
    report.add("omitted", 0)
    return CleaningResult(
        df.select(*[col(c) for c in columns if c in df.columns]), report.frame(df)
    )

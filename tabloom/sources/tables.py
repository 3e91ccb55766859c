"""Reading and writing tables: robust CSV, type inference, previews, sinks."""

from __future__ import annotations

import warnings
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, text_columns
from ..functions.names import clean_name, match_names, unique_names
from ..functions.statistics import wide_aggregate
from .dialect import SPARK_ENCODING, Dialect, detect_dialects, with_records

# Cell texts that mean "missing".
MISSING_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]
# Spellings of truth values, number shape, preview sizes, minimum structure.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]
INTEGER = r"^\s*[+-]?\d+\s*$"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
PREVIEW_ROWS = 5
PREVIEW_WIDTH = 50
MIN_COLUMNS = 2
MIN_ROWS = 1
# Column coverage a source needs, for training and for retraining.
TRAINING_COVERAGE = 80.0
RETRAINING_COVERAGE = 50.0
PRIORITY_NAME_PARTS = ["datos_", "archivo_"]


# --- CSV in -------------------------------------------------------------------


def read_dialects(
    spark: SparkSession,
    dialects: Sequence[Dialect],
    mode: str = "PERMISSIVE",
    multiline: bool | None = None,
    corrupt: str | None = None,
) -> DataFrame:
    """All files as text columns: one scan per encoding, separator, header and splitting.

    ``multiline=None`` reads unsplit only the files that were seen to need it.  A column
    ``corrupt``, where asked for, holds the text of rows that do not fit the header.
    """
    groups: dict[tuple, list[str]] = defaultdict(list)
    for d in (f for d in dialects for f in d.files):
        unsplit = d.multiline if multiline is None else multiline
        groups[d.encoding, d.separator, tuple(d.columns), unsplit].append(d.path)
    frames = []
    reader = spark.read
    if mode != "PERMISSIVE" or corrupt:
        # Whether a row fits the header shows only when all of its columns are parsed.
        reader = reader.option("columnPruning", "false")
    for (encoding, separator, columns, unsplit), paths in groups.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, *([corrupt] if corrupt else []))])
        frames.append(
            reader.csv(
                paths,
                schema=schema,
                sep=separator,
                encoding=SPARK_ENCODING[encoding],
                header=True,
                quote='"',
                escape='"',
                mode=mode,
                multiLine=unsplit,
                columnNameOfCorruptRecord=corrupt,
            )
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_csv_robust(
    spark: SparkSession,
    paths: Sequence[str],
    separator: str | None = None,
    encoding: str | None = None,
    rule: str = "first",
    infer: bool = True,
    mode: str = "PERMISSIVE",
    multiline: bool | None = None,
) -> DataFrame:
    """Read CSV files, or folders of them, of unknown dialect into one table.

    Files may differ in encoding, separator and header, and cells may hold line breaks
    (``multiline`` forces or forbids them).  A file that no dialect fits
    is an error, unless it is another file's header alone.  With ``infer`` missing-value texts become null and columns take the
    narrowest type that holds all of their values.
    """
    dialects = with_records(detect_dialects(spark, list(paths), rule, whole=True))
    for d in (f for d in dialects for f in d.files):
        if separator and d.separator != separator:
            d.reason = d.reason or f"not a table under separator {separator!r}"
        if encoding and d.encoding and d.encoding != encoding:
            d.encoding = encoding if encoding in SPARK_ENCODING else "latin-1"
    bad = [f"{f.path}: {f.reason}" for d in dialects for f in d.files if f.reason]
    if bad:
        raise ValueError("; ".join(bad))
    raw = read_dialects(spark, dialects, mode, multiline)
    return infer_types(raw) if infer else raw


def read_first_usable(spark: SparkSession, paths: Sequence[str], **options) -> tuple[str, DataFrame]:
    """The first path, in order, that reads as a table."""
    for d in detect_dialects(spark, list(paths)):
        if d.reason is None:
            return d.path, read_csv_robust(spark, [d.path], **options)
    raise ValueError(f"none of the files can be read: {list(paths)}")


def missing_to_null(df: DataFrame) -> DataFrame:
    """Text columns with the missing-value tokens turned into nulls."""
    text = set(text_columns(df))
    return df.select(
        *[
            F.when(~col(c).isin(MISSING_TOKENS), col(c)).alias(c) if c in text else col(c)
            for c in df.columns
        ]
    )


def _truth(c: Column) -> Column:
    return F.when(c.isin(TRUE_TOKENS), True).when(c.isin(FALSE_TOKENS), False)


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns to ``bigint``, ``double`` or ``boolean`` when every value fits.

    One aggregate decides for all columns.  Integer columns keep their type when
    values are missing; truth columns with missing values stay text.
    """
    data = missing_to_null(df)
    exprs = {}
    for c in text_columns(data):
        v = col(c)
        whole = v.rlike(INTEGER) & v.try_cast("bigint").isNotNull()
        exprs["n" + c] = F.count(v)
        exprs["i" + c] = F.count_if(whole)
        exprs["d" + c] = F.count_if(v.rlike(NUMBER))
        exprs["b" + c] = F.count_if(_truth(v).isNotNull())
        exprs["m" + c] = F.count_if(v.isNull())
    facts = wide_aggregate(data, exprs) if exprs else {}
    out = []
    for c in data.columns:
        n = facts.get("n" + c)
        if not n:
            out.append(col(c))
        elif facts["i" + c] == n:
            out.append(F.trim(col(c)).try_cast("bigint").alias(c))
        elif facts["d" + c] == n:
            out.append(F.trim(col(c)).try_cast("double").alias(c))
        elif facts["b" + c] == n and not facts["m" + c]:
            out.append(_truth(col(c)).alias(c))
        else:
            out.append(col(c))
    return data.select(*out)


# --- choice of source by columns ------------------------------------------------


def by_name_priority(paths: Sequence[str]) -> list[str]:
    """Paths whose file name contains a priority part first, otherwise as given."""
    return sorted(
        paths, key=lambda p: not any(part in p.rsplit("/", 1)[-1] for part in PRIORITY_NAME_PARTS)
    )


def coverage_report(
    spark: SparkSession, paths: Sequence[str], required: Sequence[str]
) -> DataFrame:
    """How many of the required columns each candidate file has."""
    needed = [clean_name(r) for r in required]
    rows = []
    for d in detect_dialects(spark, list(paths), rule="max_columns"):
        found = match_names(needed, d.columns)
        missing = [r for r in needed if r not in found]
        pct = 100.0 * len(found) / len(needed) if needed else 100.0
        rows.append((d.priority, d.path, list(found), missing, pct if d.reason is None else 0.0, d.reason))
    return spark.createDataFrame(
        rows,
        "priority int, path string, found array<string>, missing array<string>, pct double, reason string",
    )


def read_by_coverage(
    spark: SparkSession,
    paths: Sequence[str],
    required: Sequence[str],
    min_pct: float = TRAINING_COVERAGE,
    **options,
) -> tuple[str, DataFrame]:
    """Read the first file with enough of the required columns, under the required names."""
    best = (
        coverage_report(spark, paths, required)
        .where(F.col("reason").isNull() & (F.col("pct") >= min_pct))
        .orderBy("priority")
        .first()
    )
    if best is None:
        raise ValueError(f"no file has {min_pct:g}% of the required columns")
    df = read_csv_robust(spark, [best["path"]], rule="max_columns", **options)
    found = match_names([clean_name(r) for r in required], df.columns)
    renamed = {old: new for new, old in found.items()}
    return best["path"], df.toDF(*unique_names(renamed.get(c, c) for c in df.columns))


def _malformed(spark: SparkSession, dialect: Dialect) -> int:
    """How many rows do not fit the header, in one reading."""
    rows = read_dialects(spark, [dialect], corrupt="__corrupt")
    # The reader wants another column beside that of the corrupt rows.
    beside = F.count(F.col(rows.columns[0])).alias("beside")
    return rows.agg(F.count_if(F.col("__corrupt").isNotNull()).alias("malformed"), beside).first()["malformed"]


def read_for_retraining(
    spark: SparkSession, paths: Sequence[str], expected: Sequence[str]
) -> tuple[str, DataFrame]:
    """Read the stored training source again; half of the columns must be there.

    When the strict reading finds no usable file, rows that do not fit the header are
    dropped, with a warning of how many, and the files are judged by their leading
    records alone.
    """
    try:
        return read_by_coverage(spark, paths, expected, RETRAINING_COVERAGE)
    except ValueError:
        for d in detect_dialects(spark, list(paths), rule="max_columns"):
            found = match_names([clean_name(e) for e in expected], d.columns)
            if d.reason is None and 100.0 * len(found) >= RETRAINING_COVERAGE * len(expected):
                kept = read_dialects(spark, [d], mode="DROPMALFORMED")
                dropped = _malformed(spark, d)
                warnings.warn(f"{d.path}: {dropped} rows that do not fit the header are dropped", stacklevel=2)
                raw = infer_types(kept)
                renamed = {old: new for new, old in found.items()}
                return d.path, raw.toDF(*unique_names(renamed.get(c, c) for c in raw.columns))
        raise


# --- looking at a table ---------------------------------------------------------


def preview(df: DataFrame, rows: int = PREVIEW_ROWS, key: Sequence[str] = ()) -> DataFrame:
    """The first rows with long text cut; ``key`` makes the choice deterministic."""
    text = set(text_columns(df))
    head = df.orderBy(*[col(k) for k in key]).limit(rows) if key else df.limit(rows)
    names = unique_names(clean_name(c) for c in df.columns)

    def cell(c: str) -> Column:
        if c not in text:
            return col(c)
        cut = F.concat(F.substring(col(c), 1, PREVIEW_WIDTH), F.lit("..."))
        return F.when(F.length(col(c)) > PREVIEW_WIDTH, cut).otherwise(col(c))

    return head.select(*[cell(c).alias(n) for c, n in zip(df.columns, names)])


def column_list(df: DataFrame) -> DataFrame:
    """Position, cleaned name and type of every column."""
    names = unique_names(clean_name(c) for c in df.columns)
    rows = [(i, n, f.dataType.simpleString()) for i, (n, f) in enumerate(zip(names, df.schema))]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string")


def check_structure(df: DataFrame) -> DataFrame:
    """One row: whether there are enough columns and any row; reads at most one row."""
    has_rows = not df.limit(MIN_ROWS).isEmpty()
    enough = len(df.columns) >= MIN_COLUMNS
    return df.sparkSession.createDataFrame(
        [(len(df.columns), has_rows, enough and has_rows)], "columns int, has_rows boolean, is_valid boolean"
    )


# --- out --------------------------------------------------------------------------


def write_csv(df: DataFrame, path: str, separator: str = ",", encoding: str = "utf-8") -> None:
    """CSV in the given dialect, one file per partition."""
    df.write.mode("errorifexists").csv(
        path,
        sep=separator,
        encoding=SPARK_ENCODING.get(encoding, "ISO-8859-1"),
        header=True,
        quote='"',
        escape='"',
    )


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def save_mining(itemsets: DataFrame, rules: DataFrame, path: str) -> None:
    """Store the two result tables of a mining run."""
    write_table(itemsets, f"{path}/itemsets")
    write_table(rules, f"{path}/rules")


def load_mining(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/itemsets"), spark.read.parquet(f"{path}/rules")


# --- new records --------------------------------------------------------------------


def records_from_json(df: DataFrame, column: str, target: str, features: Sequence[str]) -> DataFrame:
    """Rows of JSON arrays ``[{"target_value": …, "<feature>": …}]`` as text columns.

    The array is unfolded with an explicit schema; ``target_value`` takes the target's name.
    """
    fields = ["target_value", *features]
    schema = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in fields]))
    rows = df.select(F.inline(F.from_json(col(column), schema)))
    return rows.toDF(target, *features)

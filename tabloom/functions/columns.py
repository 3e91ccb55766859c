"""Small column-expression helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space that text cleaning strips at both ends.
STRIP_PATTERN = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def quoted(name: str) -> str:
    """A column name as it is written inside an SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by exact name, safe for dots, spaces and backticks."""
    return F.col(quoted(name))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def strip_text(c: Column) -> Column:
    """Strip every Unicode white-space character at both ends; null stays null."""
    return F.regexp_replace(c, STRIP_PATTERN, "")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value everywhere in this library.

    ``nanvl`` mentions the column once, so stacked calls collapse into one projection.
    """
    floats = {
        f.name: f.dataType.simpleString()
        for f in df.schema
        if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    if not floats:
        return df
    return df.selectExpr(
        *[
            f"nanvl({quoted(c)}, cast(null AS {floats[c]})) AS {quoted(c)}" if c in floats else quoted(c)
            for c in df.columns
        ]
    )


def null_count(columns: Iterable[str]) -> Column:
    """How many of ``columns`` are null in a row."""
    return F.expr(" + ".join(f"cast({quoted(c)} IS NULL AS int)" for c in columns) or "0")


def rows_from_aggregate(
    aggregate: DataFrame, names: Sequence[str], fields: Sequence[tuple[str, str]], prefix: str = "__"
) -> DataFrame:
    """Turn a one-row wide aggregate into one row per column.

    The wide row holds ``<prefix><i>_<field>`` for the i-th name.  ``fields`` gives
    the field names with the SQL type each is cast to.
    """
    structs = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column_name"),
            *[F.col(f"{prefix}{i}_{f}").cast(t).alias(f) for f, t in fields],
        )
        for i, name in enumerate(names)
    ]
    return aggregate.select(F.inline(F.array(*structs)))


def rounded(c: Column, digits: int) -> Column:
    return F.round(c.cast("double"), digits)

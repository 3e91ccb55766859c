"""Column names: cleaning, de-duplication, fuzzy matching, selection checks.

These work on the schema only. Nothing here touches rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

# Characters that may not begin or end a column name.
EDGE_CHARACTERS = "\\s\u00a0\u2000-\u200b\u2028\u2029"

_INNER_SPACE = re.compile(r"\s+")
_EDGES = re.compile(f"\\A[{EDGE_CHARACTERS}]+|[{EDGE_CHARACTERS}]+\\Z")


def clean_name(name: object) -> str:
    """Collapse inner white space, then drop visible and invisible edge space."""
    return _EDGES.sub("", _INNER_SPACE.sub(" ", str(name)))


def unique_names(names: Iterable[str]) -> list[str]:
    """Suffix repeated names with ``_1``, ``_2``, ... in order of appearance."""
    used: Counter[str] = Counter()
    out = []
    for name in names:
        out.append(f"{name}_{used[name]}" if used[name] else name)
        used[name] += 1
    return out


def tidy_columns(df: DataFrame) -> DataFrame:
    """Clean and de-duplicate every column name of ``df``."""
    names = unique_names(clean_name(c) for c in df.columns)
    return df if names == df.columns else df.toDF(*names)


def match_names(required: Sequence[str], available: Sequence[str]) -> dict[str, str]:
    """Map each required name to an available one.

    Equality after cleaning and lower-casing wins; otherwise the first available
    name whose words include every required word is taken.  Unmatched names are
    left out of the result.
    """
    folded = {clean_name(a).lower(): a for a in available}
    words = [(set(key.split()), name) for key, name in folded.items()]
    found: dict[str, str] = {}
    for name in required:
        key = clean_name(name).lower()
        hit = folded.get(key)
        if hit is None:
            needed = set(key.split())
            hit = next((a for have, a in words if needed <= have), None)
        if hit is not None:
            found[name] = hit
    return found


@dataclass(frozen=True)
class Task:
    """Which column is predicted, from which ones, and how."""

    target: str
    predictors: tuple[str, ...]
    kind: str = "classification"

    @property
    def columns(self) -> list[str]:
        return [self.target, *self.predictors]


def select_task(
    df: DataFrame, target: str | None, predictors: Sequence[str], kind: str = "classification"
) -> Task:
    """Validate a target/predictor choice against the schema of ``df``.

    Predictors that do not exist are left out; a missing target, no usable
    predictor, or a target among the predictors is an error.
    """
    if not target:
        raise ValueError("choose a target column")
    target = clean_name(target)
    wanted = [clean_name(p) for p in predictors]
    if not wanted:
        raise ValueError("choose at least one predictor column")
    if target in wanted:
        raise ValueError(f"target {target!r} is also listed as a predictor")
    if target not in df.columns:
        raise ValueError(f"target {target!r} is not a column of the table")
    present = tuple(p for p in wanted if p in df.columns)
    if not present:
        raise ValueError("none of the chosen predictors is a column of the table")
    if kind not in ("classification", "regression"):
        raise ValueError(f"unknown task kind {kind!r}")
    return Task(target, present, kind)

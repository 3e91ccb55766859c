"""Operators that pass rows through see the input's columns under names by place."""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_place(docs: DataFrame, *names: str | None) -> tuple[DataFrame, list[str | None]]:
    """``docs`` with its columns named ``c0, c1, ...``, and what ``names`` are called there.

    No column of the input, whatever it is called, then meets a helper column of an
    operator; ``toDF(*docs.columns)`` gives the names back.  A name that ``docs`` does
    not have stays as it is.
    """
    held = [c.lower() for c in docs.columns]
    new = [f"c{i}" for i in range(len(held))]
    found = dict(zip(held, new))
    return docs.toDF(*new), [n and found.get(n.lower(), n) for n in names]

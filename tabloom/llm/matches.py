"""Positions of all matches of a pattern, with SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Matches whose positions are summed together.
_BLOCK = 256


def literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _placed(found: str, gaps: str) -> str:
    """SQL array of ``(start, end, found)`` from the matches and the texts between them.

    Positions are summed in blocks, so that many matches in a text stay cheap.
    """
    pieces = f"zip_with(slice({gaps}, 1, size({found})), {found}, (g, m) -> struct(length(g) as gap, length(m) as len, m as found))"
    blocks = f"transform(sequence(1, size({found}), {_BLOCK}), s -> slice({pieces}, s, {_BLOCK}))"
    # One pass over the blocks of (gap, len, found), each turned into spans from zero.
    empty = "cast(array() as array<struct<start:int,end:int,found:string>>)"
    inner = (
        f"aggregate(b, struct(0 as at, {empty} as spans), (a, p) -> struct(a.at + p.gap + p.len as at,"
        " concat(a.spans, array(struct(a.at + p.gap as start, a.at + p.gap + p.len as end, p.found as found))) as spans))"
    )
    outer = (
        f"aggregate(transform({blocks}, b -> {inner}), struct(0 as at, cast(array() as array<array<struct<start:int,end:int,found:string>>>) as spans),"
        " (a, b) -> struct(a.at + b.at as at, concat(a.spans, array(transform(b.spans, s -> struct(s.start + a.at as start, s.end + a.at as end, s.found as found)))) as spans),"
        " a -> flatten(a.spans))"
    )
    return f"if(size({found}) > 0, {outer}, {empty})"


def in_blocks(text: str, size: int) -> str:
    """SQL array of a text's code points in blocks of ``size``, made in one walk over the text."""
    return f"regexp_extract_all({text}, {literal(f'(?s).{{1,{size}}}+')}, 0)"


def piece(blocks: str, start: str, n: str, size: int) -> str:
    """SQL of ``n`` code points after the first ``start`` of a text in blocks."""
    of = f"slice({blocks}, int(({start}) div {size}) + 1, int((({start}) % {size} + greatest({n}, 0)) div {size}) + 1)"
    return f"substr(array_join({of}, ''), int(({start}) % {size}) + 1, greatest({n}, 0))"


def running(items: str, zero: str, kind: str, step: str, end: str) -> str:
    """SQL of a walk over an array that carries ``a.at`` and appends to the array ``a.out``.

    ``step`` gives the next ``struct(at, out)`` for the item ``s``; ``end`` turns ``a`` into the
    outcome.  Appending copies an array, so items are taken in blocks that each append to
    their own.
    """
    blocks = f"transform(sequence(1, greatest(size({items}), 1), {_BLOCK}), i -> slice({items}, i, {_BLOCK}))"
    block = f"aggregate(b, struct(o.at as at, cast(array() as {kind}) as out), (a, s) -> {step})"
    joined = f"element_at(transform(array({block}), x -> struct(x.at as at, concat(o.out, array(x.out)) as out)), 1)"
    whole = f"aggregate({blocks}, struct({zero} as at, cast(array() as array<{kind}>) as out), (o, b) -> {joined})"
    return f"element_at(transform(transform(array({whole}), o -> struct(o.at as at, flatten(o.out) as out)), a -> {end}), 1)"


def matches(df: DataFrame, text: str, name: str, pattern: str, needs: str | None) -> DataFrame:
    """``df`` with the placed matches of a pattern in column ``name``."""
    look = f"regexp_extract_all({text}, {literal(pattern)}, 0)"
    if needs:
        look = f"if(contains({text}, '{needs}'), {look}, cast(array() as array<string>))"
    df = df.withColumn("__found", F.expr(look))
    df = df.withColumn(
        "__gaps",
        F.expr(f"if(size(__found) > 0, split({text}, {literal(pattern)}, -1), cast(array() as array<string>))"),
    )
    return df.withColumn(name, F.expr(_placed("__found", "__gaps"))).drop("__found", "__gaps")

"""Compare a Spark result with the rows DuckDB gives for the equivalent SQL."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def duck_kind(name: str) -> str:
    name = str(name).upper()
    if name in ("TINYINT", "SMALLINT", "INTEGER", "BIGINT"):
        return "int"
    if name in ("DOUBLE", "FLOAT"):
        return "float"
    return {"VARCHAR": "text", "BOOLEAN": "bool"}.get(name, name)


def spark_kind(name: str) -> str:
    if name in ("tinyint", "smallint", "int", "bigint"):
        return "int"
    if name in ("double", "float"):
        return "float"
    return {"string": "text", "boolean": "bool"}.get(name, name)


def sort_key(row):
    return [(v is None, str(v)) for v in row]


def compare(df, con, sql: str) -> None:
    result = con.execute(sql)
    duck_types = {d[0]: duck_kind(d[1]) for d in result.description}
    rows = result.fetchall()
    names = [d[0] for d in result.description]
    spark_types = {n: spark_kind(t) for n, t in df.dtypes}
    assert spark_types == duck_types
    order = sorted(names)
    expected = sorted((tuple(r[names.index(c)] for c in order) for r in rows), key=sort_key)
    actual = sorted((tuple(r[c] for c in order) for r in df.collect()), key=sort_key)
    assert len(actual) == len(expected), f"{len(actual)} rows, expected {len(expected)}"
    bad = [(a, e) for a, e in zip(actual, expected) if a != e]
    assert not bad, f"{len(bad)} rows differ in {order}, first: {bad[:3]}"

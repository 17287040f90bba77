"""Compare a registered query with its oracle, the way the driver does."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _rows(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=key)


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql: str):
    table = con.execute(sql).to_arrow_table()
    return _rows(table.column_names, list(zip(*[c.to_pylist() for c in table.columns])))


def difference(mine, theirs) -> str | None:
    """First difference of two results, or None."""
    (columns, rows), (other_columns, other_rows) = mine, theirs
    if columns != other_columns:
        return f"columns {columns} != {other_columns}"
    if len(rows) != len(other_rows):
        return f"{len(rows)} rows != {len(other_rows)}"
    for a, b in zip(rows, other_rows):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{dict(zip(columns, a))} != {dict(zip(columns, b))}"
    return None

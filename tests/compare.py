"""A query and its SQL on the same tables."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value) -> str:
    if value is None or value != value:
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows_of(columns: list[str], names: list[str], rows) -> list[tuple]:
    at = [names.index(c) for c in columns]
    return sorted(tuple(_cell(r[i]) for i in at) for r in rows)


def same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert rows_of(columns, df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, names, cursor.fetchall())

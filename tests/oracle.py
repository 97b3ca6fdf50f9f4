"""Runs a query's SQL in DuckDB over the same tables, and compares results without regard to order."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str, **views):
    con = duckdb.connect()
    for t in TABLES:
        if t not in views and os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    for name, arrow in views.items():
        con.register(name, arrow)
    return con


def rows(table) -> list[str]:
    table = table.select(sorted(table.column_names))
    return sorted(map(repr, zip(*(c.to_pylist() for c in table.columns), strict=True)))


def assert_same(df, con, sql: str) -> None:
    own = df.toArrow()
    other = con.sql(sql).to_arrow_table()
    assert sorted(own.column_names) == sorted(other.column_names)
    kinds = {c: (str(own.schema.field(c).type), str(other.schema.field(c).type)) for c in own.column_names}
    assert all(a.replace("large_", "") == b.replace("large_", "") for a, b in kinds.values()), kinds
    assert rows(own) == rows(other)

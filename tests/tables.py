"""Comparison of results with DuckDB."""

import os


def duck(path: str):
    """A DuckDB connection with the tables of ``path`` as views."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(path):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}/{name}'")
    return con


def same_rows(got, want) -> None:
    """Equal column names and equal rows in any order."""
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    plain = lambda f: sorted(map(repr, f[names].astype(object).where(f[names].notna(), None).itertuples(index=False, name=None)))
    a, b = plain(got), plain(want)
    assert a == b, [x for x in a if x not in set(b)][:3]

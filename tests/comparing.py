"""Spark results against DuckDB's."""

from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def views(root=DATA):
    c = duckdb.connect()
    for f in sorted(root.glob("*.parquet")):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def rows(columns, found):
    """Sorted rows with columns in the order of their names."""
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in found), key=repr)


def same(df, cursor):
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())

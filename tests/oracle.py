"""Comparing a query with its DuckDB twin on the same Parquet tables."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, data_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(data_dir) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path / '*.parquet' if path.is_dir() else path}')")
    return con.execute(sql).df()


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(x.tolist() if hasattr(x, "tolist") else x for x in r)) for r in df.itertuples(index=False, name=None))


def assert_same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

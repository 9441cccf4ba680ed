"""Order-free comparison of a query with its DuckDB twin."""

from __future__ import annotations

import glob

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("~" if r[i] is None or r[i] != r[i] else repr(r[i]) for i in order) for r in found)


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def assert_twins(spark, sf_dir, f, sql):
    df = f(spark, sf_dir)
    rel = duck(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())

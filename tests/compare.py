"""Spark rows against DuckDB rows: names, counts and values, whatever the order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def same(df, con, sql):
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(found.columns, found.fetchall())

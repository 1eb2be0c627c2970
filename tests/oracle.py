"""DuckDB over the given tables, and rows in a form that can be compared."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for t in TABLES.split():
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str([plain(r[i]) for i in order]) for r in rows)


def same(db, sql, df):
    found = db.execute(sql)
    want = canonical([d[0] for d in found.description], found.fetchall())
    got = canonical(df.columns, df.collect())
    assert got[0] == want[0]
    assert got[1] == want[1]

"""Compares a query's rows with its SQL in DuckDB: columns by name, rows in any order, floats to nine digits."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: None if v is None else f"{v:.9g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)
    return [columns[i] for i in at], sorted(tuple(str(show(r[i])) for i in at) for r in data)


def compare(df, sql, sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    r = c.execute(sql)
    want = rows([d[0] for d in r.description], r.fetchall())
    got = rows(df.columns, [tuple(x) for x in df.collect()])
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not bad, (len(bad), bad[:3])
    return len(got[1])

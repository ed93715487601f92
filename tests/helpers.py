"""Comparing a query with its SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if hasattr(x, "asDict"):
        x = x.asDict(recursive=True)
    if isinstance(x, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return x


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr), cols


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    cols = rel.columns
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rel.fetchall()), key=repr), sorted(cols)


def norm(rows):
    return sorted((tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in rows), key=repr)


def assert_same(df, sql, sf_dir):
    (a, ca), (b, cb) = rows_of(df), sql_rows(sql, sf_dir)
    assert ca == cb
    assert norm(a) == norm(b)

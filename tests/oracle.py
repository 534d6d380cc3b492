"""Comparison of a query's rows with DuckDB's over the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, (str, bytes, bool, int)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(f"{float(v):.10g}") if hasattr(v, "as_tuple") else v


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows_of(records, columns):
    return sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in records), key=repr)


def both(df, con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = [dict(zip(columns, r)) for r in cursor.fetchall()]
    assert sorted(df.columns) == sorted(columns)
    return rows_of([r.asDict(recursive=True) for r in df.collect()], columns), rows_of(theirs, columns)

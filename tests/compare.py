"""Rows of a Spark query and of its SQL in DuckDB, made comparable."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5g}"
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if hasattr(v, "quantize"):
        return f"{float(v):.5g}"
    return None if v is None else str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(str([plain(r[c]) for c in names]) for r in df.collect())


def sql_rows(sql, folder=SF):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = db.execute(sql)
    found = [d[0] for d in got.description]
    names = sorted(found)
    return names, sorted(str([plain(dict(zip(found, r))[c]) for c in names]) for r in got.fetchall())

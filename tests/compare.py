"""Queries against their SQL in DuckDB, on the smallest test tables where they are at hand."""

import math
import os
from collections import Counter
from datetime import datetime

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
HERE = os.path.isdir(FOLDER)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return v.isoformat() if isinstance(v, datetime) else str(v)


def same(spark, query, sql):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(FOLDER):
        db.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    df, want = query(spark, FOLDER), db.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())

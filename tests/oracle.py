"""Runs registered queries and their SQL on the same tables; used by the oracle tests."""

import math
import os

import pytest

DATA = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, query, sql):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got = con.execute(sql)
    want = rows_of([c[0] for c in got.description], got.fetchall())
    df = query(spark, DATA)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")

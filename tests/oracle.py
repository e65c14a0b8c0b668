"""Comparison of a query with its SQL, the order of rows and columns aside."""

import glob
import os

import duckdb


def _plain(x):
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    if hasattr(x, "isoformat"):
        return x.replace(tzinfo=None).isoformat()
    return x


def _rows(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def agree(df, sql, sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    assert got == _rows(want.fetchall(), want.columns)
    return len(got)

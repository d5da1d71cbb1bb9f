"""Compare a query with its oracle, as sorted rows with columns by name."""

import os
from decimal import Decimal

import duckdb

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(v):
    if isinstance(v, Decimal):
        v = int(v) if v == int(v) else float(v)
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    return None if v is None else str(v)


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=str)


def check(spark, name, sf):
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in TABLES:
        p = f"{path}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"create view {t} as select * from read_parquet('{p}')")
    df = entry.queries()[name](spark, path)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(rel.fetchall(), rel.columns)

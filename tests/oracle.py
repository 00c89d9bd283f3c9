"""Runs a query and its SQL and compares rows, order aside."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def connection(path: str = DATA):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{path}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"create view {t} as select * from read_parquet('{p}')")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, bool) or isinstance(value, str):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return round(float(value), 6) + 0.0
    return str(value)


def compare(df, sql: str, path: str = DATA) -> None:
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    con = connection(path)
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in order) for r in out.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))

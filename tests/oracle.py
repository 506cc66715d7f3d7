"""A query's rows against those of its SQL on the same tables."""

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np

DATA = "/root/testdata/sf0.001"


def canon(v):
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(canon(x) for x in v)
    if isinstance(v, decimal.Decimal | np.floating | float):
        return "nan" if v != v else round(float(v), 5)
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, int | np.integer):
        return float(v)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def connect(folder=DATA):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def compare(spark, query, sql, folder=DATA):
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(canon(r[c]) for c in cols)) for r in df.collect())
    rel = connect(folder).execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = Counter(repr(tuple(canon(r[names.index(c)]) for c in cols)) for r in rel.fetchall())
    assert got == want, (list((got - want))[:3], list((want - got))[:3])

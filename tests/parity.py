"""Order-insensitive comparison of a query with its SQL in DuckDB."""

import datetime
import decimal
import math
import os
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, decimal.Decimal)):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def connection(folder):
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        db.execute(f"create view {f.stem} as select * from '{f}'")
    return db


def assert_same(df, db, sql):
    rows, columns = df.collect(), sorted(df.columns)
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    assert columns == sorted(names)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert mine == theirs


SKIP = os.environ.get("SKIP_PARITY") == "1"

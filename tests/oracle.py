"""Compares a query's rows with its SQL counterpart in DuckDB."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9))
    if isinstance(x, (decimal.Decimal, bool, int)):
        return str(x)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return repr(x)


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty if names, types by kind and rows agree, else what differs."""
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    ours = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"

    def rows(data, columns):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(tuple(_plain(r[i]) for i in order) for r in data)

    a, b = rows(ours, df.columns), rows(theirs, names)
    if a != b:
        odd = next(((x, y) for x, y in zip(a, b, strict=False) if x != y), None)
        return f"{len(a)} rows against {len(b)}; first difference {odd}"
    return ""

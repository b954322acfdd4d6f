"""Runs a registered query and its SQL over the same tables and compares the rows."""

import datetime
import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, con, sf_dir, query, sql):
    """Problems between a query and its SQL; none if they agree."""
    got = query(spark, sf_dir)
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    if sorted(names) != sorted(got.columns):
        return [f"columns {sorted(got.columns)} and {sorted(names)}"]
    a, b = rows_of(got.columns, got.collect()), rows_of(names, want.fetchall())
    if not a and not b:
        return ["no rows"]
    if a != b:
        x, y = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
        return [f"{len(a)} and {len(b)} rows; only Spark {str(x)[:400]}; only SQL {str(y)[:400]}"]
    return []

"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() and v.as_tuple().exponent == 0 else float(v)
    if isinstance(v, float):
        return 0.0 if v == 0 else ("nan" if math.isnan(v) else v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def kind(v):
    if isinstance(v, bool):
        return "bool"
    return type(v).__name__


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, kind(x), str(x)) for x in r))


def diff(df, con, sql):
    """None when equal, otherwise a short description."""
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want = canonical(want_cols, rel.fetchall())
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w or [kind(x) for x in g] != [kind(x) for x in w]]
    return f"{len(bad)} of {len(want[1])} rows differ, first {bad[0]}" if bad else None

"""Compare each registered query with its SQL in DuckDB: names, row count, values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from tidemark.plans import CATALOG, Tables
from tidemark.plans.tables import BASE_TABLES


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return None if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 2**53 else round(v, 6))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
         "timestamp_ntz": "TIMESTAMP", "date": "DATE", "binary": "BLOB"}


def compare(spark, con, name: str, sf_dir: str) -> str:
    """An empty string when equal, else what differs."""
    q = CATALOG[name]
    df = q.build(Tables(spark, sf_dir))
    got = df.collect()
    if not q.oracle:
        return "" if got else "no rows"
    rel = con.execute(q.oracle)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    off = {f: (t, types[f]) for f, t in df.dtypes if TYPES.get(t) != types[f]}
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}; {off}"
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(names)}: {x} against {y}; {off}"
    return f"types {off}" if off else ("" if a else "no rows")


def main(argv):
    from tidemark.session import local_session

    sf = argv[0]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = oracle_connection(sf_dir)
    names = [n for n in CATALOG if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    bad = 0
    for n in names:
        t = time.time()
        try:
            msg = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and go on with the next query
            msg = f"{type(e).__name__}: {str(e)[:400]}"
        bad += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {n} {time.time() - t:.2f}s {msg}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")


if __name__ == "__main__":
    main(sys.argv[1:])

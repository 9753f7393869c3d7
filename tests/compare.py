"""Run catalog queries next to their oracle statements.

    python tests/compare.py <sf> [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) > 1e12 else f"{round(v, 6) + 0.0:.6f}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, decimal.Decimal)):
        return f"{float(v):.6f}" if isinstance(v, decimal.Decimal) else f"i{v}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return sorted((str(k), _plain(x)) for k, x in v.items()).__repr__()
    if hasattr(v, "asDict"):
        return _plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v].__repr__()
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, folder):
    """None when the rows agree, else a description."""
    df = query(spark, folder)
    got = df.collect()
    if sql is None:
        return None, len(got)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}", len(got)
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        sa, sb = [r for r in a if r not in set(b)], [r for r in b if r not in set(a)]
        return f"rows {len(a)} vs {len(b)}; cols {sorted(cols)}; spark only {sa[:3]}; oracle only {sb[:3]}", len(got)
    return None, len(got)


def main():
    from __spark_entry__ import oracle_sql, queries

    from panelcheck.session import local_session

    folder = f"/root/testdata/sf{sys.argv[1]}"
    prefixes = sys.argv[2:]
    spark = local_session(8)
    con = connect(folder)
    oracles = oracle_sql()
    bad = 0
    for name, q in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            problem, n = compare(spark, con, name, q, oracles.get(name), folder)
        except Exception as e:  # report and go on
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        bad += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'BAD ' if problem else 'ok  '} {name:40s} {kind:4s} rows={n} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()

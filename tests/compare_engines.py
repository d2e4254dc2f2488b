"""Run registered queries in Spark and their SQL in DuckDB and compare the values.

    python tests/compare_engines.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def run_sql(con, sql):
    cur = con.execute(sql)
    return canonical([d[0] for d in cur.description], cur.fetchall())


def run_spark(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def difference(a, b):
    (ca, ra), (cb, rb) = a, b
    if ca != cb:
        return f"columns {ca} vs {cb}"
    if len(ra) != len(rb):
        return f"{len(ra)} rows vs {len(rb)}; first {ra[:2]} vs {rb[:2]}"
    for x, y in zip(ra, rb):
        if x != y or [type(i) for i in x] != [type(i) for i in y]:
            return f"{dict(zip(ca, x))} vs {dict(zip(cb, y))}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from siftmill.session import local_session

    sf = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    spark, con, bad = local_session(), connect(sf), []
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t0 = time.time()
        try:
            got = run_spark(fn(spark, sf))
            sec = time.time() - t0
            if name not in oracles:
                print(f"rows  {name} {len(got[1])} rows {sec:.1f}s {got[1][:2] if names else ''}", flush=True)
                continue
            diff = difference(got, run_sql(con, oracles[name]))
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            diff, sec = f"{type(e).__name__}: {str(e)[:600]}", time.time() - t0
        print(f"{'ok   ' if diff is None else 'FAIL '} {name} {sec:.1f}s {len(got[1]) if diff is None else diff}", flush=True)
        if diff:
            bad.append(name)
    print(f"{len(bad)} different: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

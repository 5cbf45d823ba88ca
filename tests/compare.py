"""Run registered queries against their SQL counterparts.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(value):
    return round(value, 9) if isinstance(value, float) else value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(normal(r[c]) for c in names)) for r in df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(names)
    at = [names.index(n) for n in order]
    return order, sorted(repr(tuple(normal(r[i]) for i in at)) for r in cur.fetchall())


def compare(spark, con, sf_dir, query, sql):
    names, got = spark_rows(query(spark, sf_dir))
    if sql is None:
        return None, f"no oracle, {len(got)} rows"
    want_names, want = duck_rows(con, sql)
    if names != want_names:
        return False, f"columns {names} vs {want_names}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return False, f"rows {len(got)} vs {len(want)}; only spark {sorted(a)[:3]}; only sql {sorted(b)[:3]}"
    return True, f"{len(got)} rows"


if __name__ == "__main__":
    from codestrata.plans import registry
    from codestrata.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck_connection(sf)
    queries, oracles = registry.queries(), registry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        t = time.time()
        try:
            ok, note = compare(spark, con, sf, query, oracles.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += ok is False
        print(f"{'none' if ok is None else 'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {note}", flush=True)
    print("failed:", bad)

"""Run queries next to their check SQL and report differences."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _norm(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def _close(a, b) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return a == b
    return a == b


def _key(row):
    return tuple((v is None, str(type(v).__name__ if not isinstance(v, (int, float)) else ""), v if v is not None else 0) for v in row)


def compare(got_cols, got, want_cols, want) -> str | None:
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    names = sorted(got_cols)
    gi, wi = [got_cols.index(n) for n in names], [want_cols.index(n) for n in names]
    g = [tuple(_norm(r[i]) for i in gi) for r in got]
    w = [tuple(_norm(r[i]) for i in wi) for r in want]
    if len(g) != len(w):
        return f"rows {len(g)} != {len(w)}"
    g.sort(key=lambda r: str(_key(r)))
    w.sort(key=lambda r: str(_key(r)))
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    if bad:
        gs, ws = set(map(str, g)), set(map(str, w))
        only_g = [r for r in g if str(r) not in ws]
        only_w = [r for r in w if str(r) not in gs]
        return f"{len(only_g)} of {len(g)} rows differ {names}: {only_g[:2]} vs {only_w[:2]}"
    return None


def run(spark, con, name, query, sql, sf_dir):
    t = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return took, len(got), None
    res = con.execute(sql)
    want = res.fetchall()
    return took, len(got), compare(df.columns, got, [d[0] for d in res.description], want)


def main():
    import __spark_entry__ as entry
    from tapescope.session import build_session
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", shuffle_partitions=8, extra={
        "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.log.level": "ERROR"})
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[1:] or list(queries)
    names = [n for pat in names for n in queries if n == pat or (pat.endswith("*") and n.startswith(pat[:-1]))]
    bad = 0
    for name in names:
        try:
            took, n, err = run(spark, con, name, queries[name], oracles.get(name), sf)
        except Exception as ex:  # noqa: BLE001
            took, n, err = 0.0, -1, f"{type(ex).__name__}: {str(ex)[:600]}"
        bad += err is not None
        print(f"{'FAIL' if err else 'ok  '} {name:32s} {n:7d} rows {took:6.2f}s {'' if name in oracles else '(no sql)'} {err or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()

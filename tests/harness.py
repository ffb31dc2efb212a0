"""Spark-vs-DuckDB comparison, the same way the driver checks queries.

Columns are sorted by name, rows sorted, values compared exactly (floats
after ``repr``). Usable as a script: ``python tests/harness.py [sf_dir] [name...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, repr(v))
    if hasattr(v, "item"):
        return _norm(v.item())
    return (1, repr(v))


def canon(cols: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out)


def compare(spark, con, name: str, sf_dir: str) -> dict:
    import __spark_entry__ as entry
    fn = entry.queries()[name]
    sql = entry.oracle_sql().get(name)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "no-oracle"
        return res
    d = con.execute(sql)
    dcols = [c[0] for c in d.description]
    drows = d.fetchall()
    res["oracle_rows"] = len(drows)
    sc, sr = canon(list(sdf.columns), srows)
    dc, dr = canon(dcols, drows)
    if sc != dc:
        res["status"] = f"schema {sc} vs {dc}"
    elif sr != dr:
        diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
        res["status"] = f"values differ, e.g. {diff}" if diff else "row count differs"
    else:
        res["status"] = "ok"
    return res


def main(argv):
    from tessera.session import get_spark
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as entry
    names = argv[2:] or list(entry.queries())
    spark = get_spark(shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and go on
            r = {"name": n, "status": f"error {type(e).__name__}: {str(e)[:300]}"}
        bad += r["status"] not in ("ok", "no-oracle")
        print(r, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)

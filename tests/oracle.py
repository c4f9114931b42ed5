"""Compare registered queries with their SQL on DuckDB. Usage: oracle.py [sf dir] [name ...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name, query):
    df = query.run(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if query.sql is None:
        return f"rows-only {len(rows)}", True
    cur = con.execute(query.sql)
    names = [d[0] for d in cur.description]
    want = normal(names, cur.fetchall())
    got = normal(df.columns, rows)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}", False
    if len(got) != len(want):
        extra = sorted(set(map(repr, got)) - set(map(repr, want)))[:3]
        lack = sorted(set(map(repr, want)) - set(map(repr, got)))[:3]
        return f"{len(got)} rows != {len(want)}: {extra} {lack}", False
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    types = {type(a).__name__ + "/" + type(b).__name__ for g, w in zip(got, want) for a, b in zip(g, w) if type(a) is not type(b)}
    if bad:
        return f"{len(bad)} of {len(got)} differ, e.g. {bad[:2]} {types}", False
    return f"{len(got)} rows {types or ''}", True


def main():
    from pyspark.sql import SparkSession

    from reelgrid.registry import CATALOGUE
    from reelgrid.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(CATALOGUE)
    spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").getOrCreate() if os.environ.get(
        "PLAIN"
    ) else build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("CHUNK_ROWS"):
        # Every group above this many rows is split, so all chunked paths run.
        spark.conf.set("reelgrid.chunk.rows", os.environ["CHUNK_ROWS"])
    con = connect(folder)
    failed = []
    for name in names:
        t = time.time()
        try:
            message, ok = compare(spark, con, folder, name, CATALOGUE[name])
        except Exception as e:  # noqa: BLE001  (report and go on)
            message, ok = f"{type(e).__name__}: {str(e)[:700]}", False
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {message}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()

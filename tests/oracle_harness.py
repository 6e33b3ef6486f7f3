"""Run registered Spark queries and their DuckDB oracles side by side.

Comparison is order-insensitive and exact: columns sorted by name, every
value rendered to text (floats with ``repr``), rows sorted.

    python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(v)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = sorted(tuple(_cell(r[i]) for i in order) for r in rows)
    return cols, out


def spark_rows(df):
    cols = df.columns
    return cols, [tuple(r) for r in df.collect()]


_DUCK_TYPE = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
              "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN",
              "TimestampNTZType()": "TIMESTAMP", "DateType()": "DATE"}


def type_diff(df, rel):
    """Columns whose Spark type does not correspond to the DuckDB type."""
    s = {f.name: _DUCK_TYPE.get(repr(f.dataType), repr(f.dataType)) for f in df.schema.fields}
    d = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    return {c: (s.get(c), d.get(c)) for c in set(s) | set(d) if s.get(c) != d.get(c)}


def compare(spark, name: str, sf_dir: str, con=None):
    import __spark_entry__ as E
    q = E.queries()[name]
    sql = E.oracle_sql().get(name)
    t0 = time.time()
    df = q(spark, sf_dir)
    s_cols, s_rows = spark_rows(df)
    t1 = time.time()
    result = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        result["status"] = "no-oracle"
        return result
    con = con or duck(sf_dir)
    rel = con.sql(sql)
    d_cols, d_rows = rel.columns, rel.fetchall()
    result["oracle_rows"] = len(d_rows)
    sc, sr = normalise(s_cols, s_rows)
    dc, dr = normalise(d_cols, d_rows)
    types = type_diff(df, rel)
    if sc != dc:
        result["status"] = f"columns differ: spark={sc} oracle={dc}"
    elif types:
        result["status"] = f"types differ: {types}"
    elif sr != dr:
        bad = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
        result["status"] = f"values differ (rows {len(sr)} vs {len(dr)}): {bad}"
    else:
        result["status"] = "ok"
    return result


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from tickvault.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as E
    names = names or list(E.queries())
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and go on
            r = {"name": n, "status": f"error: {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("ok", "no-oracle"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)

"""Compare registered queries with their SQL on DuckDB: python tests/oracle_check.py SF [name ...]"""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def spark_session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridloom-check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """Message when the results differ, else None."""
    rel = con.sql(sql)
    s_names, d_names = df.columns, rel.columns
    if sorted(s_names) != sorted(d_names):
        return f"columns {sorted(s_names)} != {sorted(d_names)}", 0
    s_rows = rows_of(s_names, df.collect())
    d_rows = rows_of(d_names, rel.fetchall())
    if len(s_rows) != len(d_rows):
        only = [r for r in s_rows if r not in set(map(tuple, d_rows))][:2] if len(s_rows) < 3000 else []
        return f"rows {len(s_rows)} != {len(d_rows)} only-spark {only}", len(s_rows)
    for a, b in zip(s_rows, d_rows):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"spark {a} != duck {b}", len(s_rows)
    return None, len(s_rows)


def main():
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    pick = sys.argv[2:]
    spark, con = spark_session(), duck(sf_dir)
    oracles, bad, slow = entry.oracle_sql(), 0, []
    from workloads.registry import QUERIES

    for name, fn in entry.queries().items():
        module = QUERIES.get(name, fn).__module__.rsplit(".", 1)[-1]
        if pick and not any(p in (name, module) or (p.endswith("*") and name.startswith(p[:-1])) for p in pick):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                msg, n = compare(df, con, oracles[name])
            else:
                msg, n = None, len(df.collect())
        except Exception as e:  # noqa: BLE001 - report and go on
            msg, n = f"{type(e).__name__}: {str(e)[:700]}", 0
            if "-v" in os.environ.get("CHECK", ""):
                traceback.print_exc()
        dt = time.time() - t
        slow.append((dt, name))
        if msg or n == 0:
            bad += 1
            print(f"BAD {name} ({dt:.1f}s, {n} rows): {msg}", flush=True)
        elif pick:
            print(f"ok  {name} ({dt:.1f}s, {n} rows{'' if name in oracles else ', no SQL'})", flush=True)
    print(f"{len(slow)} run, {bad} bad, total {sum(t for t, _ in slow):.0f}s; slowest {sorted(slow)[-8:]}")
    return 1 if bad else 0


if __name__ == "__main__":
    code = main()
    sys.stdout.flush()
    sys.exit(code)

"""Run registered queries against their SQL in DuckDB: ``python -m tests.run_checks [sf_dir] [name ...]``."""

import sys
import tempfile
import time
from decimal import Decimal

import duckdb

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def normal(value):
    if isinstance(value, Decimal):
        return float(value)
    return value


def compare(spark, con, folder, name, query, sql):
    start = time.time()
    got = query(spark, folder)
    columns = sorted(got.columns)
    mine = sorted((tuple(normal(r[c]) for c in columns) for r in got.collect()), key=repr)
    took = time.time() - start
    if sql is None:
        return took, len(mine), "rows only", [(f.name, f.dataType.simpleString()) for f in got.schema]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return took, len(mine), f"COLUMNS {columns} vs {sorted(names)}", []
    at = [names.index(c) for c in columns]
    kinds = {d[0]: str(d[1]) for d in result.description}
    odd = [
        (f.name, f.dataType.simpleString(), kinds[f.name])
        for f in got.schema
        if TYPES.get(f.dataType.simpleString()) != kinds[f.name]
    ]
    if odd:
        print("    types", name, odd)
    theirs = sorted((tuple(normal(r[i]) for i in at) for r in result.fetchall()), key=repr)
    if mine == theirs:
        return took, len(mine), "ok", []
    only = [r for r in mine if r not in set(theirs)][:2], [r for r in theirs if r not in set(mine)][:2]
    return took, len(mine), f"DIFFERS ({len(mine)} vs {len(theirs)})", only


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def main():
    from pyspark.sql import SparkSession

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checks-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            took, n, verdict, detail = compare(spark, con, folder, name, query, sqls.get(name))
        except Exception as error:  # noqa: BLE001
            took, n, verdict, detail = 0, 0, "FAILED", str(error)[:1500]
        bad += verdict not in ("ok", "rows only")
        print(f"{name:36s} {took:6.2f}s {n:8d} {verdict}", flush=True)
        if detail and verdict != "rows only":
            print("   ", str(detail)[:1500])
    print("bad:", bad)


if __name__ == "__main__":
    main()

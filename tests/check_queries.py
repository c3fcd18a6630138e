"""Compare the registered queries with their SQL in DuckDB: ``python tests/check_queries.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as registry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def spark_types(df) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> tuple[bool, str]:
    started = time.time()
    df = registry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - started
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return True, f"rows only {len(got)} {took:.1f}s"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    want = rows_of(columns, result.fetchall())
    duck = {d[0]: str(d[1]) for d in result.description}
    odd = {c: (t, duck[c]) for c, t in spark_types(df).items() if DUCK_TYPES.get(t) != duck[c]}
    if got != want:
        missing = [r for r in want if r not in set(got)][:3]
        extra = [r for r in got if r not in set(want)][:3]
        return False, f"rows {len(got)} != {len(want)} missing {missing} extra {extra}"
    return True, f"{len(got)} rows {took:.1f}s" + (f" types {odd}" if odd else "")


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    duck_con = connect(sf)
    failures = 0
    for query in sys.argv[2:] or registry.queries():
        try:
            ok, note = compare(session, duck_con, sf, query)
        except Exception as problem:  # report and go on with the next query
            ok, note = False, repr(problem)[:1500]
        failures += not ok
        print(("ok   " if ok else "FAIL ") + query, note, flush=True)
    print("failures:", failures)
    sys.exit(1 if failures else 0)

"""Run registered queries against their DuckDB statements.

``python -m tests.support [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry_module
from bazarlens.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session() -> SparkSession:
    spark = build_session(
        "bazarlens-tests",
        "local[8]",
        8,
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.streaming.stateStore.maintenanceInterval": "600s"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in data), key=repr)


def compare(spark: SparkSession, connection, name: str, sf_dir: str) -> tuple[str, int]:
    """('ok' | reason, number of rows)."""
    frame = entry_module.queries()[name](spark, sf_dir)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return ("rows only" if got else "EMPTY"), len(got)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    want = rows(names, result.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]}", len(got)
    kinds = [(n, type(g), type(w)) for n, g, w in zip(sorted(names), got[0], want[0]) if g is not None and type(g) is not type(w)] if got else []
    if kinds:
        return f"types {kinds}", len(got)
    return ("ok" if got else "EMPTY"), len(got)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(entry_module.queries())
    spark, connection = session(), duck(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            verdict, count = compare(spark, connection, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - the report goes on with the next query
            verdict, count = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0
        failed += verdict not in ("ok", "rows only")
        print(f"{name:28} {count:8} rows {time.time() - start:7.2f}s  {verdict}", flush=True)
    missing = set(entry_module.oracle_sql()) - set(entry_module.queries())
    print(f"{failed} of {len(names)} failed; statements without a query: {sorted(missing)}")


if __name__ == "__main__":
    main()

"""Run registered queries beside their DuckDB twins and compare names, types and values."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
DATA = Path("/root/testdata")


def import_duckdb():
    try:
        import duckdb
    except ImportError:
        sys.path.append(os.environ.get("DUCKDB_PATH", "/opt/oracle"))
        import duckdb
    return duckdb


def duck(folder: str):
    connection = import_duckdb().connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def _cell(value):
    if value is None:
        return ("0",)
    if isinstance(value, float):
        return ("f", repr(value + 0.0))
    return (type(value).__name__, str(value))


SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def compare(spark, connection, name, query, sql, folder):
    """Problems found for one query, and how long each engine took."""
    start = time.time()
    df = query(spark, folder)
    spark_rows = df.collect()
    took = time.time() - start
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    duck_rows = result.fetchall()
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(set(df.columns) ^ set(names))}"], took, len(spark_rows)
    for column, kind in df.dtypes:
        if SPARK_TYPES.get(kind, kind) != types[column]:
            problems.append(f"type {column}: {kind} / {types[column]}")
    ours, theirs = canonical(spark_rows, df.columns), canonical(duck_rows, names)
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} / {len(theirs)}")
    elif ours != theirs:
        different = [(a, b) for a, b in zip(ours, theirs) if a != b]
        problems.append(f"{len(different)} rows differ, first {different[0]}")
    return problems, took, len(spark_rows)


def main(prefixes, folder):
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    spark = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    oracle, failed = entry.oracle_sql(), []
    connection = duck(folder)
    for name, query in entry.queries().items():
        if prefixes and not name.startswith(tuple(prefixes)):
            continue
        try:
            if name not in oracle:
                rows = query(spark, folder).collect()
                print(f"{name:40s} no oracle rows={len(rows)}", flush=True)
                continue
            problems, took, rows = compare(spark, connection, name, query, oracle[name], folder)
        except Exception as error:  # report and go on with the other queries
            problems, took, rows = [f"{type(error).__name__}: {str(error)[:600]}"], 0.0, 0
        if problems:
            failed.append(name)
        print(f"{name:40s} {took:6.2f}s rows={rows} {'ok' if not problems else problems}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[2:], str(DATA / sys.argv[1]))

"""Run registered queries against DuckDB on the same tables and report differences.

    python tests/oracle_check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from harborline.sources.tables import TABLES  # noqa: E402


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value if os.environ.get("EXACT") else float(f"{value:.9g}")
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value


def rows_of(table, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(_cell(row[i])) for i in order) for row in table)


KINDS = {
    "bigint": "int", "int": "int", "integer": "int", "hugeint": "huge", "smallint": "int", "tinyint": "int",
    "double": "double", "float": "double", "string": "str", "varchar": "str", "boolean": "bool",
    "timestamp": "ts", "timestamp_ntz": "ts", "date": "date", "timestamp with time zone": "ts",
}


def compare(spark_df, con, sql) -> list[str]:
    spark_rows = [tuple(r) for r in spark_df.collect()]
    result = con.execute(sql)
    duck_columns = [d[0] for d in result.description]
    duck_rows = result.fetchall()
    problems = []
    if sorted(spark_df.columns) != sorted(duck_columns):
        return [f"columns {sorted(spark_df.columns)} vs {sorted(duck_columns)}"]
    duck_types = {d[0]: str(d[1]).lower() for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    for name, kind in spark_df.dtypes:
        ours, theirs = KINDS.get(kind, kind), KINDS.get(duck_types[name], duck_types[name])
        if ours != theirs:
            problems.append(f"type of {name}: {kind} vs {duck_types[name]}")
    a, b = rows_of(spark_rows, spark_df.columns), rows_of(duck_rows, duck_columns)
    if len(spark_rows) != len(duck_rows):
        problems.append(f"rows {len(spark_rows)} vs {len(duck_rows)}")
    if a != b:
        only_a, only_b = list((a - b).items()), list((b - a).items())
        problems.append(f"{len(only_a)} rows differ; spark {sorted(only_a)[:3]} duckdb {sorted(only_b)[:3]}")
    return problems


def main() -> int:
    import __spark_entry__ as entry
    from harborline.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--plain", action="store_true", help="session without any of the package's settings")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    root = args.sf if args.sf.startswith("/") else f"/root/testdata/sf{args.sf}"
    if args.plain:
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    else:
        spark = build_session("oracle-check", "local[8]", spark__sql__shuffle__partitions="8",
                              spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(root), entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            df = build(spark, root)
            if name in oracles:
                problems = compare(df, con, oracles[name])
                note = f"rows={con.execute(f'SELECT count(*) FROM ({oracles[name]})').fetchone()[0]}"
            else:
                problems, note = [], f"rows={df.count()} (no oracle)"
        except Exception as err:  # noqa: BLE001
            problems, note = [f"{type(err).__name__}: {str(err)[:600]}"], ""
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {note} {time.time() - start:.1f}s", flush=True)
        for p in problems:
            print("     ", p)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Runs registered queries in Spark and their oracles in DuckDB and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from datetime import date, datetime
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _plain(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_plain, value)) + "]"
    return str(value)


def _bag(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, folder: str, key: str) -> tuple[int, list[str]]:
    """Row count and the differences found, none when both engines agree."""
    result = queries()[key](spark, folder)
    rows = [tuple(r) for r in result.collect()]
    sql = oracle_sql().get(key)
    if sql is None:
        return len(rows), []
    cursor = connect(folder).execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    problems = []
    if sorted(names) != sorted(result.columns):
        problems.append(f"columns {sorted(result.columns)} != {sorted(names)}")
        return len(rows), problems
    for field in result.schema:
        ours, theirs = field.dataType.simpleString(), kinds[field.name].lower()
        known = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar",
                 "boolean": "boolean", "date": "date", "timestamp_ntz": "timestamp", "timestamp": "timestamp"}
        if known.get(ours, ours) != theirs:
            problems.append(f"type of {field.name}: {ours} != {theirs}")
    got, want = _bag(result.columns, rows), _bag(names, expected)
    if got != want:
        missing, extra = want - got, got - want
        problems.append(
            f"rows {len(rows)} vs {len(expected)}; missing {sum(missing.values())} {list(missing)[:2]}; "
            f"extra {sum(extra.values())} {list(extra)[:2]}"
        )
    return len(rows), problems


if __name__ == "__main__":
    # a scale factor or a folder
    folder = sys.argv[1] if "/" in sys.argv[1] else f"/root/testdata/sf{sys.argv[1]}"
    keys = sys.argv[2:] or list(queries())
    session = (
        SparkSession.builder.master("local[8]").appName("compare")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    bad = 0
    for key in keys:
        started = time.time()
        try:
            n, problems = compare(session, folder, key)
        except Exception as error:  # show every key's outcome, whatever fails
            n, problems = -1, [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        mark = "ok " if not problems else "BAD"
        print(f"{mark} {key:28s} rows={n:<7d} {time.time() - started:6.2f}s "
              f"{'' if key in oracle_sql() else '(rows only)'}", *problems, sep="\n      " if problems else " ")
    print(f"{len(keys) - bad} of {len(keys)} agree")

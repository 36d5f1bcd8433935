"""Runs queries in Spark and in DuckDB on the same tables and compares the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def cell(value: object) -> object:
        if value is None or value is pd.NaT or (isinstance(value, float) and value != value) or value is pd.NA:
            return "~null"
        if isinstance(value, float):
            return f"{value:.6f}" if not value.is_integer() else str(int(value))
        return str(int(value)) if isinstance(value, bool) or hasattr(value, "__index__") else str(value)

    columns = sorted(frame.columns)
    return sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"
    left, right = canonical(spark_frame), canonical(sql_frame)
    if left == right:
        return None
    only_left, only_right = set(left) - set(right), set(right) - set(left)
    shown = [str(sorted(s)[:3])[:700] for s in (only_left, only_right)]
    return f"rows {len(left)} / {len(right)}; only spark {len(only_left)}: {shown[0]}; only sql {len(only_right)}: {shown[1]}"


def main(folder: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from casefile.session import local_session

    spark = local_session("8")
    spark.sparkContext.setLogLevel("OFF")
    runs, sql = entry.queries(), entry.oracle_sql()
    failures = 0
    connection = connect(folder)
    for name in names or list(runs):
        started = time.time()
        try:
            frame = runs[name](spark, folder).toPandas()
            spent = time.time() - started
            if name in sql:
                started = time.time()
                problem = compare(frame, connection.execute(sql[name]).fetchdf())
                note = f"sql {time.time() - started:.1f}s"
            else:
                problem, note = None, "no sql"
        except Exception as error:  # report and go on
            problem, spent, note, frame = f"{type(error).__name__}: {str(error)[:900]}", time.time() - started, "", []
        failures += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:28s} {len(frame):7d} rows {spent:5.1f}s {note} {problem or ''}", flush=True)
    print("failures", failures)
    return failures


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))

"""Run queries in Spark and their SQL in DuckDB and compare rows, names and types.

    python -m checks.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time

import duckdb
import pandas as pd

from checks.queries import ORACLES, QUERIES
from sheaf.session import spark_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(map(tuple, frame.itertuples(index=False)), key=lambda t: tuple((v is not None, str(v)) for v in t))


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: str(frame[c].dtype) for c in sorted(frame.columns)}


def compare(spark, con, sf: str, name: str) -> tuple[str, str]:
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLES:
        return "rows-only", f"{len(got)} rows"
    want = con.execute(ORACLES[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return "FAIL", f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a != b:
        extra, lacking = sorted(set(a) - set(b), key=str)[:2], sorted(set(b) - set(a), key=str)[:2]
        return "FAIL", f"{len(a)} rows, SQL {len(b)}; only Spark {extra}; only SQL {lacking}"
    note = "" if kinds(got) == kinds(want) else f" types {kinds(got)} / {kinds(want)}"
    return "ok", f"{len(a)} rows{note}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = spark_session("local[8]", "compare", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    failed = 0
    for name in args.names or QUERIES:
        started = time.time()
        try:
            verdict, note = compare(spark, con, args.sf, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            verdict, note = "FAIL", f"{type(error).__name__}: {str(error)[:600]}"
        failed += verdict == "FAIL"
        print(f"{verdict:10}{name:34}{time.time() - started:6.1f}s  {note}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

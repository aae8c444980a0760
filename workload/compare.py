"""Run every registered query next to its SQL in DuckDB and compare the rows.

Usage: python -m workload.compare [table folder] [query ...]
"""

import sys
import time

import duckdb
import pandas as pd

from workload.oracles import ORACLES
from workload.queries import QUERIES
from workload.session import session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def sorted_rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [
        tuple(None if pd.isna(v) else v for v in row)
        for row in frame.astype(object).itertuples(index=False)
    ]
    return sorted(rows, key=repr)


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def differences(spark, con, sf_dir: str, name: str) -> list[str]:
    found = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        return []
    expected = con.execute(ORACLES[name]).df()
    if sorted(found.columns) != sorted(expected.columns):
        return [f"columns {sorted(found.columns)} / {sorted(expected.columns)}"]
    if len(found) != len(expected):
        return [f"rows {len(found)} / {len(expected)}"]
    pairs = zip(sorted_rows(found), sorted_rows(expected))
    return [f"{a} / {b}" for a, b in pairs if a != b]


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark = session()
    con = connect(sf_dir)
    bad = 0
    for name in names or QUERIES:
        start = time.perf_counter()
        try:
            found = differences(spark, con, sf_dir, name)
        except Exception as error:
            found = [str(error)[:2000]]
        bad += bool(found)
        print(f"{'DIFF' if found else 'ok':5}{name:35}{time.perf_counter() - start:6.2f}s")
        for line in found[:3]:
            print("     ", line)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))

"""Run registered queries and their check SQL on the same files and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

from vetloom.catalog.registry import check_sql
from vetloom.sources.tables import SCHEMAS


def oracle(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SCHEMAS:
        con.sql(f"create view {name} as select * from '{directory}/{name}.parquet'")
    return con


def _value(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int,)):
        return str(v)
    if isinstance(v, float) or type(v).__name__ in ("Decimal", "float64", "int64", "int32"):
        f = float(v)
        return str(int(f)) if f.is_integer() else f"{f:.6f}"
    if type(v).__name__ == "bool_":
        return str(bool(v))
    return str(v)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted(
        (tuple(_value(v) for v in row) for row in frame[cols].astype(object).itertuples(index=False, name=None)),
        key=lambda r: tuple((x is None, x or "") for x in r),
    )


def compare(spark, directory: str, query) -> str:
    """Empty when equal, otherwise what differs."""
    got = query(spark, directory).toPandas()
    if query.sql is None:
        return "" if len(got) else "no rows"
    want = oracle(directory).sql(check_sql(query.sql)).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if not len(got):
        return "no rows"
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        diff = f"rows {len(a)} != {len(b)}"
    elif a == b:
        return ""
    else:
        diff = "values"
    only_a, only_b = sorted(set(a) - set(b), key=str)[:3], sorted(set(b) - set(a), key=str)[:3]
    return f"{diff}\n   cols  {sorted(got.columns)}\n   spark {only_a}\n   check {only_b}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from vetloom.catalog.registry import QUERIES
    from vetloom.session import local_session

    entry.queries()
    directory = f"/root/testdata/{sys.argv[1]}"
    picked = [q for n, q in QUERIES.items() if not sys.argv[2:] or any(a == n or (a.endswith("*") and n.startswith(a[:-1])) or q.build.__module__.endswith("." + a) for a in sys.argv[2:])]
    spark = local_session(8)
    bad = 0
    for q in picked:
        start = time.time()
        try:
            problem = compare(spark, directory, q)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {q.name} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{len(picked) - bad}/{len(picked)} equal")

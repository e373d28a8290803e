"""Compare queries with their SQL twins in DuckDB.

    python tests/check_oracles.py [sf_dir] [name prefix …]
"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fiub":
            df[c] = df[c].astype(float) + 0.0
        else:
            df[c] = df[c].map(lambda v: None if pd.isna(v) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    a, b = normal(left), normal(right)
    if a.equals(b):
        return None
    for c in a.columns:
        bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{bad.sum()} rows differ in {c}: {a.loc[i].to_dict()} / {b.loc[i].to_dict()}"
    return "types"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = tuple(sys.argv[2:])
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('CHECK_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf), []
    oracles = entry.oracle_sql()
    for name, run in entry.queries().items():
        if wanted and not name.startswith(wanted):
            continue
        t0 = time.time()
        try:
            df = run(spark, sf)
            left = df.toPandas()
            t1 = time.time()
            problem, note = None, "rows only"
            if name in oracles:
                right = con.execute(oracles[name]).df()
                problem, note = differences(left, right), f"sql {time.time() - t1:.1f}s"
        except Exception as e:  # report and go on
            t1, note = time.time(), ""
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        status = "ok  " if problem is None else "FAIL"
        rows = len(left) if problem is None else "-"
        print(f"{status} {name} {t1 - t0:.1f}s {note} rows={rows} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

"""Run registered queries against their SQL: ``python -m tests.compare [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session() -> SparkSession:
    return (
        SparkSession.builder.master(os.environ.get("TEST_MASTER", "local[8]"))
        .appName("glosswork")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.unix.domain.socket.enabled", "true")
        .getOrCreate()
    )


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)) else str(v) for v in row)
            for row in frame.astype(object).itertuples(index=False)]
    return sorted(rows, key=repr)


def integral(frame: pd.DataFrame) -> pd.DataFrame:
    """Nullable integer columns reach pandas as floats on one side only."""
    out = frame.copy()
    for c in out.columns:
        if out[c].dtype.kind == "f":
            out[c] = out[c].astype("Int64")
    return out


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canonical(integral(got)), canonical(integral(want))
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b), key=repr)[:3], sorted(set(b) - set(a), key=repr)[:3]
    return f"{len(a)} rows vs {len(b)}; only spark {only_a}; only sql {only_b}"


def main(names: list[str]) -> int:
    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = session(), oracle_connection(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        try:
            began = time.time()
            frame = queries[name](spark, sf_dir)
            got = frame.toPandas()
            took = time.time() - began
            if name not in oracle:
                print(f"{name}: rows only, {len(got)}, {took:.2f}s", flush=True)
                continue
            want = con.execute(oracle[name]).df()
            problem = difference(got, want)
            kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns
                     if c in want.columns and got[c].dtype != want[c].dtype}
        except Exception as error:  # report all queries, not only the first broken one
            problem, took, got, kinds = f"{type(error).__name__}: {str(error)[:1500]}", 0.0, [], {}
        bad += problem is not None
        print(f"{name}: {'ok' if problem is None else problem} ({len(got)} rows, {took:.2f}s) {kinds or ''}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))

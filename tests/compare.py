"""Run registered queries against their DuckDB oracles: python tests/compare.py [sf] [substring...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def spark_session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.forceDeleteTempCheckpointLocation", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return "null"
        if isinstance(v, float):
            return repr(round(v, 9) + 0.0)
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, pd.Timestamp):
            return str(v.date()) if v == v.normalize() else str(v)
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False))


def compare(spark, con, name, build, sql, sf_dir) -> tuple[bool, str, float]:
    start = time.time()
    got_df = build(spark, sf_dir)
    types = dict(got_df.dtypes)
    rows = got_df.collect()
    seconds = time.time() - start
    got = pd.DataFrame([r.asDict() for r in rows], columns=got_df.columns, dtype=object)
    if sql is None:
        return True, f"rows={len(got)} (no oracle)", seconds
    rel = con.execute(sql)
    cols = [(d[0], str(d[1])) for d in rel.description]
    want = pd.DataFrame(rel.fetchall(), columns=[c for c, _ in cols], dtype=object)
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} vs {sorted(want.columns)}", seconds
    kinds = {"long": "BIGINT", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
             "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    loose = [(c, types[c], k) for c, k in cols if kinds.get(types[c], k) != k]
    a, b = canonical(got), canonical(want)
    note = f"rows={len(a)}" + (f" types differ {loose}" if loose else "")
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"{note} vs {len(b)}; cols {sorted(got.columns)}; first differences {diff}", seconds
    return not loose, note, seconds


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    wanted = args[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = spark_session(), oracle_connection(sf_dir)
    oracles, bad = oracle_sql(), []
    for name, build in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, note, seconds = compare(spark, con, name, build, oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            ok, note, seconds = False, f"{type(error).__name__}: {str(error)[:1500]}", 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {name} {seconds:.2f}s {note}", flush=True)
        if not ok:
            bad.append(name)
    print(f"failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

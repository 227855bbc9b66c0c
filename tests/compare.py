"""Run registered queries next to their SQL: ``python tests/compare.py [sf_dir] [name ...]``.

With ``SHARED=1`` all queries use the stage tables of one training run.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        column = frame[name]
        if column.dtype == object or str(column.dtype) in ("string", "str"):
            frame[name] = column.where(column.notna(), None).astype(object)
    keys = frame.astype(str).replace({"<NA>": "None", "nan": "None", "NaN": "None"})
    order = keys.sort_values(list(keys.columns)).index
    return keys.loc[order].reset_index(drop=True)


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None if equal, else what differs."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} / {len(sql_frame)}"
    left, right = spark_frame, sql_frame
    for name in left.columns:
        kinds = left[name].dtype.kind, right[name].dtype.kind
        if kinds[0] != kinds[1] and left[name].notna().all():
            return f"type of {name}: {left[name].dtype} / {right[name].dtype}"
        if "f" in kinds:
            left = left.assign(**{name: left[name].astype(float)})
            right = right.assign(**{name: right[name].astype(float)})
    a, b = canonical(left), canonical(right)
    differs = (a != b).any(axis=1)
    if differs.any():
        return f"{differs.sum()} of {len(a)} rows differ:\n{a[differs].head(5)}\n{b[differs].head(5)}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    if os.environ.get("SHARED"):
        from functools import lru_cache

        from vigilseries.plans import catalog

        catalog.training = lru_cache(maxsize=None)(catalog.training)
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master(os.environ.get("COMPARE_MASTER", "local[8]"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = oracle_connection(sf_dir), entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    bad = 0
    for name in names:
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            middle = time.time()
            if name not in oracles:
                verdict = f"no SQL, {len(got)} rows"
            else:
                problem = compare(got, con.execute(oracles[name]).df())
                verdict = f"ok, {len(got)} rows" if problem is None else f"DIFFERENT {problem}"
                bad += problem is not None
        except Exception as error:  # noqa: BLE001
            middle, verdict = time.time(), f"ERROR {str(error)[:1500]}"
            bad += 1
        print(f"{name}: {middle - start:.1f}s + {time.time() - middle:.1f}s {verdict}", flush=True)
    print(f"{bad} bad of {len(names)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

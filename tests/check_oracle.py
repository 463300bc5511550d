"""Compare registered queries with their SQL on DuckDB: python tests/check_oracle.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    out = pd.DataFrame()
    for name in df.columns:
        column = df[name]
        if pd.api.types.is_float_dtype(column):
            out[name] = column.map(lambda v: "" if pd.isna(v) else f"{v + 0.0:.6f}")
        elif "datetime" in str(column.dtype):
            out[name] = column.map(lambda v: "" if pd.isna(v) else str(pd.Timestamp(v)))
        else:
            out[name] = column.map(lambda v: "" if v is None or v is pd.NA or v != v else str(v))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


_KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date",
}


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None if both engines agree, else what differs."""
    result = query(spark, sf_dir)
    relation = con.sql(sql)
    theirs = {c: _KINDS.get(str(t), str(t)) for c, t in zip(relation.columns, relation.types)}
    ours = dict(result.dtypes)
    if ours != theirs:
        return f"types {sorted(set(ours.items()) ^ set(theirs.items()))}"
    left, right = canonical(result.toPandas()), canonical(relation.df())
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    if len(left) and not left.equals(right):
        differs = (left != right).any(axis=1)
        return f"{differs.sum()} rows differ\n{left[differs].head(3)}\n{right[differs].head(3)}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from slotwise.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, chosen, failures = oracle_sql(), sys.argv[2:], 0
    for name, query in queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, query, oracles[name], sf_dir)
                verdict = "same" if problem is None else problem
            else:
                problem, verdict = None, f"{len(query(spark, sf_dir).toPandas())} rows, no SQL"
        except Exception as error:  # report and go on with the next query
            problem = verdict = f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None
        print(f"{name:32s} {time.time() - start:6.2f}s  {verdict}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(main())

"""Compare registered queries with DuckDB over the same parquet tables."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return repr(v + 0.0)
        if hasattr(v, "item"):
            return cell(v.item())
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.astype(object).itertuples(index=False))


def compare(spark_df: pd.DataFrame, oracle_df: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(spark_df.columns) != sorted(oracle_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(oracle_df.columns)}"
    a, b = canonical(spark_df), canonical(oracle_df)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, columns {sorted(spark_df.columns)}, first: {bad[0][0]} != {bad[0][1]}"
    kinds = {c: (spark_df[c].dtype.kind, oracle_df[c].dtype.kind) for c in spark_df.columns}
    off = {c: k for c, k in kinds.items() if k[0] != k[1] and not spark_df[c].isna().any()}
    return f"types differ {off}" if off else None


if __name__ == "__main__":
    from skyweave.plans.catalogue import REGISTRY
    from skyweave.session import local_session

    args = [a for a in sys.argv[1:] if not a.startswith("-")]
    sf = next((a[5:] for a in sys.argv[1:] if a.startswith("--sf=")), "0.01")
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(sf_dir)
    names = args or list(REGISTRY)
    failed = []
    for name in names:
        q = REGISTRY[name]
        t = time.time()
        try:
            got = q.checked(spark, sf_dir).toPandas()
            t1 = time.time() - t
            if q.sql is None:
                problem = None if len(got) else "no rows"
            else:
                problem = compare(got, con.execute(q.sql).df())
            print(f"{'ok  ' if problem is None else 'FAIL'} {name} rows={len(got)} {t1:.1f}s {'rows-only' if q.sql is None else ''} {problem or ''}"[:900], flush=True)
        except Exception as e:  # noqa: BLE001
            problem = str(e)
            print(f"FAIL {name} {type(e).__name__} {problem[:900]}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} ok", failed)

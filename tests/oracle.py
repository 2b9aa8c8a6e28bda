"""Run queries beside their SQL in DuckDB and compare rows, by name and value."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def _kind(name: str) -> str:
    name = name.lower()
    for kinds in (("int", "integer"), ("bigint",), ("double",), ("float",), ("string", "varchar"), ("boolean",)):
        if name in kinds:
            return kinds[0]
    return name


def mismatch(df, con, sql: str) -> str | None:
    """None if the DataFrame equals the SQL result as a bag of rows, else what differs."""
    rel = con.sql(sql)
    want_types = {c: _kind(str(t)) for c, t in zip(rel.columns, rel.types)}
    got_types = {c: _kind(t) for c, t in df.dtypes}
    if got_types != want_types:
        return f"schema: {got_types} / {want_types}"
    cols = sorted(got_types)
    got = Counter(tuple(_cell(r[c]) for c in cols) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(_cell(r[i]) for i in at) for r in rel.fetchall())
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"rows {sum(got.values())} / {sum(want.values())}; {cols}; extra {extra}; missing {missing}"
    return None


def main() -> None:
    import sys
    import time

    from tests.conftest import make_session

    from __spark_entry__ import oracle_sql, queries

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con, bad = make_session(), connect(sf_dir), 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            sql = oracle_sql().get(name)
            said = mismatch(df, con, sql) if sql else f"rows only: {len(df.collect())}"
        except Exception as e:
            said = f"FAILED {type(e).__name__}: {str(e)[:900]}"
        ok = said is None or said.startswith("rows only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:28s} {time.time() - start:6.2f}s {said or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()

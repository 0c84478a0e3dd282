"""Compare every registered query with its SQL counterpart: python tests/check_queries.py <sf_dir> [names…]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(_plain(v) for v in row) for row in frame.itertuples(index=False, name=None)), key=repr)


def _plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return db


def spark_rows(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def sql_rows(db, statement: str) -> tuple[list[str], list[tuple]]:
    cursor = db.execute(statement)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = sorted((tuple(_plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    return sorted(names), rows


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from traceloom.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    db, statements, bad = connect(sf_dir), oracle_sql(), 0
    for name, build in queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            df = build(spark, sf_dir)
            got = spark_rows(df)
            took = time.time() - started
            if name not in statements:
                print(f"---- {name}: {len(got)} rows, no SQL, {took:.1f}s", flush=True)
                continue
            names, expected = sql_rows(db, statements[name])
            same = got == expected and names == sorted(df.columns)
            bad += not same
            print(f"{'ok  ' if same else 'DIFF'} {name}: {len(got)}/{len(expected)} rows, {took:.1f}s", flush=True)
            if not same:
                print("   columns", names, sorted(df.columns))
                left, right = set(got) - set(expected), set(expected) - set(got)
                print("   spark only", sorted(left, key=repr)[:3])
                print("   sql only  ", sorted(right, key=repr)[:3], flush=True)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {str(error)[:900]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()

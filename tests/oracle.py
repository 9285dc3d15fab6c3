"""Runs queries next to their DuckDB oracles and compares rows as sorted lists."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _sortable(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(row[i] for i in at) for row in rows), key=repr)


def compare(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    order = sorted(names)
    a, b = _sortable(got, df.columns, order), _sortable(want, names, order)
    for x, y in zip(a, b):
        if x != y:
            return f"{order}: {x} != {y}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import catalogue
    from pageloom.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    con = connect(sf)
    for name, query in catalogue.QUERIES.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in catalogue.ORACLES:
                bad = compare(spark, con, sf, query, catalogue.ORACLES[name])
                verdict = "ok" if bad is None else f"DIFF {bad[:1500]}"
            else:
                verdict = f"rows {query(spark, sf).count()}"
        except Exception as error:
            verdict = f"FAIL {type(error).__name__} {str(error)[:1500]}"
        print(f"## {time.time() - start:6.2f}s {name}: {verdict}", flush=True)

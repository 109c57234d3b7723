"""Run a query and its SQL over the same tables and compare their rows."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if (Path(sf_dir) / f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, dict):
        return {k: cell(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [cell(v) for v in x]
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str([cell(r[i]) for i in order]) for r in rows)


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = connect(sf_dir)
    rel = con.execute(sql)
    want = rows_of([c[0] for c in rel.description], rel.fetchall())
    assert got[0] == want[0], f"columns {got[0]} and {want[0]}"
    assert len(got[1]) == len(want[1]), f"rows {len(got[1])} and {len(want[1])}"
    for x, y in zip(got[1], want[1]):
        assert x == y, f"\n{x}\n{y}"
    return len(got[1])

"""Query results against DuckDB's over the same files."""

import math
import os

import duckdb


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, bytearray | bytes):
        return bytes(x)
    return [plain(y) for y in x] if isinstance(x, list | tuple) else x


def differences(df, sql, sf):
    """Rows that only one side has, with columns by name."""
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    mine = sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect())
    its = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in cursor.fetchall())
    return [x for x in zip(mine, its, strict=False) if x[0] != x[1]] + [len(mine)] * (len(mine) != len(its))

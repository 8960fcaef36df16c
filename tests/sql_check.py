"""Runs a registered query and its SQL on the smallest tables and compares all rows."""

from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def connection():
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def coarse(v):
    """Order rows by what rounding cannot turn round."""
    return str([round(x, 3) if isinstance(x, float) else coarse(x) if isinstance(x, tuple) else x for x in v])


def alike(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(alike, a, b))
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return abs(a - b) <= 2e-6 * max(1, abs(a))
    return a == b


def differences(spark, query, sql):
    """Rows of one side that have no counterpart on the other."""
    df = query(spark, SMALL)
    names = sorted(df.columns)
    cursor = connection().execute(sql)
    given = [d[0] for d in cursor.description]
    assert sorted(given) == names
    want = sorted((tuple(plain(r[given.index(c)]) for c in names) for r in cursor.fetchall()), key=coarse)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=coarse)
    assert len(got) == len(want)
    return [(a, b) for a, b in zip(got, want) if not alike(a, b)]

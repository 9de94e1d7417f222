"""Compares a query's rows with those of its SQL in DuckDB."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(folder) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal | int | float):
        return None if isinstance(value, float) and math.isnan(value) else round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def compare(df, sql, con):
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(names)
    want, got = rows(names, expected.fetchall()), rows(df.columns, df.collect())
    assert len(got) == len(want), f"{len(got)} rows, not {len(want)}: {got[:2]} {want[:2]}"
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not wrong, wrong[:3]
    return len(got)

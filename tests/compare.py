"""Runs a query and its SQL over one data folder and compares the rows."""

import datetime
import decimal
from pathlib import Path

import duckdb

FOLDER = "/root/testdata/sf0.001"


def database(folder=FOLDER):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in Path(folder).iterdir():
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{files}'")
    return db


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int | float | decimal.Decimal):
        return f"{float(value):.9g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def same(df, db, sql):
    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    theirs = sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    assert ours == theirs

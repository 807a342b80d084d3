"""Comparison of a query with its SQL in DuckDB: the same rows, columns matched by name."""

from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def _plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, list | tuple):
        return tuple(map(_plain, value))
    return value if value is None or isinstance(value, int | str) else str(value)


def rows(values, columns) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(_plain(row[i]) for i in order) for row in values)


def check(df, relation) -> None:
    assert sorted(df.columns) == sorted(relation.columns)
    mine, theirs = rows(df.collect(), df.columns), rows(relation.fetchall(), relation.columns)
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])

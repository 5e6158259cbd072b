"""Run a query and its SQL side by side."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, db, function, sql, sf_dir):
    frame = function(spark, sf_dir)
    result = db.sql(sql)
    assert sorted(frame.columns) == sorted(result.columns)
    got, want = rows_of(frame.columns, frame.collect()), rows_of(result.columns, result.fetchall())
    assert len(got) == len(want), (len(got), len(want), got[:3], want[:3])
    for g, w in zip(got, want):
        assert g == w, (sorted(frame.columns), g, w)

"""Runs a query and its SQL side by side."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def assert_same(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    kinds = dict(zip(relation.columns, map(str, relation.types), strict=True))
    assert {c: TYPES[k] for c, k in df.dtypes} == kinds
    ours = Counter(repr(tuple(r[c] for c in columns)) for r in df.collect())
    at = [relation.columns.index(c) for c in columns]
    theirs = Counter(repr(tuple(r[i] for i in at)) for r in relation.fetchall())
    assert ours == theirs, (list((ours - theirs))[:3], list((theirs - ours))[:3])

"""Runs a query and its SQL side by side."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(value):
    return repr(round(value, 9)) if isinstance(value, float) else repr(value)


def compare(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = df.collect()
    result = connect(sf_dir).execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = Counter(tuple(plain(dict(zip(names, r))[n]) for n in order) for r in result.fetchall())
    have = Counter(tuple(plain(r[n]) for n in order) for r in got)
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])
    return len(got)

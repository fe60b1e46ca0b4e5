"""Every query runs, and equals its SQL where it has some."""

import math
from collections import Counter

import duckdb
import pytest

from textmill.plans.catalogue import ORACLE_SQL, QUERIES


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(names, rows):
    order = sorted(names)
    at = [list(names).index(n) for n in order]
    return Counter(tuple(_plain(r[i]) for i in at) for r in rows)


@pytest.fixture(scope="module")
def db(tiny):
    c = duckdb.connect()
    for t in "documents labels conversations embeddings events pages benchmark".split():
        c.sql(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tiny, db, name):
    df = QUERIES[name](spark, tiny)
    rows = df.collect()
    if name in ORACLE_SQL:
        want = db.sql(ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert _rows(df.columns, rows) == _rows(want.columns, want.fetchall())

"""Every query of the plans beside its SQL, on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from lattiq.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations embeddings".split()


def same(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list):
        return tuple(same(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = Counter(tuple(same(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert rows
    if name in ORACLES:
        got = duck.execute(ORACLES[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == Counter(tuple(same(r[i]) for i in at) for r in got.fetchall())

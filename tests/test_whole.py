"""Queries over all edges and mentions against brute force."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import SF, TABLES, same

from lattiq.plans import bindings as B
from lattiq.plans.queries import QUERIES

@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(map(repr, (tuple(same(x) for x in r) for r in df.select(*cols).collect())))


def test_question_rounds_are_answered_from_all_facts(spark, duck):
    facts = duck.execute(f"WITH {B.M} SELECT l_suppkey, p_brand FROM m WHERE l_returnflag <> 'R' GROUP BY ALL").fetchall()
    edges = set(duck.execute(f"WITH {B.M} SELECT DISTINCT d, p_brand FROM m").fetchall())
    want = []
    for case in sorted({c for c, _ in facts}):
        true = {p for c, p in facts if c == case}
        state = {min(true): True}
        for _ in range(3):
            alive = {d for d, p in edges if state.get(p)}
            count = {}
            for d, p in edges:
                if d in alive and p not in state:
                    count[p] = count.get(p, 0) + 1
            if count:
                ask = min(count, key=lambda p: (-count[p], p))
                state[ask] = ask in true
        want += [(case, p, yes) for p, yes in state.items()]
    assert rows_of(QUERIES["question_rounds"](spark, SF)) == sorted(map(repr, want))


@pytest.fixture(scope="module")
def plain(duck):
    """Names and symmetric weights of the graph of all mentions."""
    rows = duck.execute(f"WITH {B.M} SELECT d, p_brand, count(*) FROM m GROUP BY ALL").fetchall()
    names = sorted({x for d, p, _ in rows for x in (d, p)})
    w = np.zeros((len(names), len(names)))
    for d, p, n in rows:
        i, j = names.index(d), names.index(p)
        w[i, j] = w[j, i] = n
    return names, w


def test_pagerank_walks_15_rounds_from_every_disease(spark, plain):
    names, w = plain
    seeds = np.diag([float(":" in x) for x in names])
    mass = seeds
    for _ in range(15):
        mass = 0.85 * mass @ (w / w.sum(axis=1, keepdims=True)) + 0.15 * seeds
    got = QUERIES["personalised_pagerank"](spark, SF).collect()
    assert {(r.case, r.x) for r in got} == {(names[i], names[j]) for i, j in zip(*np.nonzero(mass))}
    assert all(abs(r.mass - mass[names.index(r.case), names.index(r.x)]) < 2e-6 for r in got)


def test_link_prediction_counts_all_neighbours(spark, plain):
    names, w = plain
    near, k = w > 0, (w > 0).sum(axis=0)
    want = {}
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            if len(both := np.flatnonzero(near[i] & near[j])):
                want[names[i], names[j]] = (len(both), sum(1 / math.log(k[y] + 2) for y in both), sum(1 / k[y] for y in both))
    got = {(r.a, r.b): (r.cn, r.aa, r.ra) for r in QUERIES["link_prediction"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[x], want[x], atol=2e-6) for x in want)


def test_layers_of_every_disease_to_depth_three(spark, plain):
    names, w = plain
    want = set()
    for root in (i for i, x in enumerate(names) if ":" in x):
        depth, front = {root: 0}, [root]
        for k in (1, 2, 3):
            front = [int(j) for j in np.flatnonzero((w[front] > 0).any(axis=0)) if j not in depth] if front else []
            depth |= dict.fromkeys(front, k)
        want |= {(names[root], names[x], k) for x, k in depth.items()}
    got = [(r.root, r.x, r.depth) for r in QUERIES["bfs_layers"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want


def test_projection_sums_three_hops_of_all_mentions(spark, plain):
    names, w = plain
    grid = spark.createDataFrame([(x, i) for x in names for i in range(16)], "x string, i int")
    coin = np.zeros((len(names), 16))
    for r in grid.select("x", "i", F.pmod(F.xxhash64("x", "i", F.lit(7)), F.lit(6)).alias("h")).collect():
        coin[names.index(r.x), r.i] = {0: 1.0, 1: -1.0}.get(r.h, 0.0)
    step = w / w.sum(axis=1, keepdims=True)
    want = step @ coin + step @ step @ coin + step @ step @ step @ coin
    got = {r.x: r.vec for r in QUERIES["fast_projection"](spark, SF).collect()}
    assert sorted(got) == names and all(np.allclose(got[x], want[i], atol=2e-6) for i, x in enumerate(names))

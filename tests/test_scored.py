"""Scores of many pairs: the quick rounding, and tables of scores by counts."""

import math
import re

import pytest
from pyspark.sql import functions as F
from test_pairs import FACTS, LINKS, counted, rows_of
from test_queries import SF

from lattiq.functions import formulas as M
from lattiq.operators import ranking
from lattiq.plans.queries import QUERIES

ODD = [0.0, -0.0, 1e-7, -1e-7, 0.5e-6, -0.5e-6, 2.5e-6, 1.0000005, 1.0000015, 0.1234565, 0.1234575, 3.9999995, -7.00000049999, 1e6, 123456.7890125, 1e300, -1e300, 1e16 / 3, math.inf, -math.inf, math.nan, None, 5e-324]


@pytest.mark.parametrize("digits", [6, 9])
def test_quick_rounding_is_the_slow_one(spark, digits):
    x = spark.createDataFrame([(v,) for v in ODD], "x double").unionByName(spark.range(20000).select(((F.rand(7) - 0.5) * F.pow(F.lit(10.0), F.col("id") % 9 - 3)).alias("x")))
    x = x.unionByName(spark.range(20000).select(((F.col("id") - 10000) / F.lit(2.0 * 10**digits)).alias("x")))  # ties
    bits = lambda c: F.hex(F.encode(c.cast("string"), "utf-8"))
    assert x.where(~bits(M.rounded(F.col("x"), digits)).eqNullSafe(bits(F.round("x", digits)))).count() == 0


@pytest.mark.parametrize("limit", [0, 1, 9, 40, 1 << 18])
@pytest.mark.parametrize("of", [("c", "x", "t", "total"), ("c", "x", "t"), ("c", "x")])
def test_scores_by_table_and_in_place(spark, monkeypatch, limit, of):
    monkeypatch.setattr(ranking, "SCORES", limit)
    facts = spark.createDataFrame(FACTS, "case long, p string, yes boolean")
    to = ranking.reach(spark.createDataFrame(LINKS, "d string, p string").distinct())
    got = ranking.scored(ranking.finding_counts(facts, to), facts, to, lambda *v: {"s": sum((x * 10.0**i for i, x in enumerate(v)), F.lit(0.0)), "n": v[0]}, of)
    want = [(k, d, float(sum(dict(c=c, x=x, t=t, total=n)[o] * 10**i for i, o in enumerate(of))), c) for k, d, c, x, t, n in counted(FACTS, set(LINKS))]
    assert rows_of(got) == sorted(map(repr, [(k, d, float(f"{s:.9g}"), c) for k, d, s, c in want]))


@pytest.mark.parametrize("name", ["count_score_family", "corrected_score_family", "clamped_score_family"])
def test_families_score_no_pair_by_itself(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"round\(|LOG|SQRT", plan.split("Generate explode(_to")[0])


@pytest.mark.parametrize("name", ["normalised_scores", "top_k_diagnoses", "score_cutoffs", "min_match_filter", "tied_diagnoses", "weighted_edge_scores"])
def test_no_decimal_for_each_pair(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("Generate explode(_to")[0]
    assert "FLOOR" in plan.upper()

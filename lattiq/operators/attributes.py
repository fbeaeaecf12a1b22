"""Attributes of findings: distributions, bound matches, combination weights, alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.operators import ranking
from lattiq.shared import materialize


def applicability(edges: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(p, attribute, applicable, entropy): share of a finding's edges that carry the attribute, and the bits of its values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes]))
    x = edges.select("p", pairs.alias("x")).select("p", "x.*")
    n = x.groupBy("p", "attribute", "value").agg(F.count("*").alias("n"))
    t = n.groupBy("p", "attribute").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("with"))
    share = F.col("n") / F.nullif("with", F.lit(0))
    h = n.where("value IS NOT NULL").join(t, ["p", "attribute"]).groupBy("p", "attribute").agg(F.sum(-share * F.log2(share)).alias("entropy"))
    return t.join(h, ["p", "attribute"], "left").select("p", "attribute", (F.col("with") / F.col("all")).alias("applicable"), F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def combination_idf(rows: DataFrame, n_diseases: int | None = None) -> DataFrame:
    """(p, attribute, value, idf) over diseases, from rows (d, p, attribute, value)."""
    df = rows.groupBy("p", "attribute", "value").agg(F.count_distinct("d").alias("df"))
    n = rows.agg(F.count_distinct("d").alias("n")) if n_diseases is None else rows.sparkSession.createDataFrame([(n_diseases,)], "n long")
    return df.crossJoin(F.broadcast(n)).select("p", "attribute", "value", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1).alias("idf"))


def bound_score(case_rows: DataFrame, disease_rows: DataFrame, idf: DataFrame, bonus: float = 0.5) -> DataFrame:
    """(case, d, score): a matched finding counts 1; an attribute value only where its own finding matches, with bonus times idf.

    Of each finding a case has a set of (attribute, value); what a disease scores for a finding with such a set is computed
    once, for all cases that have it."""
    pair = F.when(F.col("value").isNotNull() & F.col("attribute").isNotNull(), F.struct("attribute", "value"))
    rows = case_rows.where("p IS NOT NULL").groupBy("case", "p").agg(F.array_sort(F.collect_set(pair)).alias("_set")).select("case", F.struct("p", "_set").alias("p"))
    rows = materialize(rows, "sets")
    sets = rows.select("p").distinct().select(F.col("p.p").alias("_p"), F.col("p").alias("_key"), F.explode_outer("p._set").alias("_v"))
    d = disease_rows.select("d", F.col("p").alias("_p")).distinct()
    base = sets.select("_p", "_key").distinct().join(d, "_p").select("d", "_key", F.lit(1.0).alias("x"))
    weight = bonus * F.coalesce("idf", F.lit(1.0))
    value = disease_rows.where("value IS NOT NULL AND attribute IS NOT NULL").select("d", "p", "attribute", "value").distinct().join(idf, ["p", "attribute", "value"], "left")
    value = value.select("d", F.col("p").alias("_p"), F.struct("attribute", "value").alias("_v"), weight.alias("x"))
    value = sets.where("_v IS NOT NULL").join(value, ["_p", "_v"]).select("d", "_key", "x")
    edges = base.unionByName(value).groupBy("d", F.col("_key").alias("p")).agg(F.sum("x").alias("x"))
    return ranking.by_pair(rows, edges, [F.sum("x").alias("score")]).select("case", "d", "score")


def alignment(values: Column, dist: Column) -> Column:
    """Mean share that a distribution gives the case's values; 0.5 where there is nothing to compare."""
    found = F.transform(values, lambda v: F.coalesce(F.try_element_at(dist, v), F.lit(0.0)))
    mean = F.aggregate(found, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(values), F.lit(0))
    return F.when(dist.isNull() | values.isNull() | (F.size(values) == 0), 0.5).otherwise(mean)


def attribute_aware(cases: DataFrame, edges: DataFrame, idf: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(case, d, score): (alpha + (1 - alpha) align) ln(1 + n) idf of the edge with most mentions for each finding.

    cases: (case, p, values); edges: (d, p, n_mentions, dist)."""
    best = edges.groupBy("d", "p").agg(F.max("n_mentions").alias("n"), F.max_by("dist", F.struct(F.col("n_mentions"), F.to_json("dist").alias("_j"))).alias("dist"))
    # what a disease scores for a finding with given values is computed once, for all cases that have them
    rows = materialize(cases.where("p IS NOT NULL").select("case", F.struct("p", "values").alias("p")), "values")
    keys = rows.select("p").distinct().select(F.col("p").alias("_key"), "p.*")
    s = (alpha + (1 - alpha) * alignment(F.col("values"), F.col("dist"))) * F.log1p("n") * F.coalesce("idf", F.lit(1.0))
    scored = keys.join(best, "p").join(idf, "p", "left").select("d", F.col("_key").alias("p"), s.alias("x"))
    return ranking.by_pair(rows, scored, [F.sum("x").alias("score")], lambda r, key: r).select("case", "d", "score")


def value_weighted(tokens: DataFrame) -> DataFrame:
    """(case, p, v): value over the scale's maximum, the largest of a finding's tokens (case, p, value, top); no scale: 1."""
    v = F.coalesce(F.col("value").try_cast("double") / F.nullif(F.col("top").cast("double"), F.lit(0.0)), F.lit(1.0))
    return tokens.groupBy("case", "p").agg(F.max(v).alias("v"))


def case_records(rows: DataFrame) -> DataFrame:
    """(case, p, places, severity) from (case, ord, p, place, severity): places are a set, the first severity wins."""
    first = F.min_by("severity", F.when(F.col("severity").isNotNull(), F.col("ord")))
    return rows.groupBy("case", "p").agg(F.array_sort(F.collect_set("place")).alias("places"), first.alias("severity"))

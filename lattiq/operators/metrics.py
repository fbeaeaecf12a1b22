"""Evaluation metrics, calibration and tests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattiq.operators.ranges import range_of


def set_metrics(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Micro recall, precision and F1 of two array columns; an empty set counts 1 in its denominator."""
    both = F.size(F.array_intersect(gold, predicted))
    s = rows.agg(F.sum(both).alias("i"), F.sum(F.greatest(F.size(F.array_distinct(gold)), F.lit(1))).alias("g"), F.sum(F.greatest(F.size(F.array_distinct(predicted)), F.lit(1))).alias("p"))
    r, p = F.col("i") / F.col("g"), F.col("i") / F.col("p")
    return s.select(r.alias("recall"), p.alias("precision"), F.when(r + p > 0, 2 * r * p / F.nullif(r + p, F.lit(0.0))).otherwise(0.0).alias("f1"))


def macro_set_metrics(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """Mean precision, recall, F1 where the prediction of a case is its top len(gold): ranking (case, d, rank), gold (case, d)."""
    n = gold.groupBy("case").agg(F.count_distinct("d").alias("n"))
    p = ranking.join(n, "case").where("rank <= n")  # read once: the rows of the ranking may be many
    true = gold.select("case", "d").distinct().withColumn("_hit", F.lit(True))
    size = p.join(true, ["case", "d"], "left").groupBy("case").agg(F.count("*").alias("m"), F.count("_hit").alias("hit"))
    x = n.join(size, "case", "left").na.fill(0, ["m", "hit"])
    pr, rc = F.when(F.col("m") > 0, F.col("hit") / F.nullif("m", F.lit(0))).otherwise(0.0), F.col("hit") / F.col("n")
    return x.agg(F.avg(pr).alias("precision"), F.avg(rc).alias("recall"), F.avg(F.when(pr + rc > 0, 2 * pr * rc / F.nullif(pr + rc, F.lit(0.0))).otherwise(0.0)).alias("f1"))


def hierarchical_f1(pairs: DataFrame, ancestors: DataFrame, decay: float = 0.5) -> DataFrame:
    """(case, a, b, f1) of pairs (case, a, b): overlap of the ancestor sets (x, ancestor, dist), squared weights decay^dist."""
    w = ancestors.select("x", "ancestor", F.pow(F.lit(decay * decay), F.col("dist")).alias("w"))
    total = w.groupBy("x").agg(F.sum("w").alias("t"))
    left = pairs.join(w.toDF("a", "ancestor", "wa"), "a").join(w.toDF("b", "ancestor", "wb"), ["b", "ancestor"])
    hit = left.groupBy("case", "a", "b").agg(F.sum(F.sqrt(F.col("wa") * F.col("wb"))).alias("i"))
    x = pairs.join(hit, ["case", "a", "b"], "left").join(total.toDF("a", "ta"), "a").join(total.toDF("b", "tb"), "b")
    return x.select("case", "a", "b", (2 * F.coalesce("i", F.lit(0.0)) / (F.col("ta") + F.col("tb"))).alias("f1"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, rate) of (score, label): bin min(int(score bins), bins - 1)."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("rate"))


def ece_brier(rows: DataFrame, bins: int = 10) -> DataFrame:
    c = calibration(rows, bins)
    ece = c.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n")).alias("ece"))
    return ece.crossJoin(rows.agg(F.avg((F.col("score") - F.col("label")) ** 2).alias("brier"), F.count("*").alias("n")))


def platt(rows: DataFrame, steps: int = 500, rate: float = 0.1, cells: int = 4096) -> tuple[float, float]:
    """(a, b) of sigmoid(a score + b) by gradient steps on (score, label).

    Rows of equal score, to 1/cells of the range, act as one with weight and mean label, so that a
    fit needs one aggregation of bounded size instead of a pass a step."""
    x = rows.groupBy(F.round(F.col("score") * cells).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("double")).alias("y")).orderBy("s").collect()
    s, n, y = (np.array([r[c] for r in x], float) for c in ("s", "n", "y"))
    s, a, b, total = s / cells, 1.0, 0.0, n.sum()
    for _ in range(steps):
        off = n / (1 + np.exp(-(a * s + b))) - y
        a, b = a - rate * (off @ s) / total, b - rate * off.sum() / total
    return float(a), float(b)


def greedy_matches(rows: DataFrame, relaxed: bool = True) -> DataFrame:
    """(doc, tp, n_pred, n_gold) of rows (doc, side, ord, mention): left to right, each gold mention used once.

    relaxed: equal, one in the other, or a shared word; else equal only. A document's mentions are one group."""
    stop = {"the", "of", "and", "in", "a", "with"}

    def match(a: str, b: str) -> bool:
        return a == b or (relaxed and (a in b or b in a or bool(set(a.split()) & set(b.split()) - stop)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "mention"])
        gold, tp = pdf[pdf.side == "gold"].mention.tolist(), 0
        n_gold, pred = len(gold), pdf[pdf.side == "pred"].mention.tolist()
        for p in pred:
            at = next((i for i, g in enumerate(gold) if match(p, g)), None)
            if at is not None:
                gold.pop(at)
                tp += 1
        return pd.DataFrame({"doc": [pdf.doc.iloc[0]], "tp": [tp], "n_pred": [len(pred)], "n_gold": [n_gold]})

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.groupBy("doc").applyInPandas(one, f"doc {kind}, tp long, n_pred long, n_gold long")


def prf(counts: DataFrame) -> DataFrame:
    s = counts.agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("np"), F.sum("n_gold").alias("ng"))
    p, r = F.col("tp") / F.nullif("np", F.lit(0)), F.col("tp") / F.nullif("ng", F.lit(0))
    return s.select(p.alias("precision"), r.alias("recall"), (2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"))


def one_way_anova(rows: DataFrame, factor: str, value: str) -> DataFrame:
    """Sums of squares, degrees of freedom, F and eta squared of one factor's main effect."""
    g = rows.groupBy(factor).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.agg(F.sum("n").alias("total"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("ss_within"))
    x = g.crossJoin(F.broadcast(t)).groupBy("total", "k", "ss_within").agg(F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("ss_between"))
    f = (F.col("ss_between") / (F.col("k") - 1)) / (F.col("ss_within") / (F.col("total") - F.col("k")))
    return x.select(F.lit(factor).alias("factor"), (F.col("k") - 1).alias("df"), "ss_between", "ss_within", f.alias("f"), (F.col("ss_between") / (F.col("ss_between") + F.col("ss_within"))).alias("eta2"))


def chi2_contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(chi2, df) of the table of two columns; sum(o^2 / e) - n needs no cells of zero."""
    n = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    ra, rb = n.groupBy(a).agg(F.sum("o").alias("ra")), n.groupBy(b).agg(F.sum("o").alias("rb"))
    x = n.join(ra, a).join(rb, b).agg(F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("rb").cast("double"))).alias("s"), F.sum("o").alias("t"), ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("df"))
    return x.select((F.col("t") * F.col("s") - F.col("t")).alias("chi2"), "df")


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks; ranks are taken on distinct values with their counts, range by range."""
    x = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    for c in (a, b):
        n = x.groupBy(c).agg(F.count("*").alias("_n"))
        cut = n.withColumn("_r", range_of(n, c))
        per = cut.groupBy("_r").agg(F.sum("_n").alias("_s"))
        per = per.select("_r", (F.sum("_s").over(Window.orderBy("_r")) - F.col("_s")).alias("_before"))  # one row a range
        inside = F.sum("_n").over(Window.partitionBy("_r").orderBy(c))
        ranks = cut.join(F.broadcast(per), "_r").select(c, (F.col("_before") + inside - (F.col("_n") - 1) / 2).alias(f"_r_{c}"))
        x = x.join(ranks, c)
    return x.agg(F.corr(f"_r_{a}", f"_r_{b}").alias("rho"))


def fill_rates(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(attribute, rate): share of rows whose value is there and not empty."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), (F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) > 0).alias("ok")) for c in columns]))
    return rows.select(pairs.alias("x")).groupBy("x.attribute").agg(F.avg(F.col("x.ok").cast("double")).alias("rate"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    n = rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def bundle(cases: DataFrame) -> DataFrame:
    """One row from (case, asked, right): n, hit rate at 1, mean and largest number of questions."""
    return cases.agg(F.count("*").alias("n"), F.avg(F.col("right").cast("double")).alias("at_1"), F.avg("asked").alias("mean_questions"), F.max("asked").alias("most_questions"))


def accuracy_by(cases: DataFrame, group: str) -> DataFrame:
    """(group, n, hits, accuracy) from rows (group, right)."""
    return cases.groupBy(group).agg(F.count("*").alias("n"), F.count_if("right").alias("hits"), F.avg(F.col("right").cast("double")).alias("accuracy"))


def lexical_match(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(precision, recall) of distinct strings (x), equal after lower case and trimming."""
    p, g = (df.select(F.trim(F.lower("x")).alias("x")).where("x <> ''").distinct() for df in (predicted, gold))
    both = p.withColumn("p", F.lit(1)).join(g.withColumn("g", F.lit(1)), "x", "full")
    hit = F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull())
    return both.agg((hit / F.nullif(F.count("p"), F.lit(0))).alias("precision"), (hit / F.nullif(F.count("g"), F.lit(0))).alias("recall"))

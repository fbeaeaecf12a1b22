"""Further score channels and selectors, all over cases (case, p), profiles (d, p, w) and scores (case, d, score)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.operators import ranking
from lattiq.shared import materialize


def pair_count_scores(cases: DataFrame, counts: DataFrame) -> DataFrame:
    """Scores from pair counts (d, p, n): coverage, weighted, idf, ratio, naive Bayes, idf less unmatched idf."""
    n_d = counts.agg(F.count_distinct("d").alias("N"))
    idf = counts.groupBy("p").agg(F.count_distinct("d").alias("df")).crossJoin(F.broadcast(n_d)).select("p", F.log((F.col("N") + 1.0) / (F.col("df") + 1.0)).alias("i"))
    e = counts.join(idf, "p")
    t = e.groupBy("d").agg(F.count("*").alias("t"), F.sum("n").alias("all_n"), F.sum("i").alias("all_i"))
    m = cases.distinct().join(e, "p").groupBy("case", "d").agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.sum("i").alias("x"), F.sum(F.log1p("n")).alias("ln_n"))
    j = m.join(t, "d")
    return j.select("case", "d", (F.col("c") / F.col("t")).alias("coverage"), F.col("w").cast("double").alias("weighted"), F.col("x").alias("idf"), (F.col("c") * F.col("c") / (F.col("t") + 1)).alias("ratio"),
                    (F.col("ln_n") - F.col("c") * F.log1p("all_n")).alias("bayes"), (F.col("x") - 0.1 * (F.col("all_i") - F.col("x"))).alias("idf_negative"))


def concept_negative(scores: DataFrame, denied: DataFrame, profile: DataFrame, idf: DataFrame, lam: float = 0.4, beta: float = 0.75, norm: str = "both") -> DataFrame:
    """Penalty summed over the denied findings themselves; norm: by sqrt(n) and the profile ("both"), the profile, or none."""
    vec = denied.distinct().join(idf, "p", "left").withColumn("v", F.pow(F.coalesce("idf", F.lit(1.0)), F.lit(beta)))
    n = denied.distinct().groupBy("case").agg(F.count("*").alias("_n"))
    pen = vec.join(profile, "p").groupBy("case", "d").agg(F.sum(F.col("v") * F.col("w")).alias("_pen")).join(n, "case")
    by = {"both": F.sqrt("_n") * F.col("dnorm"), "profile": F.col("dnorm"), "none": F.lit(1.0)}[norm]
    return scores.join(pen, ["case", "d"], "left").withColumn("score", F.col("score") - lam * F.coalesce(F.col("_pen") / by, F.lit(0.0))).drop("_pen", "_n")


def chief_boost(vectors: DataFrame, chief: DataFrame, factor: float = 2.0) -> DataFrame:
    """Case vectors (case, p, v) with the chief complaint's entries (case, p) multiplied, before any norm."""
    mark = chief.distinct().withColumn("_m", F.lit(factor))
    return vectors.join(mark, ["case", "p"], "left").select("case", "p", (F.col("v") * F.coalesce("_m", F.lit(1.0))).alias("v"))


#: Values that say a finding is absent (fixed values).
ABSENT = ("N", "nulle_part", "aucun", "aucune", "NA")


def explicit_negative(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positives and negatives of tokens (case, base, value, p): values that say 'none' deny their question's finding."""
    absent = F.coalesce(F.col("value").isin(*ABSENT), F.lit(False))
    return tokens.where(~absent).select("case", "p").distinct(), tokens.where(absent).select("case", "p").distinct()


def cardinal_negative(scores: DataFrame, cases: DataFrame, profile: DataFrame, idf: DataFrame, k: int = 5, least: float = 0.5, lam: float = 0.1) -> DataFrame:
    """Less lam times w idf of a disease's cardinal findings (top k, heavier than ``least``) that the case lacks."""
    card = ranking.top_profile(profile, k).where(F.col("w") > least).join(idf, "p", "left").withColumn("x", F.col("w") * F.coalesce("idf", F.lit(1.0)))
    total = card.groupBy("d").agg(F.sum("x").alias("_all"))
    hit = cases.distinct().join(card, "p").groupBy("case", "d").agg(F.sum("x").alias("_hit"))
    j = scores.join(total, "d", "left").join(hit, ["case", "d"], "left")
    return j.withColumn("score", F.col("score") - lam * (F.coalesce("_all", F.lit(0.0)) - F.coalesce("_hit", F.lit(0.0)))).drop("_all", "_hit")


def dimensional(cases: DataFrame, profile: DataFrame, dimension: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum over the findings' dimensions (p, dim) of matched weight over the root of the dimension's weight."""
    x = profile.join(dimension, "p", "left").withColumn("dim", F.coalesce("dim", F.lit("other")))
    total = x.groupBy("d", "dim").agg(F.sum("w").alias("t"))
    table = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])
    m = cases.distinct().join(x, "p").groupBy("case", "d", "dim").agg(F.sum("w").alias("m")).join(total, ["d", "dim"])
    return m.groupBy("case", "d").agg(F.sum(F.coalesce(F.try_element_at(table, F.col("dim")), F.lit(0.0)) * F.col("m") / F.sqrt("t")).alias("score"))


def antecedent_vote(history: DataFrame, profile: DataFrame) -> DataFrame:
    """Largest w ln(N / diseases that have the finding) over a case's history (case, p)."""
    n = profile.agg(F.count_distinct("d").alias("N"))
    df = profile.groupBy("p").agg(F.count_distinct("d").alias("df")).crossJoin(F.broadcast(n))
    x = history.distinct().join(profile, "p").join(df, "p")
    return x.groupBy("case", "d").agg(F.max(F.col("w") * F.log(F.col("N") / F.col("df"))).alias("score"))


def compound_pairs(cases: DataFrame, compounds: DataFrame) -> DataFrame:
    """(case, p): compound findings (q, v, p) of which the case (case, q, v values of a question) has the pair."""
    return cases.select("case", "q", "v").distinct().join(compounds, ["q", "v"]).select("case", "p").distinct()


def text_markers(texts: DataFrame, markers: dict[str, tuple[str, ...]]) -> DataFrame:
    """(d, marker, n) of marker words in a disease's texts (d, text)."""
    cols = [F.struct(F.lit(k).alias("marker"), sum(F.size(F.split(F.lower("text"), rf"\b{w}\b")) - 1 for w in ws).cast("long").alias("n")) for k, ws in markers.items()]
    return texts.select("d", F.explode(F.array(*cols)).alias("x")).groupBy("d", "x.marker").agg(F.sum("x.n").alias("n"))


def fuzzy_match(a: Column, b: Column) -> Column:
    """One in the other, or a shared word that is no stop word."""
    words = lambda c: F.array_except(F.split(F.lower(c), r"\W+"), F.array(*[F.lit(w) for w in ("", "the", "of", "and", "in", "a", "with")]))
    return F.lower(a).contains(F.lower(b)) | F.lower(b).contains(F.lower(a)) | F.arrays_overlap(words(a), words(b))


def oracle_lookahead(state: DataFrame, first: DataFrame, truth: DataFrame, edges: DataFrame, rollouts: int = 0, depth: int = 3, seed: int = 42) -> DataFrame:
    """(case, q, value) of each candidate: the best share after it and ``depth`` more questions.

    The simulation answers from the case's true findings, so this is an upper bound, not a strategy to deploy.
    rollouts 0: the questions that most diseases share; else the mean of so many hash-drawn orders. All
    simulations of all cases are one plan; the work grows with candidates, runs and the diseases in reach."""
    e = materialize(edges.select("d", "p").distinct(), "edges")
    known = materialize(state.select("case", "p", "yes").distinct(), "state")
    reach = known.where("yes").join(e, "p").select("case", "d").distinct()
    pool = reach.join(e, "d").select("case", "p").distinct().join(known.select("case", "p"), ["case", "p"], "left_anti")
    runs = first.select("case", F.col("p").alias("q")).distinct().withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(max(1, rollouts) - 1))))
    met = runs.join(pool, "case").where("p <> q")
    if rollouts:
        order = F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), "case", "q", "run", "p")).alias("o"), F.col("p"))
    else:
        met = met.join(e.groupBy("p").agg(F.count("*").alias("shared")), "p")
        order = F.struct((-F.col("shared")).alias("o"), F.col("p"))
    asked = met.withColumn("_r", F.row_number().over(ranking.by("case", "q", "run").orderBy(order))).where(F.col("_r") <= depth).select("case", "q", "run", "p")
    asked = asked.unionByName(runs.select("case", "q", "run", F.col("q").alias("p")))
    told = asked.join(truth.select("case", "p").distinct().withColumn("_t", F.lit(True)), ["case", "p"], "left").withColumn("yes", F.coalesce("_t", F.lit(False)))
    told = told.join(known.select("case", "p").withColumn("_k", F.lit(True)), ["case", "p"], "left").where("_k IS NULL").drop("_k", "_t")
    old = known.join(e, "p").groupBy("case", "d").agg(F.count_if("yes").alias("c"), F.count_if(~F.col("yes")).alias("x"))
    new = told.join(e, "p").groupBy("case", "q", "run", "d").agg(F.count_if("yes").alias("c"), F.count_if(~F.col("yes")).alias("x"))
    n = runs.join(old, "case").unionByName(new).groupBy("case", "q", "run", "d").agg(F.sum("c").alias("c"), F.sum("x").alias("x")).where("c > 0")
    raw = F.col("c") * F.col("c") / (F.col("c") + F.col("x") + 1)
    best = n.groupBy("case", "q", "run").agg((F.max(raw) / F.sum(raw)).alias("best"))
    return runs.join(best, ["case", "q", "run"], "left").groupBy("case", "q").agg(F.avg(F.coalesce("best", F.lit(0.0))).alias("value"))


def logistic_classifier(cases: DataFrame, truth: DataFrame, buckets: int = 1 << 12, rounds: int = 20):
    """Multinomial logistic regression on hashed findings: (model, labels); for comparison only, it sees labels."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, StringIndexer

    rows = cases.groupBy("case").agg(F.collect_set(F.col("p").cast("string")).alias("tokens")).join(truth, "case")
    index = StringIndexer(inputCol="d", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    x = HashingTF(numFeatures=buckets, inputCol="tokens", outputCol="features", binary=True).transform(index.transform(rows))
    return LogisticRegression(maxIter=rounds, regParam=1e-3).fit(x), x


def _units(vectors: DataFrame) -> DataFrame:
    """(id, u): vectors scaled to length 1; those that are null, zero or hold null or NaN components have no row."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    x = vectors.select("id", F.transform("vec", lambda v: v.cast("double")).alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    x = x.withColumn("n", F.sqrt(dot(F.col("vec"), F.col("vec")))).where("n > 0 AND NOT isnan(n)")
    return x.select("id", F.transform("vec", lambda v: v / F.col("n")).alias("u"))


def _spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of a spanning forest of the marked pairs: as many links as connect what they connect."""
    turned, left, right = np.ascontiguousarray(near.T), near.any(axis=1), near.any(axis=0)
    rows, cols = [np.empty(0, int)], [np.empty(0, int)]
    for start in np.flatnonzero(left):
        front = np.array([start]) if left[start] else np.empty(0, int)
        left[front] = False
        while front.size:
            reach = near[front] & right
            new = np.flatnonzero(reach.any(axis=0))
            rows.append(front[reach[:, new].argmax(axis=0)]), cols.append(new)
            right[new] = False
            back = turned[new] & left
            front = np.flatnonzero(back.any(axis=0))
            rows.append(front), cols.append(new[back[:, front].argmax(axis=0)] if front.size else front)
            left[front] = False
    return np.concatenate(rows), np.concatenate(cols)


def _meet(units: DataFrame, threshold: float, block: int, seed: int, forest: bool) -> DataFrame:
    """(a, b, cosine) with a < b of rows (id, u) with at least that cosine; forest: of each two blocks, only links
    enough to connect what they connect. Every two blocks meet in a task, so a vector is sent once for each block."""
    x = materialize(units, "units")
    n = max(1, -(-x.count() // block))
    x = x.withColumn("own", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int"))
    left = x.select(F.col("id").alias("a"), F.col("u").alias("ua"), F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.lit(n - 1))).alias("j"))
    right = x.select(F.col("id").alias("b"), F.col("u").alias("ub"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"))
    kind = x.schema["id"].dataType.simpleString()

    def meet(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = []
        for size in set(l.ua.map(len)) & set(r.ub.map(len)) if len(l) and len(r) else ():
            p, q = l[l.ua.map(len) == size], r[r.ub.map(len) == size]
            c = np.stack(p.ua) @ np.stack(q.ub).T
            at = _spanning(c >= threshold) if forest else np.nonzero(c >= threshold)
            found.append(pd.DataFrame({"a": p.a.to_numpy()[at[0]], "b": q.b.to_numpy()[at[1]], "cosine": c[at]}))
        return pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "cosine": []})

    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(meet, f"a {kind}, b {kind}, cosine double")
    return met.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("cosine").alias("cosine"))


def similar_pairs(vectors: DataFrame, threshold: float = 0.9, block: int = 4096, seed: int = 3) -> DataFrame:
    """(a, b, cosine) of all pairs of rows (id, vec) with at least that cosine, a < b, exactly.

    Rows are dealt into blocks of about ``block`` by a hash, and every two blocks meet in a task: a vector is
    sent once for each block, and the work grows with the square of the rows."""
    return _meet(_units(vectors), threshold, block, seed, False)


def canonical_ids(vectors: DataFrame, threshold: float = 0.9, block: int = 4096, seed: int = 3) -> DataFrame:
    """(id, canonical) for every id of rows (id, vec): the smallest id that a chain of similar pairs reaches.

    Rows of one direction are a class, named by its smallest id, and only classes are compared; each two blocks
    of them give a spanning forest of their links, so groups of copies or near copies make no square of rows.
    Each round a class takes the least label among its neighbours, then that label's own label, until none
    changes; an id of several vectors links their classes, one without a usable vector stands for itself."""
    units = materialize(_units(vectors), "units")
    classes = materialize(units.groupBy("u").agg(F.min("id").alias("id")), "classes")
    member = materialize(units.join(classes.withColumnRenamed("id", "rep"), "u").select("id", "rep").distinct(), "members")
    low = member.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    several = member.join(low.where("low < high"), "id").select(F.col("low").alias("a"), F.col("rep").alias("b")).where("a <> b")
    pairs = materialize(_meet(classes, threshold, block, seed, True).select("a", "b").unionByName(several).distinct(), "pairs")
    both = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    label = materialize(classes.select("id", F.col("id").alias("canonical")).distinct(), "labels")
    while True:
        least = both.join(label.toDF("b", "near"), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = materialize(label.join(least.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("canonical").alias("old"), F.least("canonical", "near").alias("canonical")), "step")
        after = materialize(step.join(step.select(F.col("id").alias("canonical"), F.col("canonical").alias("next")), "canonical").select("id", "old", F.col("next").alias("canonical")), "labels")
        label = after.select("id", "canonical")
        if after.where("canonical <> old").isEmpty():
            break
    found = low.join(label.toDF("low", "canonical"), "low").select("id", "canonical")
    every = vectors.where("id IS NOT NULL").select("id").distinct()
    return every.join(found, "id", "left").select("id", F.coalesce("canonical", "id").alias("canonical"))

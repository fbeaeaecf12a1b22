"""Profiles, scores of cases against profiles, ranking and re-ranking.

cases: rows (case, p); profiles: rows (d, p, w); scores: rows (case, d, score). A ranking is always
by score, highest first, then by d, so that it is total.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from lattiq.functions import formulas as M
from lattiq.shared import materialize


#: Edges that are broadcast at once, and pairs that meet in one task.
EDGES, PAIRS = 1 << 19, 1 << 20

#: Diseases whose pairs with a case may be counted in one row of a matrix; cells and pairs of such a matrix, a single case aside.
DENSE, CELLS = 1 << 10, 1 << 20

#: Edges that such matrices may be counted from; each takes two bytes in every Python worker.
CODED = 1 << 24

#: Sets of counts that are scored once.
SCORES = 1 << 18


def by(*keys: str) -> Window:
    return Window.partitionBy(*keys)


class Reach(NamedTuple):
    """Edges (d, p, more) as lists that cases are sent to meet; diseases are dealt to blocks of about ``EDGES`` edges."""

    lists: DataFrame  # (p, _b, _to: array of (_d, more), _id)
    names: DataFrame  # (d, _d, _n, _b): a disease, its place in its block by d (from 1), its edges
    blocks: int


def reach(edges: DataFrame, matrix: bool = False) -> Reach:
    """matrix: for ``by_case`` alone, so one block if the diseases are no more than ``DENSE`` and the edges than ``CODED``."""
    more = [c for c in edges.columns if c not in ("d", "p")]
    e = materialize(edges.where("p IS NOT NULL"), "edges")
    n = e.count()
    blocks = 1 if matrix and n <= CODED and e.select("d").distinct().count() <= DENSE else max(1, -(-n // EDGES))
    names = e.groupBy("d").agg(F.count("*").alias("_n")).withColumns({"_b": F.pmod(F.xxhash64("d"), F.lit(blocks))})
    names = materialize(names.withColumn("_d", F.row_number().over(by("_b").orderBy("d")).cast("long")), "diseases")
    number = names.select(F.col("d").alias("_of"), "_b", "_d")  # a null disease is one, too
    lists = e.join(number, F.col("d").eqNullSafe(F.col("_of"))).groupBy("p", "_b").agg(F.collect_list(F.struct("_d", *more)).alias("_to"))
    return Reach(materialize(lists.withColumn("_id", F.monotonically_increasing_id()), "lists"), names, blocks)


def by_pair(rows: DataFrame, edges: DataFrame | Reach, aggregates: Sequence[Column], regroup: Callable[[DataFrame, list[str]], DataFrame] | None = None, best: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(case, d, _n, aggregates) over the pairs of rows (case, p, more) and edges (d, p, more) that share p.

    Pairs outnumber rows by the diseases of a finding, so no pair is shuffled: the rows are dealt by case, a block of the
    edges is broadcast to them as one list for each p, and the pairs of a case arise and are summed in one task, of about
    ``PAIRS`` pairs. More blocks take more passes. regroup (rows, key) may combine a case's rows by the columns ``key``
    before they meet, by default it drops copies. best (case, _d, aggregates) may choose among a block's pairs before they
    are named. With one block the result is still dealt by case. _n: edges of d."""
    to = edges if isinstance(edges, Reach) else reach(edges)
    rows = rows.where("p IS NOT NULL")
    size = to.lists.groupBy("p").agg(F.sum(F.size("_to")).alias("_k"))
    pairs = rows.groupBy("p").agg(F.count("*").alias("_c")).join(size, "p").agg(F.sum(F.col("_c") * F.col("_k"))).first()[0] or 0
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-pairs // (PAIRS * to.blocks)))
    key, on = ["case", "p"], "p"
    if to.blocks == 1:  # numbers travel instead of the findings; those without an edge keep their own
        rows = rows.join(F.broadcast(to.lists.select("p", "_id")), "p", "left").withColumn("p", F.when(F.col("_id").isNull(), F.col("p")))
        key, on = ["case", "p", "_id"], "_id"
    dealt = rows.repartition(tasks, "case")
    dealt = regroup(dealt, key) if regroup else dealt.distinct()
    out = None
    for b in range(to.blocks):
        block = to.lists.where(F.col("_b") == b).select(on, "_to")
        met = dealt.join(F.broadcast(block), on).select(*[c for c in dealt.columns if c not in key[1:]], F.explode("_to").alias("_to")).select("*", "_to.*").drop("_to")
        part = met.groupBy("case", "_d").agg(*aggregates)
        part = (best(part) if best else part).join(F.broadcast(to.names.where(F.col("_b") == b).drop("_b")), "_d").drop("_d")
        out = part if out is None else out.unionByName(part)
    return out


def dense(to: Reach) -> bool:
    return to.blocks == 1 and to.names.count() <= DENSE


def _matrices(batches, ids, start, size, ds, n, kernel, kind):
    """Batches (case, codes) to (case, fields, _to): for some cases at a time a matrix of cases and diseases; neighbours with equal fields are one row."""
    for batch in batches:
        cases, codes = batch.column(0), batch.column(1)
        lens, v = pc.list_value_length(codes).to_numpy(zero_copy_only=False), codes.flatten().to_numpy(zero_copy_only=False)
        off, at = np.concatenate([[0], np.cumsum(lens)]), np.searchsorted(ids, v >> 1)
        known = ids[np.minimum(at, len(ids) - 1)] == v >> 1 if len(ids) else np.zeros(len(v), bool)
        if not known.all():
            off, v, at = np.concatenate([[0], np.cumsum(known)])[off], v[known], at[known]
        lens, met = np.diff(off), np.concatenate([[0], np.cumsum(size[at])])
        pairs, i = met[off], 0  # before each case
        while i < len(lens):
            j = max(i + 1, min(len(lens), i + max(1, CELLS // n), int(np.searchsorted(pairs, pairs[i] + CELLS, "right")) - 1))
            a, b, m = off[i], off[j], j - i
            k, cell = size[at[a:b]], np.repeat(np.arange(m) * n, lens[i:j]) + (v[a:b] & 1) * (m * n)
            where = np.arange(pairs[j] - pairs[i]) + np.repeat(start[at[a:b]] - (met[a:b] - met[a]), k)
            no, yes = np.bincount(ds[where] + np.repeat(cell, k), minlength=2 * m * n).reshape(2, m, n)
            who, d, values = kernel(yes, no)
            new = np.ones(len(who), bool)
            new[1:] = who[1:] != who[:-1]
            for x in values:
                new[1:] |= x[1:] != x[:-1]
            first = np.flatnonzero(new)
            to = pa.ListArray.from_arrays(pa.array(np.append(first, len(who)).astype(np.int32)), pa.array((d + 1).astype(np.int32)))
            columns = [cases.slice(i, m).take(pa.array(who[first])), *[pa.array(x[first]).cast(t) for x, t in zip(values, kind.values(), strict=True)], to]
            yield pa.RecordBatch.from_arrays(columns, names=["case", *kind, "_to"])
            i = j


def by_case(rows: DataFrame, to: Reach, kernel: Callable, fields: dict[str, str], mentions: bool = False) -> DataFrame:
    """(case, d, fields) of the pairs that ``kernel`` keeps, for edges that are ``dense``, distinct and of one block.

    As in ``by_pair`` rows (case, p, yes) are dealt by case and no pair is shuffled, but a pair is a cell of a matrix of cases
    and diseases (by d, a null one first) and no row until it is kept. kernel (confirmed, denied) -> (cases in ascending
    order, diseases, values of the fields) of what it keeps. mentions: as in ``finding_counts``. Rows that are a case's list
    already (case, facts: array of (p, yes), each p once and a whole number) stay where they are."""
    listed = "facts" in rows.columns
    table = to.lists.select(F.col("p" if listed else "_id").alias("_id"), F.transform("_to._d", lambda d: d.cast("short")).alias("ds")).toArrow().sort_by("_id").combine_chunks()
    ids, lists = table["_id"].to_numpy(), table["ds"].combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    start, ds, n = np.cumsum(size) - size, lists.flatten().to_numpy(zero_copy_only=False) - 1, max(1, to.names.count())
    if listed:
        told = F.filter("facts", lambda f: f["p"].isNotNull() & f["yes"].isNotNull())
        codes = rows.select("case", F.transform(told, lambda f: f["p"] * 2 + f["yes"].cast("long")).alias("_codes"))
    else:
        known = to.lists.select("p", "_id", F.size("_to").alias("_k"))
        rows = rows.where("p IS NOT NULL").join(F.broadcast(known), "p")
        tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-(rows.agg(F.sum("_k")).first()[0] or 0) // (PAIRS << 3)))
        dealt = rows.select("case", "_id", "yes").repartition(tasks, "case")
        one = dealt.groupBy("case", "_id").agg(F.max("yes").alias("yes")) if mentions else dealt.distinct()
        codes = one.where("yes IS NOT NULL").groupBy("case").agg(F.collect_list(F.col("_id") * 2 + F.col("yes").cast("long")).alias("_codes"))
    of = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    into, kind = StructType([codes.schema["case"]]), {k: of[v] for k, v in fields.items()}
    for k, v in fields.items():
        into = into.add(k, v)
    into = into.add("_to", ArrayType(IntegerType()))
    kept = codes.mapInArrow(lambda batches: _matrices(batches, ids, start, size, ds, n, kernel, kind), into)
    x = kept.select("case", *fields, F.explode("_to").alias("_d"))
    return x.join(F.broadcast(to.names.select(F.col("_d").cast("int").alias("_d"), "d")), "_d").select("case", "d", *fields)


def most_matches(cases: DataFrame, edges: DataFrame) -> DataFrame:
    """(case, d): the disease with most matches of distinct edges, of equal ones the smallest d.

    Where diseases are too many for ``by_case``, matches and place are one number, so pairs are neither sorted nor named,
    only a case's best of each block."""

    def best(pairs: DataFrame) -> DataFrame:
        top = pairs.groupBy("case").agg(F.max(F.col("m") * F.lit(1 << 32) - F.col("_d")).alias("_top"))
        top = top.withColumn("_d", F.pmod(-F.col("_top"), F.lit(1 << 32)))
        return top.select("case", "_d", F.shiftright(F.col("_top") + F.col("_d"), 32).alias("m"))

    def most(yes, no):
        d = yes.argmax(1)
        who = np.flatnonzero(yes[np.arange(len(d)), d])
        return who, d[who], []

    to = reach(edges)
    if dense(to):
        return by_case(cases.select("case", "p", F.lit(True).alias("yes")), to, most, {})
    x = by_pair(cases.select("case", "p"), to, [F.count("*").alias("m")], best=best)
    if to.blocks > 1:
        x = x.groupBy("case").agg(F.min_by("d", F.struct((-F.col("m")).alias("m"), F.col("d"))).alias("d"))
    return x.select("case", "d")


def top_profile(edges: DataFrame, k: int = 80, weight: Column | None = None) -> DataFrame:
    """(d, p, w): the k heaviest findings of each disease; weights of parallel edges add up first."""
    total = edges.groupBy("d", "p").agg(F.sum("w").alias("w")).withColumn("w", F.col("w") if weight is None else weight)
    return total.withColumn("_r", F.row_number().over(by("d").orderBy(F.col("w").desc(), "p"))).where(F.col("_r") <= k).drop("_r")


def hill_profile(edges: DataFrame, kappa: float = 20.0, k: int = 80) -> DataFrame:
    return top_profile(edges, k, M.hill(F.col("w"), kappa))


def profile_idf(profile: DataFrame, threshold: float = 0.0, kind: str = "smooth") -> DataFrame:
    """(p, idf); only weights of at least ``threshold`` count, and findings without one have no row (idf 1)."""
    n = profile.agg(F.count_distinct("d").alias("n"))
    df = profile.where(F.col("w") >= threshold).groupBy("p").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("p", M.IDF[kind](F.col("n").cast("double"), F.col("df").cast("double")).alias("idf"))


def reweighted(profile: DataFrame, idf: DataFrame, alpha: float = 1.0, beta: float = 0.75) -> DataFrame:
    return profile.join(idf, "p", "left").select("d", "p", M.reweight(F.col("w"), F.coalesce("idf", F.lit(1.0)), alpha, beta).alias("w"))


def key_sets(profile: DataFrame, idf: DataFrame, core: int = 28, signature: int = 10) -> DataFrame:
    """(d, p, w, core, signature): marks of the findings that weigh most with their idf."""
    x = profile.join(idf, "p", "left").withColumn("_x", F.col("w") * F.coalesce("idf", F.lit(1.0)))
    r = F.row_number().over(by("d").orderBy(F.round("_x", 9).desc(), "p"))
    return x.withColumn("_r", r).select("d", "p", "w", (F.col("_r") <= core).alias("core"), (F.col("_r") <= signature).alias("signature"))


def calibrated(profile: DataFrame, how: str) -> DataFrame:
    """Weights by rank, as shares of the disease's sum, or through a sigmoid around the upper median."""
    if how == "rank":
        w = 1 - (F.row_number().over(by("d").orderBy(F.col("w").desc(), "p")) - 1) / F.count("*").over(by("d"))
    elif how == "share":
        w = F.col("w") / F.sum("w").over(by("d"))
    else:
        ws = F.sort_array(F.collect_list("w").over(by("d")))
        mid = F.element_at(ws, (F.floor(F.size(ws) / 2) + 1).cast("int"))
        w = 1 / (1 + F.exp(-(F.col("w") - mid) / F.greatest(F.lit(1.0), mid)))
    return profile.select("d", "p", w.alias("w"))


def pmi(profile: DataFrame, eps: float = 0.01) -> DataFrame:
    """(d, p, w, pmi): ln((w + eps) / (mean w over all diseases + eps))."""
    n = profile.agg(F.count_distinct("d").alias("n"))
    mean = F.sum("w").over(by("p")) / F.col("n")
    return profile.crossJoin(F.broadcast(n)).select("d", "p", "w", F.log((F.col("w") + eps) / (mean + eps)).alias("pmi"))


def specificity(profile: DataFrame) -> DataFrame:
    """(d, p, w, spec, margin): weight less the best other disease's; the best row's lead over the second."""
    order = by("p").orderBy(F.col("w").desc(), "d")
    x = profile.withColumns({"_r": F.row_number().over(order), "_next": F.lead("w").over(order), "_best": F.max("w").over(by("p"))})
    other = F.when(F.col("_r") == 1, F.coalesce("_next", F.lit(0.0))).otherwise(F.col("_best"))
    return x.select("d", "p", "w", (F.col("w") - other).alias("spec"), F.when(F.col("_r") == 1, F.col("w") - F.coalesce("_next", F.lit(0.0))).alias("margin"))


def ranked(scores: DataFrame, digits: int = 9) -> DataFrame:
    """Scores with their rank in the case; scores equal to ``digits`` places tie, the smaller d first."""
    return scores.withColumn("rank", F.row_number().over(by("case").orderBy(M.rounded(F.col("score").cast("double"), digits).desc(), "d")))


def evaluate(scores: DataFrame, truth: DataFrame, missing: int = 50, ks: Sequence[int] = (1, 3, 5, 10), digits: int = 9) -> DataFrame:
    """One row: n, hit rates at k and mean reciprocal rank of truth (case, d); a truth not listed has rank ``missing``.

    Ranks are those of ``ranked``: one more than the number of better rows of the case, counted in the case's list,
    so nothing is sorted and the scores are computed once. Cases without any score are not counted."""
    row = F.struct(F.round("score", digits).alias("s"), F.col("d"))
    lists = scores.groupBy("case").agg(F.collect_list(row).alias("_all"))
    x = lists.join(truth.select("case", F.col("d").alias("_t")).distinct(), "case")
    x = x.withColumn("_own", F.array_max(F.transform(F.filter("_all", lambda v: v["d"] == F.col("_t")), lambda v: v["s"])))
    better = F.size(F.filter("_all", lambda v: (v["s"] > F.col("_own")) | ((v["s"] == F.col("_own")) & (v["d"] < F.col("_t")))))
    r = x.select(F.when(F.col("_own").isNull(), missing).otherwise(better + 1).alias("rank"))
    hits = [F.avg((F.col("rank") <= k).cast("double")).alias(f"at_{k}") for k in ks]
    return r.agg(F.count("*").alias("n"), *hits, F.avg(1 / F.col("rank")).alias("mrr"))


def finding_counts(facts: DataFrame, edges: DataFrame | Reach, mentions: bool = False) -> DataFrame:
    """(case, d, c, x, t, total) from facts (case, p, yes): confirmed, denied, all findings of d, the case's confirmed.

    Only diseases that a confirmed finding reaches are counted. mentions: a finding that any row of the case confirms
    is confirmed, and not denied."""

    def regroup(rows: DataFrame, key: list[str]) -> DataFrame:
        one = rows.groupBy(*key).agg(F.max("yes").alias("yes")) if mentions else rows.distinct()
        return one.withColumn("total", F.count_if("yes").over(by("case")))

    to = edges if isinstance(edges, Reach) else reach(edges.select("d", "p").distinct())
    n = by_pair(facts.select("case", "p", "yes"), to, [F.count_if("yes").alias("c"), F.count_if(~F.col("yes")).alias("x"), F.max("total").alias("total")], regroup)
    return n.where("c > 0 AND d IS NOT NULL").select("case", "d", "c", "x", F.col("_n").alias("t"), "total")


def scored(counts: DataFrame, facts: DataFrame, to: Reach, score: Callable[..., dict[str, Column]], of: Sequence[str] = ("c", "x", "t", "total")) -> DataFrame:
    """(case, d, scores) of ``finding_counts`` (facts, to) by a function of its columns ``of`` alone; edges are distinct.

    Pairs outnumber the sets of counts, so the sets of cases of up to so many facts as give ``SCORES`` sets are scored
    once, in a table that is broadcast. Pairs of larger cases, if there are any, arise apart and are scored by the same
    expressions."""
    ts = to.names.select(F.col("_n").alias("t")).distinct()
    n, most = ts.count() if "t" in of else 1, facts.groupBy("case").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    held = "total" if "total" in of else "c"  # it and the denied are no more than the facts
    limit = next((k for k in range(most) if n * (k + 2) ** 2 * (k + 3 if held == "total" else 3) // 6 > SCORES), most)
    up = lambda k, lo, hi: F.explode(F.sequence(lo, hi)).alias(k)
    table = counts.sparkSession.range(limit + 1).select(F.col("id").alias("x"))
    table = table.where(F.col("x") < limit).select("*", up(held, F.lit(1).cast("long"), limit - F.col("x")))
    table = table.select("*", up("c", F.lit(1).cast("long"), F.col("total"))) if held == "total" else table
    table = table.crossJoin(F.broadcast(ts)).where("c <= t AND x <= t") if "t" in of else table
    number = F.lit(0).cast("long")
    for k in of:
        number = number * (limit + 1) + F.col(k) if k != "t" else number
    number = F.col("t") * (limit + 1) ** (len(of) - 1) + number if "t" in of else number
    values = [v.alias(k) for k, v in score(*[F.col(k) for k in of]).items()]
    table = materialize(table.select(number.alias("_k"), *values), "scores")
    small = F.col(held) + F.col("x") <= limit
    out = counts.where(small).withColumn("_k", number).join(F.broadcast(table), "_k").select("case", "d", *table.columns[1:])
    return out if limit >= most else out.unionByName(counts.where(~small).select("case", "d", *values))


def shares(scores: DataFrame) -> DataFrame:
    """Positive scores with their share of the case's sum; to be taken before any limit."""
    kept = scores.where("score > 0")
    return kept.withColumn("share", F.col("score") / F.sum("score").over(by("case")))


def weighted_sum(cases: DataFrame, edges: DataFrame) -> DataFrame:
    """Sum of the weights of the matched edges."""
    return by_pair(cases.select("case", "p"), edges.select("d", "p", "w"), [F.sum("w").alias("score")]).select("case", "d", "score")


def cosine(cases: DataFrame, profile: DataFrame, idf: DataFrame, beta: float = 0.75) -> DataFrame:
    """(case, d, score, dnorm): cosine of the case's idf^beta vector and the profile, over the profile's vocabulary."""
    vocabulary = profile.select("p").distinct()
    vec = cases.distinct().join(vocabulary, "p", "left_semi").join(idf, "p", "left").select("case", "p", F.pow(F.coalesce("idf", F.lit(1.0)), F.lit(beta)).alias("v"))
    vnorm = vec.groupBy("case").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("vnorm"))
    dnorm = profile.groupBy("d").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("dnorm"))
    dot = vec.join(profile, "p").groupBy("case", "d").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    return dot.join(vnorm, "case").join(dnorm, "d").select("case", "d", (F.col("dot") / (F.col("vnorm") * F.col("dnorm"))).alias("score"), "dnorm")


def cosine_in_place(cases: DataFrame, profile: DataFrame, idf: DataFrame, beta: float = 0.75) -> DataFrame:
    """The same as ``cosine``, for profiles of all findings, whose pairs are too many to shuffle; dealt by case."""
    v = profile.select("p").distinct().join(idf, "p", "left").select("p", F.pow(F.coalesce("idf", F.lit(1.0)), F.lit(beta)).alias("v"))
    v = materialize(v, "vocabulary")
    vec = cases.select("case", "p").join(F.broadcast(v) if v.count() <= EDGES else v, "p")
    edges = profile.withColumn("dnorm", F.sqrt(F.sum(F.col("w") ** 2).over(by("d"))))
    length = lambda rows, key: rows.distinct().withColumn("vnorm", F.sqrt(F.sum(F.col("v") ** 2).over(by("case"))))
    x = by_pair(vec, edges, [F.sum(F.col("v") * F.col("w")).alias("dot"), F.max("vnorm").alias("vnorm"), F.max("dnorm").alias("dnorm")], length)
    return x.select("case", "d", (F.col("dot") / (F.col("vnorm") * F.col("dnorm"))).alias("score"), "dnorm")


def question_signal(profile: DataFrame, questions: DataFrame, idf: DataFrame, tau: float | None = None, sharpness: float = 0.5, gamma: float = 0.0) -> DataFrame:
    """(d, q, s): how much a question (q, p) bears on a disease: the largest weight among its findings,
    times idf^gamma, and faded by self-awareness where tau is given."""
    i = F.coalesce("idf", F.lit(1.0))
    w = F.col("w") * F.pow(i, F.lit(gamma)) * (M.self_aware(i, tau, sharpness) if tau is not None else F.lit(1.0))
    return questions.join(profile, "p").join(idf, "p", "left").groupBy("d", "q").agg(F.max(w).alias("s"))


def negative_channel(scores: DataFrame, denied: DataFrame, signal: DataFrame, lam: float = 0.4) -> DataFrame:
    """Scores (with dnorm) less lam times the signal of the denied questions (case, q) over sqrt(n) dnorm."""
    asked = denied.distinct()
    n = asked.groupBy("case").agg(F.count("*").alias("_n"))
    asked = asked.join(n, "case")
    # one pass over the scored pairs: a case's questions meet its pairs on the case, so only pairs with a score are looked up
    met = scores.select("case", "d", "score", "dnorm").join(asked, "case", "left").join(signal, ["q", "d"], "left")
    pen = met.groupBy("case", "d", "score", "dnorm").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("_pen"), F.coalesce(F.max("_n"), F.lit(1)).alias("_n"))
    return pen.select("case", "d", (F.col("score") - lam * F.col("_pen") / (F.sqrt("_n") * F.col("dnorm"))).alias("score"), "dnorm")


def min_max(scores: DataFrame, column: str = "score") -> DataFrame:
    """Scaled to 0..1 in each case; a constant channel is 0.5."""
    lo, hi = F.min(column).over(by("case")), F.max(column).over(by("case"))
    return scores.withColumn(column, F.when(hi == lo, 0.5).otherwise((F.col(column) - lo) / F.nullif(hi - lo, F.lit(0.0))))


def z_scores(scores: DataFrame, column: str = "score", population: bool = False) -> DataFrame:
    sd = (F.stddev_pop if population else F.stddev_samp)(column).over(by("case"))
    return scores.withColumn(column, F.when(sd > 0, (F.col(column) - F.avg(column).over(by("case"))) / F.nullif(sd, F.lit(0.0))).otherwise(0.0))


def ensemble(parts: Sequence[tuple[DataFrame, float]], scale=min_max) -> DataFrame:
    """Weighted sum of scaled channels; a channel that lacks a pair adds nothing."""
    rows = None
    for df, weight in parts:
        part = scale(df.select("case", "d", "score")).select("case", "d", (F.col("score") * weight).alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("case", "d").agg(F.sum("score").alias("score"))


def ties(scores: DataFrame) -> DataFrame:
    """(case, d, score, n_tied) of the best, where at least two share it."""
    x = scores.withColumn("_s", M.rounded(F.col("score"), 9))
    x = x.withColumn("_b", F.max("_s").over(by("case"))).where("_s = _b").drop("_s", "_b")
    return x.withColumn("n_tied", F.count("*").over(by("case"))).where("n_tied > 1")


def cutoffs(scores: DataFrame, mass: float = 0.8) -> DataFrame:
    """Shares with marks: at least half of the best; in the shortest prefix that holds ``mass``."""
    order = by("case").orderBy(M.rounded(F.col("share"), 9).desc(), "d")
    before = F.coalesce(F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return scores.withColumns({"top_half": F.col("share") >= F.max("share").over(by("case")) / 2, "in_mass": M.rounded(before, 9) < mass})


def count_cutoffs(facts: DataFrame, to: Reach, score: Callable, mass: float = 0.8, mentions: bool = False) -> DataFrame:
    """``cutoffs`` of the ``shares`` of score (c, x), of Columns or arrays alike, by ``finding_counts`` (facts, to, mentions).

    facts may be lists, as in ``by_case``; then the pairs of a case come by share, so that equal ones stand together."""
    if not dense(to):
        n = finding_counts(facts.select("case", F.inline("facts")) if "facts" in facts.columns else facts, to, mentions)
        return cutoffs(shares(n.select("case", "d", score(F.col("c"), F.col("x")).alias("score"))).select("case", "d", "share"), mass)
    unnamed = to.names.where("d IS NULL").count()  # the first column, if any

    def cut(yes, no):
        yes[:, :unnamed] = 0
        s = np.where(yes > 0, score(yes, no), 0.0)
        s[s < 0] = 0.0
        share = s / np.maximum(s.sum(1, keepdims=True), 5e-324)
        bits = share.shape[1].bit_length()
        order = np.sort(((1 << 30) - np.rint(M.rounded_array(share, 9) * 1e9).astype(np.int64) << bits) + np.arange(share.shape[1])) & (1 << bits) - 1
        held = np.take_along_axis(share, order, 1)
        before = np.zeros_like(share)
        before[:, 1:] = np.cumsum(held, axis=1)[:, :-1]
        who, k = np.nonzero(np.take_along_axis(s, order, 1))
        held, before, best = held[who, k], before[who, k], share.max(1)[who]
        return who, order[who, k], [held, held >= best / 2, M.rounded_array(before, 9) < mass]

    return by_case(facts if "facts" in facts.columns else facts.select("case", "p", "yes"), to, cut, {"share": "double", "top_half": "boolean", "in_mass": "boolean"}, mentions)


def min_match(scores: DataFrame, matches: Column, k: int, keep: Column | None = None) -> DataFrame:
    """Pairs with fewer than k matches go last, with -1e6, but stay."""
    weak = (matches < k) if keep is None else (matches < k) & ~keep
    return scores.withColumn("score", F.when(weak, -1e6).otherwise(F.col("score")))


def naive_bayes(cases: DataFrame, profile: DataFrame, floor: float = 1e-3) -> DataFrame:
    """Sum over all findings of ln p (present) or ln(1 - p) (absent), without a dense grid: the sum for
    an empty case, plus the difference for what is present. Findings outside a profile have p = floor."""
    p = F.least(F.greatest(F.col("w"), F.lit(floor)), F.lit(1 - floor))
    base = profile.groupBy("d").agg(F.sum(F.log(1 - p)).alias("base"), F.count("*").alias("k"))
    vocabulary = profile.select("p").distinct()
    size = vocabulary.agg(F.count("*").alias("v"))
    off = float(M.math.log(1 - floor))
    base = base.crossJoin(F.broadcast(size)).select("d", (F.col("base") + (F.col("v") - F.col("k")) * off).alias("base"))
    known = cases.distinct().join(vocabulary, "p", "left_semi")
    n = known.groupBy("case").agg(F.count("*").alias("n"))
    lift = known.join(profile, "p").groupBy("case", "d").agg(F.sum(F.log(p) - F.log(1 - p)).alias("lift"), F.count("*").alias("m"))
    other = float(M.math.log(floor) - M.math.log(1 - floor))
    return lift.join(n, "case").join(base, "d").select("case", "d", (F.col("base") + F.col("lift") + (F.col("n") - F.col("m")) * other).alias("score"))


def bayes_by_evidence(cases: DataFrame, denied: DataFrame, profile: DataFrame, s: float = 0.05, neg: float = 0.5) -> DataFrame:
    """Log-likelihood ratios against the marginal over diseases: w maps linearly to p in [s, 1 - s]."""
    n = profile.agg(F.count_distinct("d").alias("n"))
    p = s + F.col("w") / F.max("w").over(by("d")) * (1 - 2 * s)
    prob = profile.select("d", "p", p.alias("pr"))
    marginal = profile.where("w > 0.1").groupBy("p").agg(F.count("*").alias("k")).crossJoin(F.broadcast(n)).select("p", ((F.col("k") + s) / (F.col("n") + 2 * s)).alias("m"))
    both = prob.join(marginal, "p")
    part = lambda rows, x: rows.distinct().join(both, "p").select("case", "d", x.alias("x"))
    yes, no = part(cases, F.log(F.col("pr") / F.col("m"))), part(denied, neg * F.log((1 - F.col("pr")) / (1 - F.col("m"))))
    return yes.unionByName(no).groupBy("case", "d").agg(F.sum("x").alias("score"))


def rerank(scores: DataFrame, cases: DataFrame, profile: DataFrame, idf: DataFrame, k: int = 20, weight: float = 0.3) -> DataFrame:
    """The k best, their score scaled in the shortlist, plus the sum of their three rarest matches' idf, scaled too."""
    short = ranked(scores).where(F.col("rank") <= k).select("case", "d", "score")
    hits = short.select("case", "d").join(cases.distinct(), "case").join(profile.select("d", "p"), ["d", "p"]).join(idf, "p", "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    three = hits.withColumn("_r", F.row_number().over(by("case", "d").orderBy(F.col("idf").desc(), "p"))).where("_r <= 3").groupBy("case", "d").agg(F.sum("idf").alias("spec"))
    x = min_max(min_max(short.join(three, ["case", "d"], "left").withColumn("spec", F.coalesce("spec", F.lit(0.0))), "spec"))
    return x.select("case", "d", (F.col("score") + weight * F.col("spec")).alias("score"))


def overlap_tie_break(scores: DataFrame, features: DataFrame, texts: DataFrame) -> DataFrame:
    """Among tied best diseases, the number of their feature names (d, name) that the case's text (case, text) holds."""
    tied = ties(scores)
    hit = F.sum(F.col("text").contains(F.col("name")).cast("long"))
    return tied.join(features, "d").join(texts, "case").groupBy("case", "d").agg(hit.alias("overlap"))


def confuser_gap(scores: DataFrame, cases: DataFrame, profile: DataFrame, gamma: float = 0.1) -> DataFrame:
    """For the two best diseases of a case, add gamma times what each explains better than the other."""
    two = ranked(scores).where("rank <= 2").select("case", "d", "score")
    w = two.select("case", "d").join(cases.distinct(), "case").join(profile, ["d", "p"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    other = w.select("case", F.col("d").alias("e"), "p", F.col("w").alias("v"))
    gap = w.join(other, ["case", "p"]).where("d <> e").groupBy("case", "d").agg(F.sum(F.greatest(F.lit(0.0), F.col("w") - F.col("v"))).alias("gap"))
    return two.join(gap, ["case", "d"], "left").select("case", "d", (F.col("score") + gamma * F.coalesce("gap", F.lit(0.0))).alias("score"))


def q_aware(cases: DataFrame, marks: DataFrame, alpha: float = 0.3, sig_w: float = 0.5, boost: float = 1.0) -> DataFrame:
    """(matched weight - alpha missing core weight) / sqrt(all weight) + signature share + identity boost; and coverage."""
    d = marks.groupBy("d").agg(F.sum("w").alias("all_w"), F.sum(F.when(F.col("core"), F.col("w")).otherwise(0.0)).alias("core_w"), F.count_if("signature").alias("n_sig"))
    n = cases.distinct().groupBy("case").agg(F.count("*").alias("n"))
    hit = cases.distinct().join(marks, "p").groupBy("case", "d").agg(
        F.sum("w").alias("w"), F.sum(F.when(F.col("core"), F.col("w")).otherwise(0.0)).alias("core_hit"), F.count_if("signature").alias("sig_hit"), F.count("*").alias("m")
    )
    same = cases.distinct().select("case", F.col("p").cast("string").alias("d")).withColumn("_id", F.lit(boost))
    x = hit.join(d, "d").join(n, "case").withColumn("d", F.col("d").cast("string")).join(same, ["case", "d"], "left")
    s1 = (F.col("w") - alpha * (F.col("core_w") - F.col("core_hit"))) / F.sqrt("all_w") + sig_w * F.col("sig_hit") / F.greatest("n_sig", F.lit(1)) + F.coalesce("_id", F.lit(0.0))
    return x.select("case", "d", s1.alias("score"), (F.col("m") / F.col("n")).alias("coverage"))


def nb_counts(cases: DataFrame, truth: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(d, p, prob): Laplace-smoothed share of a disease's cases that have the finding; pairs never seen are not listed."""
    n = truth.groupBy("d").agg(F.count_distinct("case").alias("n"))
    k = cases.distinct().join(truth, "case").groupBy("d", "p").agg(F.count("*").alias("k"))
    return k.join(n, "d").select("d", "p", ((F.col("k") + alpha) / (F.col("n") + 2 * alpha)).alias("prob"))


def few_shot(truth: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """At most n cases of each disease, drawn by a hash of the case."""
    key = F.md5(F.concat_ws(":", F.col("case").cast("string"), F.lit(str(seed))))
    return truth.withColumn("_r", F.row_number().over(by("d").orderBy(key, "case"))).where(F.col("_r") <= n).drop("_r")


def decade_prior(people: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """(d, decade, sex, prior) from (d, age, sex): share of the disease's people, decades above 80 together."""
    x = people.withColumn("decade", F.least(F.floor(F.col("age") / 10) * 10, F.lit(80)))
    k = x.groupBy("d", "decade", "sex").agg(F.count("*").alias("k"))
    cells = x.select("decade", "sex").distinct().agg(F.count("*").alias("cells"))
    return k.withColumn("n", F.sum("k").over(by("d"))).crossJoin(F.broadcast(cells)).select("d", "decade", "sex", ((F.col("k") + smoothing) / (F.col("n") + smoothing * F.col("cells"))).alias("prior"))


def subset_ablation(contributions: DataFrame, channels: Sequence[str], truth: DataFrame) -> DataFrame:
    """Hit rate at 1 for every non-empty subset of channels, from one table (case, d, channel, x)."""
    subsets = [(m, ",".join(c for i, c in enumerate(channels) if m >> i & 1)) for m in range(1, 1 << len(channels))]
    table = contributions.sparkSession.createDataFrame([(s, c) for _, s in subsets for c in s.split(",")], "subset string, channel string")
    total = contributions.join(F.broadcast(table), "channel").groupBy("subset", "case", "d").agg(F.round(F.sum("x"), 9).alias("score"))
    best = total.groupBy("subset", "case").agg(F.min_by("d", F.struct((-F.col("score")).alias("s"), F.col("d"))).alias("top"))
    return best.join(truth, "case").groupBy("subset").agg(F.avg((F.col("top") == F.col("d")).cast("double")).alias("at_1"), F.count("*").alias("n"))


def leave_one_out(contributions: DataFrame, channels: Sequence[str], truth: DataFrame) -> DataFrame:
    """(left_out, at_1, change, n): the hit rate at 1 without each channel, and with all ("none")."""
    sets = [("none", list(channels)), *[(c, [x for x in channels if x != c]) for c in channels]]
    table = contributions.sparkSession.createDataFrame([(name, c) for name, cs in sets for c in cs], "left_out string, channel string")
    total = contributions.join(F.broadcast(table), "channel").groupBy("left_out", "case", "d").agg(F.round(F.sum("x"), 9).alias("score"))
    best = total.groupBy("left_out", "case").agg(F.min_by("d", F.struct((-F.col("score")).alias("s"), F.col("d"))).alias("top"))
    hits = best.join(truth, "case").groupBy("left_out").agg(F.avg((F.col("top") == F.col("d")).cast("double")).alias("at_1"), F.count("*").alias("n"))
    base = hits.where("left_out = 'none'").select(F.col("at_1").alias("_all"))
    return hits.crossJoin(F.broadcast(base)).select("left_out", "at_1", (F.round("at_1", 6) - F.round("_all", 6)).alias("change"), "n")


def extrinsic(findings: DataFrame, names: DataFrame, cases: DataFrame, truth: DataFrame, variants: Sequence[str], threshold: float = 0.12, beta: float = 0.75) -> DataFrame:
    """One row a variant of extraction: (variant, findings, concepts, n, at_1, at_3, at_5, at_10, mrr) of one fixed diagnosis.

    findings (variant, d, finding) are linked by names (name, p), any case and outer blanks aside; a linked pair
    weighs 1, its idf discriminates. A case counts if it has a finding of the profile and its disease a profile;
    a disease that shares nothing with the case comes after all others."""
    key = lambda c: F.trim(F.lower(c))
    link = names.select(key("name").alias("_k"), "p").distinct()
    found = findings.groupBy("variant", "d", key("finding").alias("_k")).agg(F.count("*").alias("n"))
    linked = materialize(found.join(link, "_k").where("d <> p").select("variant", "d", "p", "n"), "linked")
    out = None
    for v in variants:
        rows = linked.where(F.col("variant") == v)
        base = materialize(rows.select("d", "p", F.lit(1.0).alias("w")).distinct(), "profile")
        diseases = materialize(base.select("d").distinct(), "diseases")
        idf = profile_idf(base, threshold)
        scores = cosine_in_place(cases, materialize(reweighted(base, idf, 1.0, beta), "weights"), idf, beta)
        result = evaluate(scores, truth.join(diseases, "d", "left_semi"), diseases.count())
        part = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), F.count_distinct("p").alias("concepts")).crossJoin(result).select(F.lit(v).alias("variant"), "*")  # one row each
        out = part if out is None else out.unionByName(part)
    return out

"""One query for each operator, over the driver's tables, beside the SQL that must give the same."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.functions import formulas as M
from lattiq.functions import text as X
from lattiq.operators import attributes, channels, dialogue, evidence, graph, linking, metrics, ranking, reports
from lattiq.plans import bindings as B
from lattiq.plans.bindings import t
from lattiq.shared import fresh_path, materialize
from lattiq.sources import readers, stores
from lattiq.streaming import sessions

#: Queries that use the joined mentions more than once.
SHARED = {
    "cosine_scores", "cosine_evaluation", "negative_evidence", "negative_evidence_idf", "negative_self_aware", "finding_counts", "count_score_family", "corrected_score_family", "clamped_score_family",
    "normalised_scores", "top_k_diagnoses", "min_match_filter", "tied_diagnoses", "weighted_edge_scores", "min_max_channel", "z_score_channel", "kg_naive_bayes", "channel_ensemble", "zero_shot_bayes",
    "supervised_nb_counts", "few_shot_profile", "rerank_shortlist", "confuser_rerank", "question_aware_stack", "two_hop_candidates", "denied_limit_candidates", "greedy_selection", "information_gain", "related_diseases",
    "reference_baselines", "question_rounds", "random_inquiry", "differential_macro", "bound_attributes", "attribute_aware_scores",
}

#: The columns of the mentions that these use; the others share all.
COLUMNS = dict.fromkeys(
    ("finding_counts", "count_score_family", "corrected_score_family", "clamped_score_family", "normalised_scores", "top_k_diagnoses", "min_match_filter", "tied_diagnoses", "weighted_edge_scores", "differential_macro"),
    ("case", "d", "p", "source", "l_returnflag"),
) | {"reference_baselines": ("case", "d", "p")} | dict.fromkeys(("bound_attributes", "attribute_aware_scores"), ("case", "d", "p_brand", "p_type"))

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        @wraps(f)
        def run(s, sf):
            if f.__name__ not in SHARED:
                return f(s, sf)
            with B.shared_mentions(COLUMNS.get(f.__name__, ())):
                return f(s, sf)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits).alias(c if isinstance(c, str) else "x")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def rounded_score(df: DataFrame) -> DataFrame:
    """For many rows."""
    return df.withColumn("score", M.rounded(F.col("score")))


RANKED = """rk AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY round(score, 9) DESC, d) AS rank FROM {s})"""
EVAL = """SELECT count(*) AS n, round(avg(CAST(rank <= 1 AS INT)), 6) AS at_1, round(avg(CAST(rank <= 3 AS INT)), 6) AS at_3, round(avg(CAST(rank <= 5 AS INT)), 6) AS at_5, round(avg(CAST(rank <= 10 AS INT)), 6) AS at_10, round(avg(1.0 / rank), 6) AS mrr
FROM (SELECT tr."case", coalesce(rk.rank, 50) AS rank FROM tr LEFT JOIN rk ON rk."case" = tr."case" AND rk.d = tr.d WHERE tr."case" IN (SELECT "case" FROM {s}))"""


def evaluated(scores: DataFrame, truth: DataFrame) -> DataFrame:
    return rounded(ranking.evaluate(scores, truth), "at_1", "at_3", "at_5", "at_10", "mrr")


# ---------------------------------------------------------------- profiles, cosine, negatives


@query(f"WITH {B.E} SELECT d, p, freq, n_sources, round(w, 6) AS w FROM e")
def edge_weights(s: SparkSession, sf: str):
    return rounded(B.edges(s, sf), "w")


@query(f"WITH {B.P} SELECT d, p, round(w, 6) AS w FROM pf")
def hill_profile(s, sf):
    return rounded(B.profile(s, sf), "w")


def _idf(kind, sql):
    def f(s, sf):
        return rounded(ranking.profile_idf(B.edges(s, sf).select("d", "p", "w"), 1.0, kind), "idf")

    f.__name__ = f"idf_{kind}"
    query(f"WITH {B.E}, k AS (SELECT p, count(*) AS df FROM e WHERE w >= 1.0 GROUP BY p) SELECT p, round(CAST({sql} AS DOUBLE), 6) AS idf FROM k, nd")(f)


for _k, _q in (("smooth", "ln((n + 1.0) / (df + 1.0)) + 1"), ("plain", "ln(n / df)"), ("plus_df", "ln(n / (df + 1.0)) + 1"), ("plus_one", "ln(n / df + 1.0)"), ("floor", "greatest(0.1, ln(n / df))")):
    _idf(_k, _q)


@query(f"WITH {B.P}, x AS (SELECT d, p, w, row_number() OVER (PARTITION BY d ORDER BY round(w * idf, 9) DESC, p) AS r FROM pf JOIN ix USING (p)) SELECT d, p, round(w, 6) AS w, r <= 28 AS core, r <= 10 AS signature FROM x")
def core_and_signature(s, sf):
    pf = B.profile(s, sf)
    return rounded(ranking.key_sets(pf, ranking.profile_idf(pf)), "w")


@query(f"WITH {B.P} SELECT d, p, round(pow(w, 1.0) * pow(idf, 0.75), 6) AS w FROM pf JOIN ix USING (p)")
def reweighted_profile(s, sf):
    pf = B.profile(s, sf)
    return rounded(ranking.reweighted(pf, ranking.profile_idf(pf)), "w")


@query(f"WITH {B.P} SELECT d, p, round(1 - (row_number() OVER (PARTITION BY d ORDER BY w DESC, p) - 1) / count(*) OVER (PARTITION BY d), 6) AS w FROM pf")
def calibrate_rank(s, sf):
    return rounded(ranking.calibrated(B.profile(s, sf), "rank"), "w")


@query(f"WITH {B.P} SELECT d, p, round(w / sum(w) OVER (PARTITION BY d), 6) AS w FROM pf")
def calibrate_share(s, sf):
    return rounded(ranking.calibrated(B.profile(s, sf), "share"), "w")


@query(f"WITH {B.P}, md AS (SELECT d, list(w ORDER BY w)[len(list(w)) // 2 + 1] AS mid FROM pf GROUP BY d) SELECT d, p, round(1 / (1 + exp(-(w - mid) / greatest(1.0, mid))), 6) AS w FROM pf JOIN md USING (d)")
def calibrate_sigmoid(s, sf):
    return rounded(ranking.calibrated(B.profile(s, sf), "sigmoid"), "w")


@query(f"WITH {B.P} SELECT d, p, round(w, 6) AS w, round(ln((w + 0.01) / (sum(w) OVER (PARTITION BY p) / n + 0.01)), 6) AS pmi FROM pf, nd")
def pmi_profile(s, sf):
    return rounded(ranking.pmi(B.profile(s, sf)), "w", "pmi")


@query(f"""WITH {B.P}, x AS (SELECT *, row_number() OVER o AS r, lead(w) OVER o AS nx, max(w) OVER (PARTITION BY p) AS best FROM pf WINDOW o AS (PARTITION BY p ORDER BY w DESC, d))
SELECT d, p, round(w, 6) AS w, round(w - CASE WHEN r = 1 THEN coalesce(nx, 0) ELSE best END, 6) AS spec, round(CASE WHEN r = 1 THEN w - coalesce(nx, 0) END, 6) AS margin FROM x""")
def specificity_margin(s, sf):
    return rounded(ranking.specificity(B.profile(s, sf)), "w", "spec", "margin")


def _cos(s, sf):
    pf = materialize(B.profile(s, sf), "profile")
    idf = materialize(ranking.profile_idf(pf), "idf")
    return pf, idf, ranking.cosine(B.cases(s, sf), pf, idf)


@query(f"WITH {B.P}{B.C}{B.COS} SELECT \"case\", d, round(score, 6) AS score FROM cs")
def cosine_scores(s, sf):
    return rounded(_cos(s, sf)[2].select("case", "d", "score"), "score")


@query(f"WITH {B.P}{B.C}{B.COS}, {RANKED.format(s='cs')} {EVAL.format(s='cs')}")
def cosine_evaluation(s, sf):
    return evaluated(_cos(s, sf)[2], B.truth(s, sf))


NEG = """, dq AS (SELECT DISTINCT "case", p_brand AS q FROM m WHERE l_returnflag = 'R'), qs AS (SELECT DISTINCT p_brand AS q, p_brand || '|' || p_type || '|' || p_name AS p FROM part),
sg AS (SELECT d, q, max(w * pow(idf, {gamma}) * {fade}) AS s FROM qs JOIN pf USING (p) JOIN ix USING (p) GROUP BY d, q), nq AS (SELECT "case", count(*) AS nn FROM dq GROUP BY "case"),
pn AS (SELECT "case", d, sum(s) AS pen FROM dq JOIN sg USING (q) GROUP BY "case", d),
ng AS (SELECT "case", d, score - 0.4 * coalesce(pen, 0) / (sqrt(greatest(coalesce(nn, 1), 1)) * dnorm) AS score FROM cs LEFT JOIN pn USING ("case", d) LEFT JOIN nq USING ("case"))"""


def _negative(name, fade, gamma, **kw):
    def f(s, sf):
        pf, idf, cos = _cos(s, sf)
        signal = ranking.question_signal(pf, B.questions(s, sf), idf, gamma=gamma, **kw)
        return evaluated(ranking.negative_channel(cos, B.denied_questions(s, sf), signal), B.truth(s, sf))

    f.__name__ = name
    query(f"WITH {B.P}{B.C}{B.COS}{NEG.format(fade=fade, gamma=gamma)}, {RANKED.format(s='ng')} {EVAL.format(s='ng')}")(f)


_negative("negative_evidence", "1.0", 0.0)
_negative("negative_evidence_idf", "1.0", 0.5)
_negative("negative_self_aware", "(1 / (1 + exp((idf - 4.0) / 0.5)))", 0.0, tau=4.0)


# ---------------------------------------------------------------- count scores

CNT = """, e1 AS (SELECT DISTINCT d, p FROM e), tt AS (SELECT d, count(*) AS t FROM e1 GROUP BY d), tot AS (SELECT "case", count(*) AS total FROM fa WHERE yes GROUP BY "case"),
cn AS (SELECT "case", d, count(*) FILTER (WHERE yes) AS c, count(*) FILTER (WHERE NOT yes) AS x FROM fa JOIN e1 USING (p) GROUP BY "case", d),
ct AS (SELECT "case", d, c, x, t, total FROM cn JOIN tt USING (d) JOIN tot USING ("case") WHERE c > 0)"""


def _reach(s, sf):
    return ranking.reach(B.mentions(s, sf).select("d", "p").distinct())


def _counts(s, sf, to=None):
    return ranking.finding_counts(B.mention_facts(s, sf), to or _reach(s, sf), mentions=True)


def _family(s, sf, formulas, of):
    to = _reach(s, sf)
    return ranking.scored(_counts(s, sf, to), B.mention_facts(s, sf), to, lambda *v: {k: F.round(x, 6) for k, x in formulas(*v).items()}, of)


@query(f"WITH {B.E}{B.C}{CNT} SELECT \"case\", d, c, x, t, total FROM ct")
def finding_counts(s, sf):
    return _counts(s, sf)


_V = {
    "v4": "c/(t+0.1)*c/(total+0.1)*pow(1-x/t,2)", "v5": "c/(t+0.1)*c/(total+0.1)*(1-0.3*x/t)", "v6": "c/(t+0.1)*c/(total+0.1)", "v7": "c-0.5*x", "v8": "c*c/((t+1.0)*(total+1))*(1-x/(t+1.0))", "v9": "ln(c+1)-0.5*ln(x+1)",
    "v10": "c/(t+0.1)*(1-x/(t+0.1))", "v11": "c*(1-0.1*x)", "v12": "sqrt(c)*(1-0.2*x/(t+1))", "v13": "sqrt(c/(t+0.1))*sqrt(c/(total+0.1))*(1-0.3*x/(t+1))", "v15": "c/(c+x+1.0)*c", "v16": "c*c/(c+x+1.0)", "v17": "c-0.3*x",
    "v18": "c/(t+1.0)*c", "v19": "c*(1-x/(t+1.0))", "v20": "ln(c+1)/ln(x+2)", "v21": "c*c/(c+0.5*x+1)", "v22": "c/sqrt(x+1)", "v23": "c/(t+1.0)*c*(1-0.1*x/(t+1))", "v24": "c/(t+1.0)*c*(1-0.2*x/(t+1))", "v25": "c/(t+1.0)*c-0.05*x",
    "v26": "c*c/(t+0.3*x+1)", "v27": "c/(t+1.0)*c/(c+x+1.0)*c",
}


@query(f"WITH {B.E}{B.C}{CNT} SELECT \"case\", d, {', '.join(f'round(CAST({q} AS DOUBLE), 6) AS {k}' for k, q in _V.items())} FROM ct")
def count_score_family(s, sf):
    return _family(s, sf, M.count_scores, ("c", "x", "t", "total"))


_PART = "CASE WHEN {k} > 0 THEN {k} * ln(({k} / t) / ({k} / 223.0)) ELSE 0 END"


@query(f"""WITH {B.E}{B.C}{CNT} SELECT "case", d, round(c * ln(0.8 / 0.1) + x * ln(0.2 / 0.9), 6) AS nb,
round(c * 2.2 / (c + 1.2 * (1 - 0.75 + 0.75 * t / 18.1)) * ln(1 + (2000 - t + 0.5) / (t + 0.5)) * (1 - 0.5 * x / (c + x)), 6) AS bm25, round({_PART.format(k='c')} + {_PART.format(k='x')}, 6) AS llr,
round(c * ln(1 + (2000 - t + 0.5) / (t + 0.5)) * (1 - 0.3 * x / (c + x)), 6) AS idf, round(c * ln(0.715 / 0.05) + x * ln(0.285 / 0.95), 6) AS noisy_or FROM ct""")
def corrected_score_family(s, sf):
    return _family(s, sf, lambda c, x, t: M.corrected_scores(c, x, t, n=2000.0), ("c", "x", "t"))


@query(f"""WITH {B.E}{B.C}{CNT} SELECT "case", d, round(greatest(0.0, c / (c + x + t - c)), 6) AS jaccard, round(greatest(0.0, c / t * ln(125.0 / (1 + c))), 6) AS tfidf, round(greatest(0.0, c / (sqrt(t) * sqrt(c + x + 0.01))), 6) AS cosine,
round(greatest(0.0, c * 2.2 / (c + 1.2 * (0.25 + 0.75 * t / (2000.0 / 125.0))) - 0.1 * x), 6) AS bm25, round(greatest(0.0, c * ln(greatest(c / t, 0.01)) + x * ln(greatest(1 - c / t, 0.01))), 6) AS nb FROM ct""")
def clamped_score_family(s, sf):
    return _family(s, sf, lambda c, x, t: M.clamped_scores(c, x, t, 125.0, 2000.0), ("c", "x", "t"))


V15 = ", sc AS (SELECT \"case\", d, c * c / (c + x + 1.0) AS score, c FROM ct)"


def _v15(s, sf):
    n = _counts(s, sf)
    return n.select("case", "d", M.count_scores(F.col("c"), F.col("x"), F.col("t"), F.col("total"))["v16"].alias("score"), "c")


@query(f"WITH {B.E}{B.C}{CNT}{V15} SELECT \"case\", d, round(ln(score / sum(score) OVER (PARTITION BY \"case\")), 6) AS log_share FROM sc WHERE score > 0")
def normalised_scores(s, sf):
    return ranking.shares(_v15(s, sf)).select("case", "d", M.rounded(F.log("share")).alias("log_share"))


@query(f"WITH {B.E}{B.C}{CNT}{V15}, {RANKED.format(s='sc')} SELECT \"case\", d, round(score, 6) AS score, rank FROM rk WHERE rank <= 5")
def top_k_diagnoses(s, sf):
    return rounded_score(ranking.ranked(_v15(s, sf)).where("rank <= 5")).select("case", "d", "score", "rank")


@query(f"""WITH {B.E}{B.C}{CNT}{V15}, sh AS (SELECT "case", d, score / sum(score) OVER (PARTITION BY "case") AS share FROM sc WHERE score > 0)
SELECT "case", d, round(ln(share), 6) AS log_share, share >= max(share) OVER (PARTITION BY "case") / 2 AS top_half, round(coalesce(sum(share) OVER (PARTITION BY "case" ORDER BY round(share, 9) DESC, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) < 0.8 AS in_mass FROM sh""")
def score_cutoffs(s, sf):
    facts, pairs = B.listed_facts(s, sf)
    x = ranking.count_cutoffs(facts, ranking.reach(pairs, matrix=True), lambda c, x: c * c / (c + x + 1.0), mentions=True)
    return x.withColumn("log_share", M.rounded(F.log("share"))).drop("share")


@query(f"WITH {B.E}{B.C}{CNT}{V15} SELECT \"case\", d, round(CASE WHEN c < 2 THEN -1e6 ELSE score END, 6) AS score FROM sc")
def min_match_filter(s, sf):
    return rounded_score(ranking.min_match(_v15(s, sf), F.col("c"), 2)).select("case", "d", "score")


@query(f"WITH {B.E}{B.C}{CNT}{V15}, b AS (SELECT *, round(score, 9) = max(round(score, 9)) OVER (PARTITION BY \"case\") AS top FROM sc), q AS (SELECT \"case\", d, score, count(*) OVER (PARTITION BY \"case\") AS n_tied FROM b WHERE top) SELECT \"case\", d, round(score, 6) AS score, n_tied FROM q WHERE n_tied > 1")
def tied_diagnoses(s, sf):
    return rounded_score(ranking.ties(_v15(s, sf).select("case", "d", "score")))


@query(f"WITH {B.E}{B.C} SELECT \"case\", d, round(sum(w), 6) AS score FROM c JOIN e USING (p) GROUP BY \"case\", d")
def weighted_edge_scores(s, sf):
    return rounded_score(ranking.weighted_sum(B.mentions(s, sf), B.edges(s, sf)))


MM = "CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 0.5 ELSE ({c} - min({c}) OVER w) / nullif(max({c}) OVER w - min({c}) OVER w, 0) END"


@query(f"WITH {B.P}{B.C}{B.COS} SELECT \"case\", d, round({MM.format(c='score')}, 6) AS score FROM cs WINDOW w AS (PARTITION BY \"case\")")
def min_max_channel(s, sf):
    return rounded(ranking.min_max(_cos(s, sf)[2].select("case", "d", "score")), "score")


@query(f"WITH {B.P}{B.C}{B.COS} SELECT \"case\", d, round(CASE WHEN stddev_pop(score) OVER w > 1e-12 THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w ELSE 0 END, 5) AS score FROM cs WINDOW w AS (PARTITION BY \"case\")")
def z_score_channel(s, sf):
    x = _cos(s, sf)[2].select("case", "d", "score")
    w = Window.partitionBy("case")
    z = ranking.z_scores(x.withColumn("flat", F.stddev_pop("score").over(w) <= 1e-12), population=True)
    return z.select("case", "d", F.round(F.when(F.col("flat"), 0.0).otherwise(F.col("score")), 5).alias("score"))


_NB = """, kb AS (SELECT d, sum(ln(1 - least(greatest(w, 0.001), 0.999))) AS base, count(*) AS k FROM pf GROUP BY d), vv AS (SELECT count(DISTINCT p) AS vn FROM pf), cv AS (SELECT * FROM c WHERE p IN (SELECT p FROM pf)), cvn AS (SELECT "case", count(*) AS n FROM cv GROUP BY "case"),
nb AS (SELECT "case", d, sum(ln(least(greatest(w, 0.001), 0.999)) - ln(1 - least(greatest(w, 0.001), 0.999))) AS lift, count(*) AS mm FROM cv JOIN pf USING (p) GROUP BY "case", d),
nbs AS (SELECT "case", d, base + (vn - k) * ln(0.999) + lift + (cvn.n - mm) * (ln(0.001) - ln(0.999)) AS score FROM nb JOIN kb USING (d) JOIN cvn USING ("case"), vv)"""


@query(f"WITH {B.P}{B.C}{_NB} SELECT \"case\", d, round(score, 5) AS score FROM nbs")
def kg_naive_bayes(s, sf):
    return ranking.naive_bayes(B.cases(s, sf), B.profile(s, sf)).withColumn("score", F.round("score", 5))


@query(f"""WITH {B.P}{B.C}{B.COS}{_NB}, a AS (SELECT "case", d, 0.6 * ({MM.format(c='score')}) AS score FROM cs WINDOW w AS (PARTITION BY "case")), b AS (SELECT "case", d, 0.4 * ({MM.format(c='score')}) AS score FROM nbs WINDOW w AS (PARTITION BY "case"))
SELECT "case", d, round(sum(score), 5) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY "case", d""")
def channel_ensemble(s, sf):
    pf, _, cos = _cos(s, sf)
    return ranking.ensemble([(cos, 0.6), (ranking.naive_bayes(B.cases(s, sf), pf), 0.4)]).withColumn("score", F.round("score", 5))


@query(f"""WITH {B.P}{B.C}, pb AS (SELECT d, p, 0.05 + w / max(w) OVER (PARTITION BY d) * 0.9 AS pr FROM pf), mg AS (SELECT p, (count(*) + 0.05) / (any_value(n) + 0.1) AS mp FROM pf, nd WHERE w > 0.1 GROUP BY p), bt AS (SELECT d, p, pr, mp FROM pb JOIN mg USING (p)),
al AS (SELECT "case", d, ln(pr / mp) AS x FROM fa JOIN bt USING (p) WHERE yes UNION ALL SELECT "case", d, 0.5 * ln((1 - pr) / (1 - mp)) FROM fa JOIN bt USING (p) WHERE NOT yes) SELECT "case", d, round(sum(x), 5) AS score FROM al WHERE x IS NOT NULL GROUP BY "case", d""")
def zero_shot_bayes(s, sf):
    f = B.facts(s, sf)
    part = lambda y: f.where(F.col("yes") == y).select("case", "p")
    out = ranking.bayes_by_evidence(part(True), part(False), materialize(B.profile(s, sf), "profile"))
    return out.where("score IS NOT NULL").withColumn("score", F.round("score", 5))


@query(f"WITH {B.M}{B.C}, n AS (SELECT d, count(DISTINCT \"case\") AS n FROM tr GROUP BY d) SELECT d, p, round((count(*) + 1.0) / (any_value(n) + 2.0), 6) AS prob FROM c JOIN tr USING (\"case\") JOIN n USING (d) GROUP BY d, p")
def supervised_nb_counts(s, sf):
    return rounded(ranking.nb_counts(B.cases(s, sf), B.truth(s, sf)), "prob")


@query(f"WITH {B.M}{B.C}, f AS (SELECT \"case\", d FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY md5(\"case\" || ':42'), \"case\") AS r FROM tr) WHERE r <= 5), n AS (SELECT d, count(*) AS n FROM f GROUP BY d) SELECT d, p, round((count(*) + 1.0) / (any_value(n) + 2.0), 6) AS prob FROM c JOIN f USING (\"case\") JOIN n USING (d) GROUP BY d, p")
def few_shot_profile(s, sf):
    return rounded(ranking.nb_counts(B.cases(s, sf), ranking.few_shot(B.truth(s, sf), 5)), "prob")


@query("""WITH x AS (SELECT c_nationkey AS d, least(floor(abs(c_acctbal) / 100) * 10, 80) AS decade, c_mktsegment AS sex FROM customer), n AS (SELECT count(*) AS cells FROM (SELECT DISTINCT decade, sex FROM x)), k AS (SELECT d, decade, sex, count(*) AS k FROM x GROUP BY ALL)
SELECT d, CAST(decade AS BIGINT) AS decade, sex, round((k + 1.0) / (sum(k) OVER (PARTITION BY d) + cells), 6) AS prior FROM k, n""")
def demographic_prior(s, sf):
    x = t(s, sf, "customer").select(F.col("c_nationkey").alias("d"), (F.floor(F.abs("c_acctbal") / 100) * 10).alias("age"), F.col("c_mktsegment").alias("sex"))
    return rounded(ranking.decade_prior(x), "prior").withColumn("decade", F.col("decade").cast("long"))


@query(f"""WITH {B.P}{B.C}{B.COS}, {RANKED.format(s='cs')}, sh AS (SELECT "case", d, score FROM rk WHERE rank <= 20), h AS (SELECT "case", d, idf, row_number() OVER (PARTITION BY "case", d ORDER BY idf DESC, p) AS r FROM sh JOIN c USING ("case") JOIN pf USING (d, p) JOIN ix USING (p)),
q AS (SELECT "case", d, score, sum(idf) AS spec FROM sh LEFT JOIN h USING ("case", d) WHERE r <= 3 GROUP BY ALL) SELECT "case", d, round({MM.format(c='score')} + 0.3 * ({MM.format(c='spec')}), 5) AS score FROM q WINDOW w AS (PARTITION BY "case")""")
def rerank_shortlist(s, sf):
    pf, idf, cos = _cos(s, sf)
    return ranking.rerank(cos, B.cases(s, sf), pf, idf).withColumn("score", F.round("score", 5))


@query(f"""WITH {B.P}{B.C}{B.COS}, {RANKED.format(s='cs')}, tw AS (SELECT "case", d, score FROM rk WHERE rank <= 2), wv AS (SELECT tw."case", tw.d, c.p, coalesce(w, 0) AS w FROM tw JOIN c USING ("case") LEFT JOIN pf ON pf.d = tw.d AND pf.p = c.p),
g AS (SELECT a."case", a.d, sum(greatest(0, a.w - b.w)) AS gap FROM wv a JOIN wv b ON a."case" = b."case" AND a.p = b.p AND a.d <> b.d GROUP BY ALL) SELECT "case", d, round(score + 0.1 * coalesce(gap, 0), 6) AS score FROM tw LEFT JOIN g USING ("case", d)""")
def confuser_rerank(s, sf):
    pf, _, cos = _cos(s, sf)
    return rounded(ranking.confuser_gap(cos, B.cases(s, sf), pf), "score")


@query(f"""WITH {B.P}{B.C}, mk AS (SELECT d, p, w, r <= 28 AS core, r <= 10 AS sig FROM (SELECT d, p, w, row_number() OVER (PARTITION BY d ORDER BY round(w * idf, 9) DESC, p) AS r FROM pf JOIN ix USING (p))),
dd AS (SELECT d, sum(w) AS aw, sum(w) FILTER (WHERE core) AS cw, count(*) FILTER (WHERE sig) AS ns FROM mk GROUP BY d), nn AS (SELECT "case", count(*) AS n FROM c GROUP BY "case"),
h AS (SELECT "case", d, sum(w) AS w, coalesce(sum(w) FILTER (WHERE core), 0) AS ch, count(*) FILTER (WHERE sig) AS sh, count(*) AS k FROM c JOIN mk USING (p) GROUP BY "case", d)
SELECT "case", d, round((w - 0.3 * (cw - ch)) / sqrt(aw) + 0.5 * sh / greatest(ns, 1), 6) AS score, round(k / nn.n, 6) AS coverage FROM h JOIN dd USING (d) JOIN nn USING ("case")""")
def question_aware_stack(s, sf):
    pf = materialize(B.profile(s, sf), "profile")
    return rounded(ranking.q_aware(B.cases(s, sf), ranking.key_sets(pf, ranking.profile_idf(pf))), "score", "coverage")


ABLATION = f"""WITH {B.E}, ch AS (SELECT "case", d, 'brand' AS channel, p_brand AS v FROM m UNION ALL SELECT "case", d, 'type', p_type FROM m UNION ALL SELECT "case", d, 'name', p_name FROM m),
dc AS (SELECT d, channel, v, ln(1 + count(*)) AS w FROM ch GROUP BY ALL), cc AS (SELECT DISTINCT l_suppkey AS "case", channel, v FROM (SELECT l_suppkey, 'brand' AS channel, p_brand AS v FROM m UNION ALL SELECT l_suppkey, 'type', p_type FROM m UNION ALL SELECT l_suppkey, 'name', p_name FROM m)),
co AS (SELECT "case", d, channel, sum(w) AS x FROM cc JOIN dc USING (channel, v) GROUP BY ALL), sb AS (SELECT concat_ws(',', CASE WHEN k & 1 > 0 THEN 'brand' END, CASE WHEN k & 2 > 0 THEN 'name' END, CASE WHEN k & 4 > 0 THEN 'type' END) AS subset FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS k)),
tot AS (SELECT subset, "case", d, round(sum(x), 9) AS score FROM co JOIN sb ON list_contains(string_split(subset, ','), channel) GROUP BY ALL), tp AS (SELECT subset, "case", first(d ORDER BY score DESC, d) AS top FROM tot GROUP BY ALL),
tt AS (SELECT "case", first(d ORDER BY n DESC, d) AS d FROM (SELECT l_suppkey AS "case", d, count(*) AS n FROM m GROUP BY ALL) GROUP BY "case")
SELECT subset, round(avg(CAST(top = tt.d AS INT)), 6) AS at_1, count(*) AS n FROM tp JOIN tt USING ("case") GROUP BY subset"""


def channel_parts(s, sf):
    """Contributions (case, d, channel, x) of the suppliers' brands, types and names, and the suppliers' truth."""
    m = materialize(B.mentions(s, sf).select("l_suppkey", "d", "p_brand", "p_type", "p_name"), "mentions")
    ch = m.select("l_suppkey", "d", F.explode(F.array(*[F.struct(F.lit(k).alias("channel"), F.col(f"p_{k}").alias("v")) for k in ("brand", "type", "name")])).alias("x")).select("l_suppkey", "d", "x.*")
    dc = ch.groupBy("d", "channel", "v").agg(F.log1p(F.count("*")).alias("w"))
    co = ch.select(F.col("l_suppkey").alias("case"), "channel", "v").distinct().join(dc, ["channel", "v"]).groupBy("case", "d", "channel").agg(F.sum("w").alias("x"))
    tt = m.groupBy(F.col("l_suppkey").alias("case"), "d").agg(F.count("*").alias("n")).groupBy("case").agg(F.min_by("d", F.struct((-F.col("n")).alias("n"), F.col("d"))).alias("d"))
    return co, tt


@query(ABLATION)
def subset_ablation(s, sf):
    co, tt = channel_parts(s, sf)
    return rounded(ranking.subset_ablation(materialize(co, "channels"), ("brand", "name", "type"), tt), "at_1")


# ---------------------------------------------------------------- evidence building

PAIR = f"""WITH {B.M}, x AS (SELECT DISTINCT "case" AS doc, p_brand AS x FROM m), nn AS (SELECT count(DISTINCT doc) AS n_docs FROM x), k AS (SELECT x, count(*) AS k FROM x GROUP BY x),
pr AS (SELECT a.x AS a, b.x AS b, count(*) AS n FROM x a JOIN x b ON a.doc = b.doc AND a.x < b.x GROUP BY ALL),
st AS (SELECT a, b, n, ka.k AS n_a, kb.k AS n_b, n_docs, n AS o1, ka.k - n AS o2, kb.k - n AS o3, greatest(n_docs - ka.k - kb.k + n, 0) AS o4 FROM pr JOIN k ka ON ka.x = a JOIN k kb ON kb.x = b, nn),
g AS (SELECT *, o1 + o2 + o3 + o4 AS t FROM st)"""
_O = lambda o, r1, c1: f"CASE WHEN {o} > 0 THEN {o} * ln({o} / (({r1}) * ({c1}) / t)) ELSE 0 END"
G2 = f"2 * ({_O('o1', 'o1 + o2', 'o1 + o3')} + {_O('o2', 'o1 + o2', 'o2 + o4')} + {_O('o3', 'o3 + o4', 'o1 + o3')} + {_O('o4', 'o3 + o4', 'o2 + o4')})"


def _brands(s, sf):
    return B.mentions(s, sf).select(F.col("case").alias("doc"), F.col("p_brand").alias("x"))


@query(f"{PAIR} SELECT a, b, n FROM pr")
def cooccurrence_pairs(s, sf):
    return evidence.cooccurrence(_brands(s, sf))


@query(f"{PAIR} SELECT a.x AS a, b.x AS b, count(*) AS n FROM x a JOIN x b ON a.doc = b.doc AND a.x <> b.x WHERE 'Brand#1' IN (a.x, b.x) GROUP BY ALL")
def directed_pairs(s, sf):
    return evidence.directed_cooccurrence(_brands(s, sf), s.createDataFrame([("Brand#1",)], "x string"))


@query(f"{PAIR} SELECT a, b, n, n_a, n_b, n_docs, round(pow(n, 0.6) * pow(n * n_docs / (n_a * n_b), 0.4), 6) AS jensen, round(CASE WHEN o1 * t < (o1 + o2) * (o1 + o3) THEN -1 ELSE 1 END * {G2}, 4) AS g2 FROM g")
def pair_statistics(s, sf):
    return rounded(evidence.pair_statistics(_brands(s, sf)), "jensen").withColumn("g2", F.round("g2", 4))


@query()
def significant_pairs(s, sf):
    x = evidence.pair_statistics(_brands(s, sf)).withColumn("p_value", F.round(M.chi2_tail(F.abs("g2")), 9))
    return evidence.benjamini_hochberg(materialize(x, "tests")).select("a", "b", r("g2", 4).alias("g2"), "p_value", r("q", 6))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice / 200003, 6) AS p_value FROM lineitem), n AS (SELECT p_value, count(*) AS k FROM p GROUP BY 1), c AS (SELECT p_value, sum(k) OVER (ORDER BY p_value) AS rank, sum(k) OVER () AS m FROM n),
q AS (SELECT p_value, least(1.0, min(p_value * m / rank) OVER (ORDER BY p_value DESC ROWS UNBOUNDED PRECEDING)) AS q FROM c) SELECT l_orderkey, l_linenumber, p_value, round(q, 6) AS q FROM p JOIN q USING (p_value)""")
def benjamini_hochberg(s, sf):
    x = t(s, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / 200003, 6).alias("p_value"))
    return rounded(evidence.benjamini_hochberg(x), "q")


VOTE = "CASE WHEN l_linestatus = 'O' THEN 'present' WHEN l_returnflag = 'R' THEN 'absent' ELSE 'not_related' END"


@query(f"""SELECT l_suppkey AS a, l_partkey AS b, count(*) FILTER (WHERE v = 'present') AS n_present, count(*) FILTER (WHERE v = 'absent') AS n_absent, count(*) FILTER (WHERE v = 'not_related') AS n_not_related, count(DISTINCT l_orderkey) AS n_docs,
CASE WHEN count(*) FILTER (WHERE v = 'absent') > count(*) FILTER (WHERE v = 'present') THEN 'absent' WHEN count(*) FILTER (WHERE v = 'present') > 0 THEN 'present' ELSE 'ambiguous' END AS polarity FROM (SELECT *, {VOTE} AS v FROM lineitem) GROUP BY ALL""")
def pair_polarity(s, sf):
    v = F.when(F.col("l_linestatus") == "O", "present").when(F.col("l_returnflag") == "R", "absent").otherwise("not_related")
    x = t(s, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_orderkey").alias("doc"), v.alias("verdict"))
    return evidence.pair_votes(x).withColumn("n_docs", F.size("docs").cast("long")).drop("docs")


MERGE = f"""WITH {B.M}, k AS (SELECT d, p, list_sort(list(DISTINCT source)) AS sources, count(*) FILTER (WHERE source[2] = 'O') AS n_textbook, count(*) FILTER (WHERE source[2] <> 'O') AS n_article, max(l_quantity / 50) AS frequency FROM m GROUP BY d, p),
tp AS (SELECT greatest(max(n_article), 1) AS ta, greatest(max(n_textbook), 1) AS tb FROM k)"""


@query(f"{MERGE} SELECT d, p, array_to_string(sources, ',') AS sources, n_textbook, n_article, round(frequency, 6) AS frequency, round(0.4 * len(sources) / 5 + 0.3 * n_textbook / tb + 0.2 * ln(1 + n_article) / ln(1 + ta) + 0.1 * frequency, 6) AS score FROM k, tp")
def multi_source_merge(s, sf):
    x = B.mentions(s, sf).select("d", "p", "source", F.when(F.col("source").endswith("O"), "textbook").otherwise("article").alias("kind"), (F.col("l_quantity") / 50).alias("frequency"))
    out = evidence.merge_sources(x).drop("provenance").withColumn("sources", F.array_join("sources", ","))
    return rounded(out, "frequency", "score")


@query(f"WITH {B.M} SELECT d, p, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM m GROUP BY d, p")
def union_with_sources(s, sf):
    return evidence.source_sets(B.mentions(s, sf)).withColumn("sources", F.array_join("sources", ","))


_OLD = "ol AS (SELECT DISTINCT d, p FROM m WHERE source[2] = 'O'), nw AS (SELECT DISTINCT d, p FROM m WHERE source[2] = 'F')"


def _old_new(s, sf):
    m = B.mentions(s, sf)
    return (m.where(F.col("source").endswith(x)).select("d", "p").distinct() for x in ("O", "F"))


@query(f"WITH {B.M}, {_OLD} SELECT d, p FROM ol UNION SELECT d, p FROM nw")
def union_mode_build(s, sf):
    return evidence.union_mode(*_old_new(s, sf))


@query(f"WITH {B.M}, {_OLD}, rich AS (SELECT d FROM ol GROUP BY d HAVING count(*) >= 240) SELECT d, p FROM ol UNION SELECT d, p FROM nw WHERE d NOT IN (SELECT d FROM rich)")
def selective_union_build(s, sf):
    return evidence.selective_union(*_old_new(s, sf), 240)


@query(f"{PAIR}, f AS (SELECT a, b, n, n >= 3 AS f_a, NOT (a IN ('Brand#3', 'Brand#4') OR b IN ('Brand#3', 'Brand#4')) AS f_b, a < 'Brand#2' AND b < 'Brand#2' AS f_c, n >= 4 AS g FROM pr) SELECT a, b, n, f_a, f_b, f_c, f_a AND f_b AND f_c AS f_d, g AND f_b AND f_c AS f_e FROM f")
def pair_filters(s, sf):
    core = t(s, sf, "part").where("p_brand < 'Brand#2'").select(F.col("p_brand").alias("x"))
    return evidence.pair_filters(evidence.cooccurrence(_brands(s, sf)), s.createDataFrame([("Brand#3",), ("Brand#4",)], "x string"), core, 3)


@query("""WITH r AS (SELECT DISTINCT l_suppkey AS d, l_partkey AS p FROM lineitem), rel AS (SELECT DISTINCT l_suppkey AS x, l_partkey AS y FROM lineitem WHERE l_returnflag = 'R')
SELECT d, p FROM r WHERE (d, p) NOT IN (SELECT (x, y) FROM rel) AND (d, p) NOT IN (SELECT (y, x) FROM rel)""")
def exclude_related(s, sf):
    li = t(s, sf, "lineitem")
    rel = li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("x"), F.col("l_partkey").alias("y")).distinct()
    both = rel.withColumn("rel", F.lit("SY")).unionByName(rel.withColumn("rel", F.lit("PAR")))
    return evidence.exclude_related(li.select(F.col("l_suppkey").alias("d"), F.col("l_partkey").alias("p")).distinct(), both)


@query(f"WITH {B.E}, h AS (SELECT p FROM e GROUP BY p HAVING count(DISTINCT d) > 30) SELECT d, p, round(w, 6) AS w FROM e WHERE p NOT IN (SELECT p FROM h)")
def hub_filter(s, sf):
    return rounded(evidence.drop_hubs(B.edges(s, sf).select("d", "p", "w"), 30), "w")


@query(f"WITH {B.M}, n AS (SELECT d, p_brand AS p, p_type AS category, count(*) AS n FROM m GROUP BY ALL) SELECT d, p, round(0.6 * ln(1 + sum(n)), 6) AS w, first(category ORDER BY n DESC, category) AS category FROM n GROUP BY d, p")
def category_merge(s, sf):
    x = B.mentions(s, sf).select("d", F.col("p_brand").alias("p"), F.col("p_type").alias("category"))
    return rounded(evidence.category_edges(x), "w")


_CAT = f"WITH {B.M}, x AS (SELECT DISTINCT d, p_brand AS p, CASE WHEN p_type <> 'PROMO' THEN p_type END AS category FROM m)"


@query(f"{_CAT} SELECT d, p, category FROM x WHERE CASE WHEN category IS NULL THEN p IN (SELECT p_brand FROM part WHERE p_size < 3) ELSE category IN ('ECONOMY', 'SMALL') END")
def category_filter(s, sf):
    x = B.mentions(s, sf).select("d", F.col("p_brand").alias("p"), F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("category")).distinct()
    return evidence.allowed(x, ("ECONOMY", "SMALL"), t(s, sf, "part").where("p_size < 3").select(F.col("p_brand").alias("x")))


REL = "re AS (SELECT DISTINCT a.p_brand || '|' || a.p_type || '|' || a.p_name AS x, b.p_brand || '|' || b.p_type || '|' || b.p_name AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name WHERE a.p_type < b.p_type)"


def _related(s, sf):
    p = t(s, sf, "part").select("p_brand", "p_type", "p_name").distinct()
    x = p.withColumnRenamed("p_type", "u").join(p, ["p_brand", "p_name"]).where("u < p_type")
    return x.select(F.concat_ws("|", "p_brand", "u", "p_name").alias("x"), F.concat_ws("|", "p_brand", "p_type", "p_name").alias("y")).distinct()


@query(f"WITH {B.E}, {REL} SELECT d, p, round(sum(w), 6) AS w FROM (SELECT d, p, w FROM e UNION ALL SELECT d, y, w * 0.5 FROM e JOIN re ON p = x) GROUP BY d, p")
def expand_findings(s, sf):
    return rounded(evidence.expand(B.edges(s, sf), _related(s, sf)), "w")


@query(f"WITH {B.E}, {REL}, o AS (SELECT d, y, w FROM e JOIN re ON p = x), w2 AS (SELECT d, re.y, w FROM o JOIN re ON o.y = re.x) SELECT d, p, round(max(w), 6) AS w FROM (SELECT d, p, w FROM e UNION ALL SELECT d, y, w * 0.5 FROM o UNION ALL SELECT d, y, w * 0.25 FROM w2) GROUP BY d, p")
def two_hop_decay(s, sf):
    return rounded(evidence.two_hops(B.edges(s, sf), _related(s, sf)), "w")


@query(f"WITH {B.E}, {REL}, k AS (SELECT d, p, y, w, row_number() OVER (PARTITION BY d, p ORDER BY y) AS r FROM e JOIN re ON p = x), nw AS (SELECT d, y AS p, max(w) * 0.7 AS w FROM k WHERE r <= 2 GROUP BY ALL) SELECT d, p, round(w, 6) AS w FROM e UNION ALL SELECT d, p, round(w, 6) FROM nw WHERE (d, p) NOT IN (SELECT (d, p) FROM e)")
def children_join(s, sf):
    return rounded(evidence.add_children(materialize(B.edges(s, sf), "edges"), _related(s, sf).toDF("p", "child"), 0.7, 2), "w")


@query(f"WITH {B.E}, al AS (SELECT DISTINCT c_mktsegment || ':' || c_nationkey AS alias, c_mktsegment || ':' || (c_nationkey + 1) AS d FROM customer WHERE c_nationkey < 24), nw AS (SELECT al.d, p, max(w) AS w FROM e JOIN al ON al.alias = e.d GROUP BY ALL) SELECT d, p, round(w, 6) AS w FROM e UNION ALL SELECT d, p, round(w, 6) FROM nw WHERE (d, p) NOT IN (SELECT (d, p) FROM e)")
def alias_copy(s, sf):
    c = t(s, sf, "customer").where("c_nationkey < 24")
    k = lambda n: F.concat("c_mktsegment", F.lit(":"), n.cast("string"))
    al = c.select(k(F.col("c_nationkey")).alias("alias"), k(F.col("c_nationkey") + 1).alias("d")).distinct()
    return rounded(evidence.copy_aliases(materialize(B.edges(s, sf), "edges"), al), "w")


@query(f"WITH {B.E}, {REL} SELECT d, p, round(sum(w), 6) AS w FROM (SELECT d, p, w FROM e UNION ALL SELECT d, y, 0.7 * w * 0.6 FROM e JOIN re ON p = x) GROUP BY d, p")
def hop2_propagation(s, sf):
    links = graph.hierarchy(_related(s, sf).withColumn("rel", F.lit("CHD")))
    return rounded(graph.propagate(B.edges(s, sf), links), "w")


@query(f"""WITH rr AS (SELECT l_suppkey AS x, l_partkey AS y, CASE l_returnflag WHEN 'R' THEN 'SY' WHEN 'A' THEN 'PAR' ELSE 'RO' END AS rel FROM lineitem WHERE l_suppkey <> l_partkey)
SELECT x, y, CAST(max(CASE rel WHEN 'SY' THEN 1.0 WHEN 'PAR' THEN 0.6 ELSE 0.4 END) AS DOUBLE) AS w, string_agg(DISTINCT rel, ',' ORDER BY rel) AS rels FROM rr GROUP BY x, y""")
def hierarchy_links(s, sf):
    rel = F.when(F.col("l_returnflag") == "R", "SY").when(F.col("l_returnflag") == "A", "PAR").otherwise("RO")
    return graph.hierarchy(t(s, sf, "lineitem").select(F.col("l_suppkey").alias("x"), F.col("l_partkey").alias("y"), rel.alias("rel"))).withColumn("rels", F.array_join("rels", ","))


@query(f"""WITH {B.M}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d, "case", p_brand ORDER BY ord) AS r FROM m) WHERE r = 1), k AS (SELECT d, p_brand AS p, p_type, count(*) AS n FROM f GROUP BY ALL), tt AS (SELECT d, p, CAST(sum(n) AS BIGINT) AS n_mentions FROM k GROUP BY ALL)
SELECT d, p, p_type AS value, n_mentions, round(n / n_mentions, 6) AS share FROM k JOIN tt USING (d, p)""")
def value_distributions(s, sf):
    # lines of an order may share a number; the first of them in the file counts, and in a struct no kind is a kind, too
    x = B.placed_mentions(s, sf).select("d", F.col("case").alias("doc"), F.col("place").alias("ord"), F.col("p_brand").alias("p"), F.struct("p_type").alias("value"))
    out = evidence.aggregate_findings(x)
    return rounded(out.select("d", "p", "n_mentions", F.explode("dist").alias("value", "share")).withColumn("value", F.col("value.p_type")), "share")


@query("SELECT p_brand AS cui, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS codes FROM part GROUP BY p_brand")
def inverse_mapping(s, sf):
    x = evidence.inverse_codes(t(s, sf, "part").select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("cui")))
    return x.withColumn("codes", F.array_join(F.transform("codes", lambda v: v.cast("string")), ","))


@query("SELECT x, string_agg(DISTINCT o, ',' ORDER BY o) AS origins FROM (SELECT p_brand AS x, 'parts' AS o FROM part UNION ALL SELECT n_name, 'nations' FROM nation UNION ALL SELECT p_brand, 'small' FROM part WHERE p_size < 5) GROUP BY x")
def combined_seeds(s, sf):
    p = t(s, sf, "part")
    out = evidence.seed_union(("parts", p.select(F.col("p_brand").alias("x"))), ("nations", t(s, sf, "nation").select(F.col("n_name").alias("x"))), ("small", p.where("p_size < 5").select(F.col("p_brand").alias("x"))))
    return out.withColumn("origins", F.array_join("origins", ","))


@query("""WITH s AS (SELECT p_brand AS x, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS sabs, count(DISTINCT p_type) AS n, bool_or(p_type = 'ECONOMY') AS a, bool_or(p_type = 'PROMO') AS b, bool_or(p_type = 'LARGE') AS c FROM part WHERE p_type IN ('ECONOMY', 'PROMO', 'LARGE', 'SMALL') AND p_size > 10 AND p_brand IN (SELECT p_brand FROM part WHERE p_name LIKE 'red%') GROUP BY p_brand)
SELECT x, sabs, (a AND b) OR c OR n >= 3 AS focused FROM s""")
def seed_selection(s, sf):
    p = t(s, sf, "part")
    names = p.select(F.col("p_brand").alias("x"), F.col("p_type").alias("sab"), (F.col("p_size") <= 10).alias("suppressed"))
    types = p.select(F.col("p_brand").alias("x"), F.when(F.col("p_name").startswith("red"), "core").alias("tui"))
    return evidence.select_seeds(names, types, ("ECONOMY", "PROMO", "LARGE", "SMALL"), ("core",), ("ECONOMY", "PROMO"), ("LARGE",)).withColumn("sabs", F.array_join("sabs", ","))


# ---------------------------------------------------------------- dialogue

CAND = """, fy AS (SELECT "case", p FROM fa WHERE yes), e1 AS (SELECT DISTINCT d, p FROM e), alive AS (SELECT DISTINCT "case", d FROM fy JOIN e1 USING (p)),
chief AS (SELECT "case", first(p ORDER BY ord, p) AS p FROM m GROUP BY "case")"""


@query(f"WITH {B.E} SELECT e.d, count(DISTINCT e.p) AS n FROM e WHERE d IN (SELECT d FROM e WHERE p = (SELECT min(p) FROM e)) GROUP BY e.d")
def one_hop(s, sf):
    e = materialize(B.edges(s, sf).select("d", "p"), "edges")
    seed = e.agg(F.min("p").alias("p"))
    return e.join(e.join(F.broadcast(seed), "p", "left_semi").select("d").distinct(), "d", "left_semi").groupBy("d").agg(F.count_distinct("p").alias("n"))


def _supplier_facts(s, sf):
    m = B.mentions(s, sf)
    return m.groupBy(F.col("l_suppkey").alias("case"), F.col("p_brand").alias("p")).agg((F.max((F.col("l_returnflag") != "R").cast("int")) == 1).alias("yes"))


def _supplier_state(s, sf):
    """What has been asked so far: the first brands. The others are left to ask; a state of all facts leaves no candidate."""
    return _supplier_facts(s, sf).where("p < 'Brand#14'")


SUP = f"""WITH {B.M}, be AS (SELECT DISTINCT d, p_brand AS p FROM m), st AS (SELECT l_suppkey AS "case", p_brand AS p, max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) = 1 AS yes FROM m WHERE p_brand < 'Brand#14' GROUP BY ALL), al AS (SELECT DISTINCT "case", d FROM st JOIN be USING (p) WHERE yes)"""


def _brand_edges(s, sf):
    m = B.mentions(s, sf)
    return m.select("d", F.col("p_brand").alias("p")).distinct()


@query(f"{SUP} SELECT \"case\", p, count(DISTINCT d) AS n FROM al JOIN be USING (d) WHERE (\"case\", p) NOT IN (SELECT (\"case\", p) FROM st) GROUP BY ALL")
def two_hop_candidates(s, sf):
    return dialogue.candidates(_supplier_state(s, sf), _brand_edges(s, sf))


@query(f"{SUP}, dn AS (SELECT \"case\", d FROM st JOIN be USING (p) WHERE NOT yes GROUP BY ALL HAVING count(*) > 1) SELECT \"case\", p, count(DISTINCT d) AS n FROM al JOIN be USING (d) WHERE (\"case\", p) NOT IN (SELECT (\"case\", p) FROM st) AND (\"case\", d) NOT IN (SELECT (\"case\", d) FROM dn) AND p <> 'Brand#20' GROUP BY ALL")
def denied_limit_candidates(s, sf):
    return dialogue.candidates(_supplier_state(s, sf), _brand_edges(s, sf), 1, s.createDataFrame([("Brand#20",)], "p string"))


@query(f"{SUP}, cd AS (SELECT \"case\", p, count(DISTINCT d) AS n FROM al JOIN be USING (d) WHERE (\"case\", p) NOT IN (SELECT (\"case\", p) FROM st) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY \"case\" ORDER BY n DESC, p) AS rank FROM cd) SELECT \"case\", p, n, rank FROM r WHERE rank <= 3")
def greedy_selection(s, sf):
    return dialogue.pick(dialogue.candidates(_supplier_state(s, sf), _brand_edges(s, sf)), 3)


_H = lambda n: f"sum(CASE WHEN {n} > 0 THEN -{n} * log2({n}) ELSE 0 END)"
GAIN = f"""{SUP}, cd AS (SELECT "case", p, count(DISTINCT d) AS n FROM al JOIN be USING (d) WHERE ("case", p) NOT IN (SELECT ("case", p) FROM st) GROUP BY ALL), fq AS (SELECT "case", p AS q FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY n DESC, p) AS r FROM cd) WHERE r <= 7),
cn AS (SELECT "case", d, count(*) FILTER (WHERE yes) AS c, count(*) FILTER (WHERE NOT yes) AS x FROM st JOIN be USING (p) GROUP BY ALL), gr AS (SELECT cn."case", q, cn.d, c, x, CASE WHEN be.d IS NULL THEN 0 ELSE 1 END AS has FROM cn JOIN fq USING ("case") LEFT JOIN be ON be.d = cn.d AND be.p = q WHERE c > 0),
s AS (SELECT "case", q, has, c / (c + x + 1.0) * c AS s0, (c + has) / (c + has + x + 1.0) * (c + has) AS s1, c / (c + x + has + 1.0) * c AS s2 FROM gr), n AS (SELECT "case", q, has, s0 / sum(s0) OVER w AS s0, s1 / sum(s1) OVER w AS s1, s2 / sum(s2) OVER w AS s2 FROM s WINDOW w AS (PARTITION BY "case", q)),
g AS (SELECT "case", q, {_H('s0')} AS h0, {_H('s1')} AS h1, {_H('s2')} AS h2, max(s1) AS m1, max(s2) AS m2, least(0.9, greatest(0.1, sum(s0 * has))) AS yes FROM n GROUP BY ALL)"""


@query(f"{GAIN} SELECT \"case\", q, round(h0, 6) AS h0, round(yes, 6) AS yes, round(h0 - yes * h1 - (1 - yes) * h2, 6) AS ig_expected, round(h0 - least(h1, h2), 6) AS ig_max, round(-abs(yes - 0.5), 6) AS ig_binary_split, round(least(m1, m2), 6) AS minimax_score, round(-greatest(h1, h2), 6) AS minimax_entropy FROM g")
def information_gain(s, sf):
    st, e = materialize(_supplier_state(s, sf), "state"), materialize(_brand_edges(s, sf), "edges")
    g = dialogue.expected_gain(st, dialogue.candidates(st, e), e)
    cols = ("h0", "yes", "ig_expected", "ig_max", "ig_binary_split", "minimax_score", "minimax_entropy")
    return rounded(g, *cols).select("case", "q", *cols)


@query(f"{SUP}, cd AS (SELECT \"case\", p, count(DISTINCT d) AS n FROM al JOIN be USING (d) WHERE (\"case\", p) NOT IN (SELECT (\"case\", p) FROM st) GROUP BY ALL), cf AS (SELECT \"case\", d, count(*) AS n FROM st JOIN be USING (p) WHERE yes GROUP BY ALL), x AS (SELECT cd.\"case\", cd.p, be.d, coalesce(cf.n, 0) + 1 AS confirmed FROM cd JOIN be USING (p) LEFT JOIN cf ON cf.\"case\" = cd.\"case\" AND cf.d = be.d) SELECT \"case\", p, d, confirmed FROM (SELECT *, row_number() OVER (PARTITION BY \"case\", p ORDER BY confirmed DESC, d) AS r FROM x) WHERE r <= 3")
def related_diseases(s, sf):
    st, e = materialize(_supplier_state(s, sf), "state"), materialize(_brand_edges(s, sf), "edges")
    return dialogue.related_diseases(dialogue.candidates(st, e), st, e)


BELIEF = f"""WITH {B.M}, k AS (SELECT c_nationkey AS "case", d, count(*) AS n FROM m JOIN orders ON o_orderkey = "case" JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""


def _beliefs(s, sf):
    m = B.mentions(s, sf)
    k = m.groupBy(F.col("l_suppkey").alias("case"), F.substring_index("d", ":", 1).alias("d")).agg(F.count("*").alias("n"))
    prior = k.select("case", "d", (F.col("n") / F.sum("n").over(Window.partitionBy("case"))).alias("belief"))
    prof = m.groupBy(F.substring_index("d", ":", 1).alias("d"), F.col("p_type").alias("p")).agg(F.count("*").alias("n"))
    return prior, prof.select("d", "p", (F.col("n") / F.sum("n").over(Window.partitionBy("d"))).alias("w"))


BEL = f"""WITH {B.M}, k AS (SELECT l_suppkey AS "case", split_part(d, ':', 1) AS d, count(*) AS n FROM m GROUP BY ALL), pr AS (SELECT "case", d, n / sum(n) OVER (PARTITION BY "case") AS belief FROM k), pk AS (SELECT split_part(d, ':', 1) AS d, p_type AS p, count(*) AS n FROM m GROUP BY ALL), pf AS (SELECT d, p, n / sum(n) OVER (PARTITION BY d) AS w FROM pk)"""


@query(f"""{BEL}, x AS (SELECT "case", p, belief, belief * (0.05 + 0.9 * w) AS a, belief * (1 - (0.05 + 0.9 * w)) AS b FROM pr JOIN pf USING (d)), g AS (SELECT "case", p, sum(a) AS y, sum(b) AS n, sum(a * log2(a)) AS la, sum(b * log2(b)) AS lb, -sum(belief * log2(belief)) AS h FROM x GROUP BY ALL)
SELECT "case", p, round(y, 6) AS p_yes, round(h - (y * log2(y) - la + n * log2(n) - lb), 6) AS gain FROM g""")
def bayes_question_gain(s, sf):
    prior, prof = _beliefs(s, sf)
    return rounded(dialogue.bayes_gain(materialize(prof, "profile"), prior), "p_yes", "gain")


@query(f"""{BEL}, x AS (SELECT "case", d, belief * CASE WHEN "case" > 5 THEN 0.05 + 0.9 * w ELSE 1 - (0.05 + 0.9 * w) END AS b FROM pr JOIN pf USING (d) WHERE p = 'PROMO') SELECT "case", d, round(b / sum(b) OVER (PARTITION BY "case"), 6) AS belief FROM x""")
def bayes_update(s, sf):
    prior, prof = _beliefs(s, sf)
    answers = prior.select("case").distinct().select("case", F.lit("PROMO").alias("p"), (F.col("case") > 5).alias("yes"))
    return rounded(dialogue.update_belief(prior, answers, prof), "belief")


EV = """tj AS (SELECT user_id AS "case", row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS hit, event_type AS top, value FROM events)"""


def _trajectory(s, sf):
    x = t(s, sf, "events")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return x.select(F.col("user_id").alias("case"), step.alias("step"), F.col("event_type").isin("click", "purchase").cast("int").alias("hit"), F.col("event_type").alias("top"), "value")


@query(f"""WITH {EV} SELECT "case", step, CAST(sum(hit) OVER f AS BIGINT) AS hits, count(*) OVER f = 5 AS "full", count(*) OVER f = 5 AND sum(hit) OVER f = 0 AS all_miss, round(avg(hit) OVER (PARTITION BY "case" ORDER BY step ROWS UNBOUNDED PRECEDING), 6) AS rate FROM tj WINDOW f AS (PARTITION BY "case" ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def trailing_windows(s, sf):
    return rounded(dialogue.trailing(_trajectory(s, sf)), "rate").select("case", "step", "hits", "full", "all_miss", "rate")


@query(f"""WITH {EV} SELECT "case", step, top, count(*) OVER f = 3 AND min(top) OVER f = max(top) OVER f AS stable, coalesce(top <> lag(top) OVER (PARTITION BY "case" ORDER BY step), false) AS changed FROM tj WINDOW f AS (PARTITION BY "case" ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def rank_stability(s, sf):
    return dialogue.stability(_trajectory(s, sf), "top", 3).select("case", "step", "top", "stable", "changed")


@query(f"""WITH {EV}, x AS (SELECT step, avg(hit) OVER (PARTITION BY "case" ORDER BY step ROWS UNBOUNDED PRECEDING) AS r FROM tj) SELECT step, count(*) AS n, round(avg(r), 6) AS rate FROM x GROUP BY step""")
def hit_curve(s, sf):
    return rounded(dialogue.hit_curve(_trajectory(s, sf)), "rate")


@query(f"""WITH {EV}, x AS (SELECT "case", step, top, coalesce(top <> lag(top) OVER (PARTITION BY "case" ORDER BY step), false) AS changed FROM tj) SELECT "case", count(*) AS n_steps, count(*) FILTER (WHERE changed) AS n_changes, string_agg(step || ':' || top, ',' ORDER BY step) AS trace FROM x GROUP BY "case" """)
def diagnostic_trace(s, sf):
    x = dialogue.traces(_trajectory(s, sf), "top")
    return x.withColumn("trace", F.array_join(F.transform("trace", lambda v: F.concat(v["step"].cast("string"), F.lit(":"), v["top"])), ","))


@query(f"""WITH {EV} SELECT "case", step, CASE WHEN step >= 25 THEN 'max_il' WHEN value < 1 THEN 'no_candidates' WHEN step < 5 THEN NULL WHEN value / 500 >= 0.3 THEN 'confidence' WHEN value / 500 - 0.1 >= 0.005 THEN 'gap' END AS reason FROM tj""")
def stop_reasons(s, sf):
    x = _trajectory(s, sf)
    return x.select("case", "step", dialogue.stop_reason(F.col("step"), F.when(F.col("value") < 1, 0).otherwise(1), F.col("value") / 500, F.lit(0.1)).alias("reason"))


STOP = f"""WITH {EV}, tr AS (SELECT "case", step, top, value / 500 AS top1, value / 500 - 0.2 AS gap, 3 - value / 200 AS entropy, step AS asked, CAST(floor(value / 50) AS INT) AS strong FROM tj), z AS (SELECT *, lag(entropy) OVER w - entropy AS fall FROM tr WINDOW w AS (PARTITION BY "case" ORDER BY step)),
y AS (SELECT "case", step, 'min_il' AS family, step >= 3 AND (top1 >= 0.3 OR gap >= 0.005) AS ok FROM z UNION ALL SELECT "case", step, 'confidence', top1 >= 0.6 FROM z UNION ALL SELECT "case", step, 'entropy', entropy < 1.0 FROM z
UNION ALL SELECT "case", step, 'info_gain', coalesce(fall < 0.1, false) AND coalesce(lag(fall) OVER w < 0.1, false) FROM z WINDOW w AS (PARTITION BY "case" ORDER BY step)
UNION ALL SELECT "case", step, 'rank_stability', count(*) OVER f = 2 AND min(top) OVER f = max(top) OVER f FROM z WINDOW f AS (PARTITION BY "case" ORDER BY step ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)
UNION ALL SELECT "case", step, 'coverage', asked / 10 >= 0.8 FROM z UNION ALL SELECT "case", step, 'narrowing', strong <= 1 FROM z
UNION ALL SELECT "case", step, 'steady', count(*) OVER f = 2 AND min(top) OVER f = max(top) OVER f AND min(CAST(top1 >= 0.1 AS INT)) OVER f = 1 FROM z WINDOW f AS (PARTITION BY "case" ORDER BY step ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)
UNION ALL SELECT "case", step, 'next_question', step >= 3 AND coalesce(fall / nullif(fall + entropy, 0) < 0.05, false) FROM z)"""
STOP_SETTINGS = (("min_il", 3, 0), ("confidence", 0.6, 0), ("entropy", 1.0, 0), ("info_gain", 0.1, 0), ("rank_stability", 2, 0), ("coverage", 0.8, 0), ("narrowing", 1, 0), ("steady", 0.1, 2), ("next_question", 0.05, 0))


@query(f"{STOP} SELECT \"case\", family, coalesce(min(step) FILTER (WHERE ok), max(step)) AS stop FROM y GROUP BY ALL")
def stop_families(s, sf):
    x = _trajectory(s, sf).select("case", "step", "top", (F.col("value") / 500).alias("top1"), (F.col("value") / 500 - 0.2).alias("gap"), (3 - F.col("value") / 200).alias("entropy"), F.col("step").alias("asked"), F.floor(F.col("value") / 50).alias("strong"))
    out = None
    for family, a, b in STOP_SETTINGS:
        part = dialogue.stop_step(x, family, a, b).select("case", F.lit(family).alias("family"), "stop")
        out = part if out is None else out.unionByName(part)
    return out


SIM = """WITH k AS (SELECT n_name AS d, p_brand AS p, n_nationkey, row_number() OVER (PARTITION BY n_name ORDER BY p_brand) AS o FROM nation, (SELECT DISTINCT p_brand FROM part)), w AS (SELECT d, p, (o % 7) / 10.0 AS w FROM k),
c AS (SELECT DISTINCT d, i, d || '#' || i AS "case" FROM w, (SELECT unnest(range(1, 6)) AS i)), x AS (SELECT "case", d, p, w, CAST(('0x' || substr(md5("case" || '|' || p || '|42'), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM c JOIN w USING (d))
SELECT "case", d, p, u < w OR (max(CAST(u < w AS INT)) OVER (PARTITION BY "case") = 0 AND row_number() OVER (PARTITION BY "case" ORDER BY w DESC, p) = 1) AS yes FROM x"""


@query(SIM)
def simulated_cases(s, sf):
    k = t(s, sf, "nation").select(F.col("n_name").alias("d")).crossJoin(F.broadcast(t(s, sf, "part").select(F.col("p_brand").alias("p")).distinct()))
    w = k.select("d", "p", (F.row_number().over(Window.partitionBy("d").orderBy("p")) % 7 / 10.0).alias("w"))
    return dialogue.simulated_cases(w, 5)


@query(f"WITH {B.E}{B.C}, mm AS (SELECT \"case\", d, count(*) AS k FROM c JOIN (SELECT DISTINCT d, p FROM e) USING (p) GROUP BY ALL), md AS (SELECT first(d ORDER BY n DESC, d) AS f FROM (SELECT d, count(*) AS n FROM tr GROUP BY d)) SELECT \"case\", first(d ORDER BY k DESC, d) AS by_overlap, any_value(f) AS by_frequency FROM mm, md GROUP BY \"case\"")
def reference_baselines(s, sf):
    return dialogue.baselines(B.mentions(s, sf), B.truth(s, sf), B.mentions(s, sf))


_ASK = """, a{k} AS (SELECT DISTINCT "case", d FROM s{k} JOIN be USING (p) WHERE yes), c{k} AS (SELECT "case", p, count(*) AS n FROM a{k} JOIN be USING (d) WHERE ("case", p) NOT IN (SELECT ("case", p) FROM s{k}) GROUP BY ALL),
q{k} AS (SELECT "case", arg_min(p, (-n, p)) AS p FROM c{k} GROUP BY "case"), s{n} AS (SELECT * FROM s{k} UNION ALL SELECT "case", p, ("case", p) IN (SELECT ("case", p) FROM ft) FROM q{k})"""


@query(f"""WITH {B.M}, be AS (SELECT DISTINCT d, p_brand AS p FROM m), ft AS (SELECT l_suppkey AS "case", p_brand AS p FROM m WHERE l_returnflag <> 'R' GROUP BY ALL), s0 AS (SELECT "case", min(p) AS p, true AS yes FROM ft GROUP BY "case")"""
       + "".join(_ASK.format(k=k, n=k + 1) for k in range(3)) + ' SELECT "case", p, yes FROM s3')
def question_rounds(s, sf):
    true = materialize(_supplier_facts(s, sf).where("yes").select("case", "p"), "facts")
    chief = true.groupBy("case").agg(F.min("p").alias("p"))
    return dialogue.run_rounds(true, chief, materialize(_brand_edges(s, sf), "edges"), 3)


# ---------------------------------------------------------------- graph

BRP = """ed AS (SELECT d, p_brand AS p, CAST(count(*) AS DOUBLE) AS w FROM m GROUP BY ALL), un AS (SELECT d AS x, p AS y, w FROM ed UNION ALL SELECT p, d, w FROM ed)"""


def _graph(s, sf):
    m = B.mentions(s, sf)
    e = m.groupBy("d", F.col("p_brand").alias("p")).agg(F.count("*").cast("double").alias("w"))
    return materialize(graph.undirected(e), "graph")


_PPR = f"WITH RECURSIVE {B.M}, {BRP}, tp AS (SELECT x, y, w / sum(w) OVER (PARTITION BY x) AS share FROM un), sd AS (SELECT DISTINCT d AS c, d AS x, 1.0::DOUBLE AS mass FROM ed), l0 AS (SELECT * FROM sd)" + "".join(
    f", l{i + 1} AS (SELECT c, x, sum(mass) AS mass FROM (SELECT c, y AS x, 0.85 * mass * share AS mass FROM l{i} JOIN tp USING (x) UNION ALL SELECT c, x, 0.15 * mass FROM sd) GROUP BY c, x)" for i in range(15)
)


@query(f"{_PPR} SELECT c AS \"case\", x, round(mass, 6) AS mass FROM l15".replace("WITH RECURSIVE", "WITH"))
def personalised_pagerank(s, sf):
    g = _graph(s, sf)
    seeds = g.where("x LIKE '%:%'").select(F.col("x").alias("case"), "x").distinct()
    return rounded(graph.personalised_pagerank(g, seeds), "mass")


@query(f"WITH {B.M}, {BRP}, dg AS (SELECT y, count(*) AS k FROM un GROUP BY y) SELECT a.x AS a, b.x AS b, count(*) AS cn, round(sum(1 / ln(k + 2.0)), 6) AS aa, round(sum(1.0 / k), 6) AS ra FROM un a JOIN un b ON a.y = b.y AND a.x < b.x JOIN dg ON dg.y = a.y GROUP BY a.x, b.x")
def link_prediction(s, sf):
    return rounded(graph.link_prediction(_graph(s, sf)), "aa", "ra")


@query()
def fast_projection(s, sf):
    return graph.fast_projection(_graph(s, sf)).withColumn("vec", F.transform("vec", lambda v: F.round(v, 6)))


@query(f"WITH {B.M}, {BRP}, s0 AS (SELECT DISTINCT d AS root, d AS x, 0 AS depth FROM ed ), s1 AS (SELECT * FROM s0 UNION ALL SELECT root, y, 1 FROM s0 JOIN un USING (x)), s2 AS (SELECT root, x, min(depth) AS depth FROM (SELECT * FROM s1 UNION ALL SELECT root, y, 2 FROM s1 JOIN un USING (x) WHERE depth = 1) GROUP BY ALL), s3 AS (SELECT root, x, min(depth) AS depth FROM (SELECT * FROM s2 UNION ALL SELECT root, y, 3 FROM s2 JOIN un USING (x) WHERE depth = 2) GROUP BY ALL) SELECT root, x, depth FROM s3")
def bfs_layers(s, sf):
    g = _graph(s, sf)
    roots = g.where("x LIKE '%:%'").select(F.col("x").alias("root")).distinct()
    return graph.bfs(g, roots)


@query(f"WITH {B.E} SELECT d, p, round(ln(1 + freq) / sqrt(n_sources + 1) * w, 6) AS w FROM e")
def depth_decay(s, sf):
    return B.edges(s, sf).select("d", "p", F.round(graph.depth_weight(F.col("freq"), F.col("n_sources"), F.col("w")), 6).alias("w"))


HI = "pa AS (SELECT n_name AS x, r_name AS parent FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT r_name, 'WORLD' FROM region UNION SELECT DISTINCT c_mktsegment || ':' || c_nationkey, 'NATION_' || c_nationkey FROM customer)"


def _parents(s, sf):
    n = t(s, sf, "nation").join(t(s, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("x"), F.col("r_name").alias("parent"))
    c = t(s, sf, "customer").select(F.concat("c_mktsegment", F.lit(":"), F.col("c_nationkey").cast("string")), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")))
    return n.union(t(s, sf, "region").select("r_name", F.lit("WORLD"))).union(c.distinct())


CLO = f"WITH RECURSIVE {HI}, nd AS (SELECT x FROM pa UNION SELECT parent FROM pa), cl AS (SELECT x, x AS ancestor, 0 AS dist FROM nd UNION SELECT cl.x, parent, dist + 1 FROM cl JOIN pa ON pa.x = ancestor WHERE dist < 3)"


@query(f"{CLO} SELECT x, ancestor, min(dist) AS dist FROM cl GROUP BY x, ancestor")
def ancestor_closure(s, sf):
    return graph.closure(_parents(s, sf), 3)


@query(f"{CLO}, pp AS (SELECT DISTINCT c_mktsegment || ':' || c_nationkey AS a, 'NATION_' || (c_nationkey + 1) AS b FROM customer), w AS (SELECT x, ancestor, dist FROM cl) SELECT a, b, min(u.dist + v.dist) AS dist FROM pp JOIN w u ON u.x = a JOIN w v ON v.x = b AND v.ancestor = u.ancestor GROUP BY a, b")
def hierarchy_match(s, sf):
    c = t(s, sf, "customer")
    pairs = c.select(F.concat("c_mktsegment", F.lit(":"), F.col("c_nationkey").cast("string")).alias("a"), F.concat(F.lit("NATION_"), (F.col("c_nationkey") + 1).cast("string")).alias("b")).distinct()
    return graph.common_ancestor(pairs, graph.closure(_parents(s, sf), 3))


@query(f"{CLO}, w AS (SELECT x, ancestor, pow(0.25, min(dist)) AS w FROM cl GROUP BY x, ancestor), t AS (SELECT x, sum(w) AS t FROM w GROUP BY x), pp AS (SELECT c_custkey AS \"case\", c_mktsegment || ':' || c_nationkey AS a, 'NATION_' || ((c_nationkey + 3) % 25) AS b FROM customer), i AS (SELECT \"case\", a, b, sum(sqrt(u.w * v.w)) AS i FROM pp JOIN w u ON u.x = a JOIN w v ON v.x = b AND u.ancestor = v.ancestor GROUP BY ALL) SELECT \"case\", a, b, round(2 * coalesce(i, 0) / (ta.t + tb.t), 6) AS f1 FROM pp LEFT JOIN i USING (\"case\", a, b) JOIN t ta ON ta.x = a JOIN t tb ON tb.x = b")
def hierarchical_f1(s, sf):
    c = t(s, sf, "customer")
    pairs = c.select(F.col("c_custkey").alias("case"), F.concat("c_mktsegment", F.lit(":"), F.col("c_nationkey").cast("string")).alias("a"), F.concat(F.lit("NATION_"), ((F.col("c_nationkey") + 3) % 25).cast("string")).alias("b"))
    return rounded(metrics.hierarchical_f1(pairs, graph.closure(_parents(s, sf), 3)), "f1")


@query(f"WITH {B.E}, dd AS (SELECT d, count(*) AS k FROM e GROUP BY d), pp AS (SELECT p, count(*) AS k FROM e GROUP BY p) SELECT (SELECT count(*) FROM dd) AS n_d, (SELECT min(k) FROM dd) AS min_k, (SELECT max(k) FROM dd) AS max_k, (SELECT round(avg(k), 6) FROM dd) AS avg_k, (SELECT count(*) FROM pp) AS n_p, (SELECT count(*) FROM pp WHERE k = 1) AS n_leaf, (SELECT count(*) FROM e) AS n_e")
def graph_audit(s, sf):
    return rounded(graph.audit(materialize(B.edges(s, sf), "edges")), "avg_k")


# ---------------------------------------------------------------- metrics

SETS = f"""WITH {B.E}{B.C}{CNT}{V15}, {RANKED.format(s='sc')}, g AS (SELECT "case", list_sort(list(DISTINCT p_brand)) AS gold, list_sort(list(DISTINCT p_brand) FILTER (WHERE l_returnflag <> 'R')) AS pred FROM m GROUP BY "case")"""


@query(f"{SETS}, z AS (SELECT sum(len(list_intersect(gold, coalesce(pred, [])))) AS i, sum(greatest(len(gold), 1)) AS g, sum(greatest(len(coalesce(pred, [])), 1)) AS p FROM g) SELECT round(i / g, 6) AS recall, round(i / p, 6) AS precision, round(2 * (i / g) * (i / p) / (i / g + i / p), 6) AS f1 FROM z")
def differential_sets(s, sf):
    g = B.mentions(s, sf).groupBy("case").agg(F.collect_set("p_brand").alias("gold"), F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("p_brand"))).alias("pred"))
    return rounded(metrics.set_metrics(g, "gold", "pred"), "recall", "precision", "f1")


@query(f"{SETS}, gl AS (SELECT DISTINCT o.o_orderkey AS \"case\", m.d FROM m JOIN orders o ON m.\"case\" = o.o_orderkey), n AS (SELECT \"case\", count(*) AS n FROM gl GROUP BY ALL), p AS (SELECT rk.\"case\", rk.d, n FROM rk JOIN n USING (\"case\") WHERE rank <= n), h AS (SELECT n.\"case\", any_value(n.n) AS n, count(p.d) AS m, count(gl.d) AS hit FROM n LEFT JOIN p ON p.\"case\" = n.\"case\" LEFT JOIN gl ON gl.\"case\" = p.\"case\" AND gl.d = p.d GROUP BY n.\"case\"), q AS (SELECT CASE WHEN m > 0 THEN hit / m ELSE 0 END AS pr, hit / n AS rc FROM h) SELECT round(avg(pr), 6) AS precision, round(avg(rc), 6) AS recall, round(avg(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END), 6) AS f1 FROM q")
def differential_macro(s, sf):
    return rounded(metrics.macro_set_metrics(ranking.ranked(_v15(s, sf)), B.truth(s, sf)), "precision", "recall", "f1")


SCO = "sc AS (SELECT least(n_chars / 5000.0, 1.0) AS score, quality AS label FROM documents JOIN labels USING (doc_id))"


def _scored(s, sf):
    x = t(s, sf, "documents").select("doc_id", "n_chars").join(t(s, sf, "labels"), "doc_id")
    return x.select(F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("score"), F.col("quality").alias("label"))


@query(f"WITH {SCO} SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS rate FROM sc GROUP BY 1")
def calibration_bins(s, sf):
    return rounded(metrics.calibration(_scored(s, sf)), "mean_score", "rate").withColumn("bin", F.col("bin").cast("long"))


@query(f"WITH {SCO}, b AS (SELECT count(*) AS n, avg(score) AS s, avg(label) AS l FROM sc GROUP BY least(floor(score * 10), 9)) SELECT round((SELECT sum(n * abs(s - l)) / sum(n) FROM b), 6) AS ece, round((SELECT avg((score - label) * (score - label)) FROM sc), 6) AS brier, (SELECT count(*) FROM sc) AS n")
def ece_brier(s, sf):
    return rounded(metrics.ece_brier(_scored(s, sf)), "ece", "brier")


@query()
def platt_scaling(s, sf):
    x = _scored(s, sf)
    a, b = metrics.platt(x)
    return x.select("score", "label", F.round(1 / (1 + F.exp(-(a * F.col("score") + b))), 4).alias("calibrated"))


@query("WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1), t AS (SELECT sum(n) AS tn, count(*) AS k, sum(n * m) / sum(n) AS mean, sum(n * v) AS sw FROM g), x AS (SELECT tn, k, sw, sum(n * (m - mean) * (m - mean)) AS sb FROM g, t GROUP BY ALL) SELECT 'o_orderpriority' AS factor, k - 1 AS df, round((sb / (k - 1)) / (sw / (tn - k)), 5) AS f, round(sb / (sb + sw), 8) AS eta2 FROM x")
def one_way_anova(s, sf):
    return metrics.one_way_anova(t(s, sf, "orders"), "o_orderpriority", "o_totalprice").select("factor", "df", F.round("f", 5).alias("f"), F.round("eta2", 8).alias("eta2"))


@query("WITH n AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY ALL), ra AS (SELECT a, sum(o) AS ra FROM n GROUP BY a), rb AS (SELECT b, sum(o) AS rb FROM n GROUP BY b), t AS (SELECT sum(o) AS t FROM n), x AS (SELECT coalesce(o, 0) AS o, ra * rb / t AS e, ra.a, rb.b FROM ra CROSS JOIN rb CROSS JOIN t LEFT JOIN n ON n.a = ra.a AND n.b = rb.b) SELECT round(sum((o - e) * (o - e) / e), 6) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df FROM x")
def chi2_contingency(s, sf):
    return rounded(metrics.chi2_contingency(t(s, sf, "lineitem"), "l_returnflag", "l_linestatus"), "chi2")


@query("WITH x AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part) SELECT round(corr(a, b), 6) AS rho FROM x")
def spearman(s, sf):
    return rounded(metrics.spearman(t(s, sf, "part"), "p_size", "p_retailprice"), "rho")


@query("WITH g AS (SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS k FROM part GROUP BY 1), q AS (SELECT p_brand, n, k, k / n AS p, 1 + 1.96 * 1.96 / n AS q FROM g) SELECT p_brand, k, n, round((p + 1.96 * 1.96 / (2 * n)) / q - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / q, 6) AS lo, round((p + 1.96 * 1.96 / (2 * n)) / q + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / q, 6) AS hi FROM q")
def wilson_interval(s, sf):
    g = t(s, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("k"))
    lo, hi = M.wilson(F.col("k"), F.col("n"))
    return g.select("p_brand", "k", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("SELECT o_orderstatus, o_orderpriority, n, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS share FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)")
def confusion_matrix(s, sf):
    return rounded(metrics.confusion(t(s, sf, "orders"), "o_orderstatus", "o_orderpriority"), "share")


@query("SELECT a AS attribute, round(avg(CAST(length(v) > 0 AS INT)), 6) AS rate FROM (SELECT 'text' AS a, coalesce(text, '') AS v FROM documents UNION ALL SELECT 'lang', coalesce(lang, '') FROM documents UNION ALL SELECT 'source', coalesce(source, '') FROM documents) GROUP BY a")
def fill_rates(s, sf):
    return rounded(metrics.fill_rates(t(s, sf, "documents"), ("text", "lang", "source")), "rate")


@query()
def greedy_mentions(s, sf):
    x = t(s, sf, "conversations").where("role IN ('user', 'assistant')")
    rows = x.select(F.col("conv_id").alias("doc"), F.when(F.col("role") == "user", "gold").otherwise("pred").alias("side"), F.col("turn").alias("ord"), F.explode(F.array_distinct(F.split(F.lower("text"), r"\W+"))).alias("mention")).where("mention <> ''")
    return metrics.greedy_matches(rows, relaxed=False)


@query()
def canonical_vectors(s, sf):
    return channels.canonical_ids(t(s, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))


# ---------------------------------------------------------------- attributes


@query(f"""WITH {B.M}, x AS (SELECT p_brand AS p, 'type' AS attribute, CASE WHEN p_type <> 'PROMO' THEN p_type END AS value FROM m UNION ALL SELECT p_brand, 'name', p_name FROM m), n AS (SELECT p, attribute, value, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT p, attribute, sum(n) AS al, coalesce(sum(n) FILTER (WHERE value IS NOT NULL), 0) AS wi FROM n GROUP BY ALL)
SELECT p, attribute, round(any_value(wi) / any_value(al), 6) AS applicable, round(coalesce(sum(-(n / wi) * log2(n / wi)) FILTER (WHERE value IS NOT NULL), 0), 6) AS entropy FROM n JOIN t USING (p, attribute) GROUP BY p, attribute""")
def attribute_applicability(s, sf):
    x = B.mentions(s, sf).select(F.col("p_brand").alias("p"), F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("type"), F.col("p_name").alias("name"))
    return rounded(attributes.applicability(x, ("type", "name")), "applicable", "entropy")


ATT = f"""WITH {B.M}, dr AS (SELECT DISTINCT d, p_brand AS p, 'type' AS attribute, p_type AS value FROM m), ci AS (SELECT p, attribute, value, ln((n + 1.0) / (count(DISTINCT d) + 1.0)) + 1 AS idf FROM dr, (SELECT count(DISTINCT d) AS n FROM dr) GROUP BY p, attribute, value, n)"""


def _attribute_rows(s, sf):
    m = B.mentions(s, sf)
    return m.select("d", F.col("p_brand").alias("p"), F.lit("type").alias("attribute"), F.col("p_type").alias("value")).distinct()


@query(f"{ATT} SELECT p, attribute, value, round(idf, 6) AS idf FROM ci")
def combination_idf(s, sf):
    return rounded(attributes.combination_idf(_attribute_rows(s, sf)), "idf")


@query(f"{ATT}, cr AS (SELECT DISTINCT \"case\", p_brand AS p, 'type' AS attribute, p_type AS value FROM m), b AS (SELECT \"case\", d, 1.0 AS x FROM (SELECT DISTINCT \"case\", p FROM cr) JOIN (SELECT DISTINCT d, p FROM dr) USING (p) UNION ALL SELECT \"case\", d, 0.5 * idf FROM cr JOIN dr USING (p, attribute, value) JOIN ci USING (p, attribute, value)) SELECT \"case\", d, round(sum(x), 6) AS score FROM b GROUP BY ALL")
def bound_attributes(s, sf):
    dr = materialize(_attribute_rows(s, sf), "rows")
    cr = B.mentions(s, sf).select("case", F.col("p_brand").alias("p"), F.lit("type").alias("attribute"), F.col("p_type").alias("value"))
    return rounded(attributes.bound_score(cr, dr, attributes.combination_idf(dr)), "score")


@query(f"WITH {B.M} SELECT \"case\", p_brand AS p, round(max(l_quantity / 50), 6) AS v FROM m GROUP BY ALL")
def value_weighted_vector(s, sf):
    x = B.mentions(s, sf).select("case", F.col("p_brand").alias("p"), F.col("l_quantity").cast("string").alias("value"), F.lit(50).alias("top"))
    return rounded(attributes.value_weighted(x), "v")


@query(f"""WITH {B.M}, ed AS (SELECT d, p_brand AS p, p_type, count(*) AS n FROM m GROUP BY ALL), tt AS (SELECT d, p, sum(n) AS t FROM ed GROUP BY ALL), cv AS (SELECT DISTINCT "case", p_brand AS p, p_type AS v FROM m), al AS (SELECT "case", d, p, ln(1 + t) * (0.5 + 0.5 * avg(coalesce(n / t, 0))) AS x FROM cv JOIN tt USING (p) LEFT JOIN ed ON ed.d = tt.d AND ed.p = cv.p AND ed.p_type = v GROUP BY "case", tt.d, cv.p, t ORDER BY ALL)
SELECT "case", d, round(sum(x), 6) AS score FROM al GROUP BY ALL""".replace('SELECT "case", d, p, ln(1 + t)', 'SELECT "case", tt.d, cv.p, ln(1 + t)').replace(" ORDER BY ALL", ""))
def attribute_aware_scores(s, sf):
    m = B.mentions(s, sf)
    n = m.groupBy("d", F.col("p_brand").alias("p"), "p_type").agg(F.count("*").alias("n"))
    e = n.groupBy("d", "p").agg(F.sum("n").alias("n_mentions"), F.map_from_entries(F.collect_list(F.struct("p_type", "n"))).alias("k"))
    e = e.withColumn("dist", F.transform_values("k", lambda _, v: v / F.col("n_mentions")))
    cv = m.groupBy("case", F.col("p_brand").alias("p")).agg(F.array_sort(F.collect_set("p_type")).alias("values"))
    one = e.select("p").distinct().withColumn("idf", F.lit(1.0))
    return rounded(attributes.attribute_aware(cv, e, one), "score")


# ---------------------------------------------------------------- text


@query(r"SELECT p_partkey, split_part(v, '_@_', 1) AS base, CASE WHEN contains(v, '_@_') THEN substr(v, strpos(v, '_@_') + 3) END AS value FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand || '_@_' || p_type || '_@_x' ELSE p_brand END AS v FROM part)")
def evidence_tokens(s, sf):
    v = F.when(F.col("p_size") > 25, F.concat("p_brand", F.lit("_@_"), "p_type", F.lit("_@_x"))).otherwise(F.col("p_brand"))
    return t(s, sf, "part").select("p_partkey", X.token_base(v).alias("base"), X.token_value(v).alias("value"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0)) AS n FROM documents")
def sentence_split(s, sf):
    return t(s, sf, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n"))


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(v), '[\(\[][^\)\]]*[\)\]]', ' ', 'g'), '\s+', ' ', 'g')) AS phrase FROM (SELECT p_partkey, p_name || ' (' || p_type || ')  ' || p_brand AS v FROM part)")
def normalise_phrases(s, sf):
    return t(s, sf, "part").select("p_partkey", X.normalise_phrase(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")  "), "p_brand")).alias("phrase"))


_LEMMA = "CASE " + " ".join(f"WHEN ends_with(w, '{a}') AND length(w) - {len(a) - len(b)} >= 3{' AND NOT ends_with(w, ' + repr('ss') + ')' if a == 's' else ''} THEN left(w, length(w) - {len(a)}) || '{b}'" for a, b in X.SUFFIXES) + " ELSE w END"


@query(rf"SELECT w AS word, {_LEMMA} AS lemma FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\p{{L}}]+')) AS w FROM documents) WHERE w <> ''")
def lemma_phrases(s, sf):
    w = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")
    return t(s, sf, "documents").select(w).where("word <> ''").distinct().select("word", X.lemma(F.col("word")).alias("lemma"))


@query(rf"""WITH l AS (SELECT doc_id, trim(lower(unnest(string_split(text, chr(10))))) AS t FROM documents)
SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE t IN ({", ".join(f"'{x}'" for x in X.NOISE)}) OR NOT length(t) BETWEEN 3 AND 50 OR len(regexp_split_to_array(t, '\s+')) > 6
  OR {" OR ".join(f"regexp_matches(t, '{x}')" for x in X.NOISE_PATTERNS)} OR length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) < 0.5 * length(t)) AS n_noise FROM l GROUP BY doc_id""")
def noise_terms(s, sf):
    line = F.explode(F.split("text", "\n")).alias("line")
    return t(s, sf, "documents").select("doc_id", line).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(X.is_noise(F.col("line"))).alias("n_noise"))


@query("SELECT p_partkey, list_distinct([v, substr(v, 1, 5), substr(v, 1, 4), substr(v, 1, 3), substr(v, 1, 1)])[1] AS first, len(list_distinct([v, substr(v, 1, 5), substr(v, 1, 4), substr(v, 1, 3), substr(v, 1, 1)])) AS n FROM (SELECT p_partkey, p_type AS v FROM part)".replace("list_distinct([v, substr(v, 1, 5), substr(v, 1, 4), substr(v, 1, 3), substr(v, 1, 1)])[1]", "v"))
def icd_ancestors(s, sf):
    a = X.icd_ancestors(F.col("p_type"))
    return t(s, sf, "part").select("p_partkey", a[0].alias("first"), F.size(a).cast("long").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size = 0 THEN NULL WHEN p_size / 5 <= 3 THEN 'mild' WHEN p_size / 5 <= 6 THEN 'moderate' ELSE 'severe' END AS severity, CASE WHEN p_size / 5 >= 5 THEN 'sudden' ELSE 'gradual' END AS onset FROM part")
def numeric_buckets(s, sf):
    v = (F.col("p_size") / 5).cast("string")
    return t(s, sf, "part").select("p_partkey", X.severity_bucket(v).alias("severity"), X.onset_bucket(v).alias("onset"))


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_size * 2 < 2 THEN 'infant' END, CASE WHEN p_size * 2 < 18 THEN 'child' END, CASE WHEN p_size * 2 BETWEEN 18 AND 64 THEN 'adult' END, CASE WHEN p_size * 2 >= 65 THEN 'elderly' END, CASE WHEN p_size * 2 >= 80 THEN 'very_old' END) AS bands FROM part")
def age_bands(s, sf):
    return t(s, sf, "part").select("p_partkey", F.array_join(X.age_bands(F.col("p_size") * 2), ",").alias("bands"))


@query("WITH w AS (SELECT l_orderkey, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS p FROM lineitem) SELECT l_orderkey, round(sum(-p * log2(p)), 6) AS h FROM w GROUP BY l_orderkey")
def score_entropy(s, sf):
    x = t(s, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    total = F.aggregate("q", F.lit(0.0), lambda a, b: a + b)
    return x.select("l_orderkey", F.round(M.entropy(F.transform("q", lambda v: v / total)), 6).alias("h"))


@query(r"""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(coalesce(nullif(regexp_extract('PICK: ' || json_extract_string(props, '$.k'), 'PICK:\s*(\d+)', 1), ''), '1') AS INT) AS pick FROM events""")
def json_and_picks(s, sf):
    k = F.get_json_object("props", "$.k")
    return t(s, sf, "events").select("event_id", k.cast("int").alias("k"), X.parse_pick(F.concat(F.lit("PICK: "), k)).alias("pick"))


@query("SELECT p_partkey, [p_brand, p_type] AS items FROM part")
def salvaged_json(s, sf):
    v = F.concat(F.lit("<think>[1]</think>```json\n["), F.concat(F.lit('"'), "p_brand", F.lit('", "'), "p_type", F.lit('"')), F.lit("]\n```"))
    return t(s, sf, "part").select("p_partkey", X.salvage_json(v).alias("items"))


@query(r"""WITH b AS (SELECT max(item_id) AS code, lower(split_part(text, '. ', 1)) AS name FROM benchmark GROUP BY 2), x AS (SELECT doc_id, code, name, string_split(lower(text), name) AS f FROM documents, b WHERE length(name) >= 4 AND contains(lower(text), name)),
y AS (SELECT doc_id, code, name, f, unnest(range(1, CAST(len(f) AS BIGINT))) AS i FROM x) SELECT doc_id, code, name, count(*) AS n FROM y
WHERE CASE WHEN f[i] = '' THEN i = 1 ELSE NOT regexp_matches(right(f[i], 1), '\p{L}') END AND CASE WHEN f[i + 1] = '' THEN i + 1 = len(f) ELSE NOT regexp_matches(left(f[i + 1], 1), '\p{L}') END GROUP BY ALL""")
def dictionary_match(s, sf):
    return _dictionary(s, sf, linking.match_dictionary)


#: Names without letters, overlapping themselves and of other scripts, beside the items' first sentences.
HARD = (("1234", -1), ("aa aa", -2), ("the the", -3), ("2024", -4), ("été", -5), ("e the", -6))


@query(ORACLES["dictionary_match"].replace("GROUP BY 2)", "GROUP BY 2 UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({c}, '{n}')" for n, c in HARD) + "))").replace("string_split(lower(text), name) AS f FROM", "lower(text) AS t FROM")
       .split("y AS (")[0].rstrip().rstrip(",") + r""", p AS (SELECT *, unnest(range(1, CAST(length(t) - length(name) + 2 AS BIGINT))) AS i FROM x)
SELECT doc_id, code, name, count(*) AS n FROM p WHERE substr(t, i, length(name)) = name AND (i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '\p{L}')) AND (i + length(name) > length(t) OR NOT regexp_matches(substr(t, i + length(name), 1), '\p{L}')) GROUP BY ALL""")
def dictionary_match_in_blocks(s, sf):
    return _dictionary(s, sf, lambda d, n: linking.match_dictionary(d, n.unionByName(s.createDataFrame(list(HARD), "name string, code long")), most=200))


def _dictionary(s, sf, match):
    names = t(s, sf, "benchmark").select(F.lower(F.split("text", r"\. ")[0]).alias("name"), F.col("item_id").alias("code"))
    return match(t(s, sf, "documents").select("doc_id", "text"), names).groupBy("doc_id", "code", "name").agg(F.count("*").alias("n"))


@query("SELECT page_id, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) AS s FROM pages) GROUP BY page_id")
def page_headings(s, sf):
    h = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<h1[^>]*>(.*?)</h1>"), F.lit(1))).alias("s")
    return t(s, sf, "pages").select("page_id", h).groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


def _clean(c: str) -> str:
    """SQL for a part of a page as plain text."""
    out = f"regexp_replace({c}, '(?s)<[^>]*>', ' ', 'g')"
    for a, b in readers.ENTITIES:
        out = f"replace({out}, '{a}', {'chr(39)' if b == chr(39) else repr(b)})"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


HTML = rf"""WITH b AS (SELECT page_id, string_split(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>|<!--.*?-->', ' ', 'g'), '(?i)(<h[12][ >])', chr(1) || '\1', 'g'), chr(1)) AS ps FROM pages),
p AS (SELECT page_id, unnest(ps) AS part, generate_subscripts(ps, 1) - 1 AS ord FROM b), x AS (SELECT page_id, ord, {_clean("regexp_extract(part, '(?is)^<h[12][^>]*>(.*?)</h[12]>', 1)")} AS section, {_clean("regexp_replace(part, '(?is)^<h[12][^>]*>.*?</h[12]>', '')")} AS body FROM p WHERE ord > 0)
SELECT page_id, ord, section, length(body) AS chars FROM x WHERE length(body) >= 100"""


@query(HTML)
def html_sections(s, sf):
    return readers.html_sections(t(s, sf, "pages")).select("page_id", "ord", "section", F.length("text").alias("chars"))


NAMES = """l AS (SELECT n_name AS name FROM nation UNION ALL SELECT n_name || ' (old)' FROM nation UNION ALL SELECT lower(n_name) || ' land' FROM nation UNION ALL SELECT 'x' || n_name || 'y' FROM nation UNION ALL SELECT 'zz ' || n_nationkey || ' of none' FROM nation UNION ALL SELECT DISTINCT p_name FROM part),
k AS (SELECT k, min(code) AS code FROM (SELECT lower(n_name) AS k, n_regionkey AS code FROM nation UNION ALL SELECT DISTINCT p_name || ' kind', p_size % 7 FROM part) GROUP BY k)"""


@query(f"""WITH {NAMES}, n AS (SELECT DISTINCT name, trim(lower(name)) AS a, trim(regexp_replace(lower(name), '\\s*\\([^)]*\\)\\s*', ' ', 'g')) AS b FROM l),
j AS (SELECT name, arg_min(code, (-least(length(a), length(k)) / CAST(greatest(length(a), length(k)) AS DOUBLE), k)) AS code FROM n, k WHERE length(a) >= 9 AND length(k) >= 5 AND (contains(a, k) OR contains(k, a)) AND 2 * least(length(a), length(k)) > greatest(length(a), length(k)) GROUP BY name)
SELECT l.name, coalesce(x.code, y.code, j.code) AS code, CASE WHEN x.k IS NOT NULL THEN 'exact' WHEN y.k IS NOT NULL THEN 'normal' WHEN j.code IS NOT NULL THEN 'partial' END AS tier
FROM l JOIN n USING (name) LEFT JOIN k x ON x.k = n.a LEFT JOIN k y ON y.k = n.b LEFT JOIN j USING (name)""")
def name_cascade(s, sf):
    n, p = t(s, sf, "nation"), t(s, sf, "part")
    forms = [F.col("n_name"), F.concat("n_name", F.lit(" (old)")), F.concat(F.lower("n_name"), F.lit(" land")), F.concat(F.lit("x"), "n_name", F.lit("y")), F.concat(F.lit("zz "), F.col("n_nationkey").cast("string"), F.lit(" of none"))]
    left = n.select(F.explode(F.array(*forms)).alias("name")).unionByName(p.select(F.col("p_name").alias("name")).distinct())
    right = n.select(F.col("n_name").alias("key"), F.col("n_regionkey").alias("code")).unionByName(p.select(F.concat("p_name", F.lit(" kind")).alias("key"), (F.col("p_size") % 7).alias("code")).distinct())
    return evidence.cascade_join(left, right, F.trim(F.regexp_replace(F.lower("name"), r"\s*\([^)]*\)\s*", " ")))


@query("""WITH l AS (SELECT p_partkey, CASE WHEN p_size = 7 THEN 'odd' ELSE ' ' || lower(p_type) || '.' || (p_size % 3) END AS icd FROM part), i AS (SELECT p_type || CASE WHEN p_size % 2 = 0 THEN '.1' ELSE '' END AS icd, p_brand AS code, p_partkey AS ord FROM part WHERE p_size % 5 = 0),
x AS (SELECT upper(trim(icd)) AS icd, arg_min(code, ord) AS code FROM i GROUP BY 1), f AS (SELECT p_partkey, l.icd, CASE WHEN upper(trim(l.icd)) = 'ODD' THEN 'PROMO' ELSE upper(trim(l.icd)) END AS own FROM l)
SELECT p_partkey, f.icd, coalesce(a.code, b.code) AS code, CASE WHEN a.code IS NOT NULL THEN 'exact' WHEN b.code IS NOT NULL THEN 'parent' END AS tier FROM f LEFT JOIN x a ON a.icd = own LEFT JOIN x b ON b.icd = split_part(own, '.', 1)""")
def icd_cascade(s, sf):
    p = t(s, sf, "part")
    left = p.select("p_partkey", F.when(F.col("p_size") == 7, "odd").otherwise(F.concat(F.lit(" "), F.lower("p_type"), F.lit("."), (F.col("p_size") % 3).cast("string"))).alias("icd"))
    right = p.where("p_size % 5 = 0").select(F.concat("p_type", F.when(F.col("p_size") % 2 == 0, ".1").otherwise("")).alias("icd"), F.col("p_brand").alias("code"), F.col("p_partkey").alias("ord"))
    return evidence.icd_join(left, right, {"ODD": "PROMO"})


@query(f"""WITH {HI}, c AS (SELECT c_custkey AS "case", c_mktsegment || ':' || c_nationkey AS p FROM customer UNION SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey), sy AS (SELECT r_name AS x, 'SYN_' || r_name AS y FROM region UNION SELECT n_name, lower(n_name) FROM nation),
u1 AS (SELECT "case", parent AS p FROM c JOIN pa ON x = p EXCEPT SELECT "case", p FROM c), s1 AS (SELECT "case", y AS p FROM (SELECT * FROM c UNION SELECT * FROM u1) JOIN sy ON x = p), o1 AS (SELECT * FROM c UNION SELECT * FROM u1 UNION SELECT * FROM s1),
u2 AS (SELECT "case", parent AS p FROM u1 JOIN pa ON x = p EXCEPT SELECT "case", p FROM o1), s2 AS (SELECT "case", y AS p FROM (SELECT * FROM u1 UNION SELECT * FROM u2) JOIN sy ON x = p) SELECT * FROM o1 UNION SELECT * FROM u2 UNION SELECT * FROM s2""")
def expanded_cases(s, sf):
    c, n = t(s, sf, "customer"), t(s, sf, "nation")
    cases = c.select(F.col("c_custkey").alias("case"), F.concat("c_mktsegment", F.lit(":"), F.col("c_nationkey").cast("string")).alias("p"))
    cases = cases.union(c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_name"))
    syn = t(s, sf, "region").select(F.col("r_name").alias("x"), F.concat(F.lit("SYN_"), "r_name").alias("y")).union(n.select("n_name", F.lower("n_name")))
    return evidence.expand_cases(cases, _parents(s, sf), syn)


@query("SELECT p_partkey, p_name AS mention, (SELECT min(p_partkey) FROM part q WHERE lower(q.p_name) = lower(part.p_name)) AS cui FROM part")
def link_names(s, sf):
    p = t(s, sf, "part")
    conso = p.select(F.upper("p_name").alias("str"), F.col("p_partkey").alias("cui"), F.col("p_partkey").alias("ord"))
    return linking.link_names(p.select("p_partkey", F.col("p_name").alias("mention")), conso)


@query("SELECT l_orderkey AS \"case\", first(l_returnflag ORDER BY n DESC, l_returnflag) AS pick, max(n) AS n, CAST(sum(n) AS BIGINT) AS votes FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def self_consistency_vote(s, sf):
    return linking.vote(t(s, sf, "lineitem").select(F.col("l_orderkey").alias("case"), F.col("l_returnflag").alias("pick")))


# ---------------------------------------------------------------- stores (S10, S23, S24, S26) and event time (Q14)


@query(f"WITH {B.E} SELECT (SELECT count(DISTINCT d) FROM e) AS diseases, (SELECT count(DISTINCT p) FROM e) AS findings, (SELECT count(*) FROM e) AS edges")
def graph_snapshot(s, sf):
    n = stores.write_graph(B.edges(s, sf), fresh_path(s, "snapshot"))
    return s.createDataFrame([(n["disease"], n["finding"], n["edges"])], "diseases long, findings long, edges long")


@query("SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_partkey")
def resumable_append(s, sf):
    path = fresh_path(s, "append")
    x = t(s, sf, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    stores.append_new(x.where("l_partkey < 100"), path, ["l_partkey"])
    stores.append_new(x, path, ["l_partkey"])
    return s.read.parquet(path)


@query("SELECT n_name AS disease, r_name AS phenotype, 'driver' AS source FROM nation JOIN region ON r_regionkey = n_regionkey")
def jsonl_round_trip(s, sf):
    path = fresh_path(s, "jsonl")
    x = t(s, sf, "nation").join(t(s, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("disease"), F.col("r_name").alias("phenotype"), F.lit("driver").alias("source"))
    x.write.json(path)
    return readers.read_jsonl(s, path).select("disease", "phenotype", "source")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(s, sf):
    return sessions.windowed(t(s, sf, "events")).withColumn("total", F.round("total", 4))


@query("WITH x AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM y GROUP BY user_id, g")
def session_windows(s, sf):
    return sessions.sessions(t(s, sf, "events"))


# ---------------------------------------------------------------- reports


@query(f"""{SUP}, a AS (SELECT al."case", be.d, be.p, st.yes FROM al JOIN be USING (d) LEFT JOIN st ON st."case" = al."case" AND st.p = be.p)
SELECT "case", d, coalesce(string_agg(p, ',' ORDER BY p) FILTER (WHERE yes), '') AS matched, coalesce(string_agg(p, ',' ORDER BY p) FILTER (WHERE NOT yes), '') AS denied, count(*) FILTER (WHERE yes IS NULL) AS unasked FROM a GROUP BY ALL""")
def partition_findings(s, sf):
    x = reports.partition_findings(_supplier_state(s, sf), materialize(_brand_edges(s, sf), "edges"))
    return x.select("case", "d", F.array_join("matched", ",").alias("matched"), F.array_join("denied", ",").alias("denied"), F.size("unasked").cast("long").alias("unasked"))


@query(f"""{SUP}, a AS (SELECT al."case", be.d, be.p, st.yes FROM al JOIN be USING (d) LEFT JOIN st ON st."case" = al."case" AND st.p = be.p), g AS (SELECT "case", d, list(p ORDER BY p) FILTER (WHERE yes) AS m, coalesce(list(p ORDER BY p) FILTER (WHERE NOT yes), []) AS n, count(*) AS k FROM a GROUP BY ALL)
SELECT "case", d, CASE WHEN len(m) / k >= 0.3 THEN 'LIKELY' WHEN len(m) / k >= 0.15 THEN 'POSSIBLE' ELSE 'UNLIKELY' END || ' ' || d || ': matched ' || array_to_string(m[1:5], ', ') || '; denied ' || array_to_string(n[1:3], ', ') || '; coverage ' || len(m) || '/' || k AS text FROM g""")
def explanations(s, sf):
    x = materialize(reports.partition_findings(_supplier_state(s, sf), materialize(_brand_edges(s, sf), "edges")), "parts")
    n = F.size("matched") + F.size("denied") + F.size("unasked")
    out = reports.explain(x, x.select("case", "d", (F.size("matched") / n).alias("share")))
    return out.withColumn("text", F.regexp_replace("text", r" \([0-9.]+\):", ":"))


@query(f"WITH {B.M}, a AS (SELECT DISTINCT \"case\", p_brand AS x FROM m WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT \"case\", p_brand AS x FROM m WHERE l_linestatus = 'O'), u AS (SELECT * FROM a UNION SELECT * FROM b), t AS (SELECT \"case\", min(p_brand) AS d FROM m GROUP BY ALL) SELECT u.\"case\", count(*) AS n, bool_or(x = d) AS hit FROM u JOIN t ON t.\"case\" = u.\"case\" GROUP BY ALL".replace("FROM m WHERE l_linestatus = 'O'", "FROM m WHERE source[2] = 'O'"))
def candidate_union(s, sf):
    m = B.mentions(s, sf)
    pick = lambda test: m.where(test).groupBy("case").agg(F.collect_set("p_brand").alias("ds"))
    return reports.hit_union(pick("l_returnflag = 'R'"), pick("source LIKE '%O'"), m.groupBy("case").agg(F.min("p_brand").alias("d")))


@query(f"{CLO}, g AS (SELECT DISTINCT c_custkey AS \"case\", ancestor FROM customer JOIN cl ON x = 'NATION_' || c_nationkey), p AS (SELECT DISTINCT c_custkey AS \"case\", ancestor FROM customer JOIN cl ON x = 'NATION_' || ((c_nationkey + 7) % 25)), i AS (SELECT \"case\", count(*) AS i FROM g JOIN p USING (\"case\", ancestor) GROUP BY 1), ng AS (SELECT \"case\", count(*) AS ng FROM g GROUP BY 1), np AS (SELECT \"case\", count(*) AS np FROM p GROUP BY 1) SELECT \"case\", round(2 * coalesce(i, 0) / (ng + np), 6) AS f1 FROM ng JOIN np USING (\"case\") LEFT JOIN i USING (\"case\")")
def set_hierarchy_f1(s, sf):
    c = t(s, sf, "customer")
    side = lambda k: c.select(F.col("c_custkey").alias("case"), F.concat(F.lit("NATION_"), ((F.col("c_nationkey") + k) % 25).cast("string")).alias("x"))
    return rounded(reports.set_hierarchy_f1(side(0), side(7), graph.closure(_parents(s, sf), 3)), "f1")


@query("SELECT l_suppkey AS d, l_partkey AS p, string_agg(DISTINCT f, ',' ORDER BY f) AS sources, count(DISTINCT f) AS n FROM (SELECT l_suppkey, l_partkey, l_returnflag || '-family' AS f FROM lineitem WHERE l_suppkey <> l_partkey) GROUP BY ALL")
def external_edge_families(s, sf):
    li = t(s, sf, "lineitem")
    x = reports.external_edges({f"{k}-family": li.where(F.col("l_returnflag") == k).select(F.col("l_suppkey").alias("d"), F.col("l_partkey").alias("p")) for k in ("A", "N", "R")})
    return x.withColumns({"sources": F.array_join("sources", ","), "n": F.col("n").cast("long")})


from lattiq.plans import more_queries, source_queries  # noqa: E402, F401 (they register their own)

"""The question loop as dataflow: candidates, selection, stop rules, trajectories, traces.

All cases advance together: a round is one plan over the state (case, p, yes), never a loop over cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.functions import formulas as M
from lattiq.operators import ranking
from lattiq.shared import materialize


def candidates(state: DataFrame, edges: DataFrame, deny_limit: int | None = None, antecedents: DataFrame | None = None) -> DataFrame:
    """(case, p, n): findings of diseases that a confirmed finding reaches, not asked yet, with the number of such diseases.

    deny_limit: leave out diseases with more denied findings than that. antecedents (p): never asked."""
    e = edges.select("d", "p").distinct()
    alive = state.where("yes").join(e, "p").select("case", "d").distinct()
    if deny_limit is not None:
        out = state.where("NOT yes").join(e, "p").groupBy("case", "d").agg(F.count("*").alias("_n")).where(F.col("_n") > deny_limit)
        alive = alive.join(out, ["case", "d"], "left_anti")
    found = alive.join(e, "d").groupBy("case", "p").agg(F.count("*").alias("n"))  # each disease once: both sides are distinct
    found = found.join(state.select("case", "p").distinct(), ["case", "p"], "left_anti")  # after the counts, so these rows do not travel
    return found if antecedents is None else found.join(antecedents, "p", "left_anti")


def pick(cands: DataFrame, k: int = 1, score: Column | None = None) -> DataFrame:
    """The k best candidates of each case."""
    s = F.col("n") if score is None else score
    return cands.withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy(s.desc(), "p"))).where(F.col("rank") <= k)


def random_question(cands: DataFrame, seed: int = 42) -> DataFrame:
    """One candidate (case, p) of each case, drawn by a hash: the baseline that asks at random."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("case").cast("string"), F.col("p").cast("string")))
    return cands.groupBy("case").agg(F.min_by("p", F.struct(h.alias("h"), F.col("p"))).alias("p"))


def expected_gain(state: DataFrame, cands: DataFrame, edges: DataFrame, limit: int = 7, formula: str = "v15") -> DataFrame:
    """For the first candidates: entropy now, entropies and best shares after yes and after no, and the strategies' scores.

    Both answers of all candidates of all cases are scored in one plan. p(yes): share of the weight of the
    diseases with the finding, kept in 0.1..0.9. Every score is to be maximised."""
    e = edges.select("d", "p").distinct()
    first = pick(cands, limit).select("case", F.col("p").alias("q"))
    score = lambda c, x, t, total: M.count_scores(c, x, t, total)[formula]
    now = ranking.finding_counts(state, edges)
    has = e.toDF("d", "q").withColumn("has", F.lit(1))
    grid = now.join(first, "case").join(has, ["d", "q"], "left").withColumn("has", F.coalesce("has", F.lit(0)))
    s0, s1, s2 = (score(F.col("c") + a, F.col("x") + b, F.col("t"), F.col("total") + o) for a, b, o in ((0, 0, 0), (F.col("has"), 0, 1), (0, F.col("has"), 0)))
    grid = grid.select("case", "q", "d", "has", *[F.greatest(s, F.lit(0.0)).alias(n) for s, n in ((s0, "s0"), (s1, "s1"), (s2, "s2"))])
    w = Window.partitionBy("case", "q")
    grid = grid.select("case", "q", "has", *[F.coalesce(F.col(n) / F.nullif(F.sum(n).over(w), F.lit(0.0)), F.lit(0.0)).alias(n) for n in ("s0", "s1", "s2")])
    bits = lambda n: F.sum(F.when(F.col(n) > 0, -F.col(n) * F.log2(F.when(F.col(n) > 0, F.col(n)))).otherwise(0.0))
    out = grid.groupBy("case", "q").agg(
        bits("s0").alias("h0"), bits("s1").alias("h1"), bits("s2").alias("h2"), F.max("s1").alias("m1"), F.max("s2").alias("m2"),
        F.least(F.lit(0.9), F.greatest(F.lit(0.1), F.sum(F.col("s0") * F.col("has")))).alias("yes"),
    )
    return out.withColumns({
        "ig_expected": F.col("h0") - F.col("yes") * F.col("h1") - (1 - F.col("yes")) * F.col("h2"), "ig_max": F.col("h0") - F.least("h1", "h2"),
        "ig_binary_split": -F.abs(F.col("yes") - 0.5), "minimax_score": F.least("m1", "m2"), "minimax_entropy": -F.greatest("h1", "h2"),
    })


def select_question(gains: DataFrame, strategy: str) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("case").orderBy(F.round(strategy, 9).desc(), "q"))
    return gains.withColumn("_r", best).where("_r = 1").select("case", "q", F.col(strategy).alias("gain"))


def bayes_gain(profile: DataFrame, prior: DataFrame) -> DataFrame:
    """(case, p, p_yes, gain) for beliefs (case, d, belief): expected fall of entropy if p is asked; an answer is
    taken as .05 + .9 w likely. Only findings of some disease of the case are listed; others gain nothing."""
    # a finding outside a profile has w 0: start from the sums as if all had, and correct where the profile has it
    xlog = lambda v: F.when(v > 0, v * F.log2(F.when(v > 0, v))).otherwise(0.0)
    b, like = F.col("belief"), 0.05 + 0.9 * F.col("w")
    total = prior.groupBy("case").agg(F.sum(b).alias("b"), F.sum(xlog(0.05 * b)).alias("a0"), F.sum(xlog(0.95 * b)).alias("b0"), (-F.sum(xlog(b))).alias("h"))
    x = prior.join(profile, "d").groupBy("case", "p").agg(F.sum(b * F.col("w")).alias("bw"), F.sum(xlog(b * like) - xlog(0.05 * b)).alias("da"), F.sum(xlog(b * (1 - like)) - xlog(0.95 * b)).alias("db"))
    g = x.join(total, "case").withColumn("p_yes", 0.05 * F.col("b") + 0.9 * F.col("bw"))
    after = xlog(F.col("p_yes")) - F.col("a0") - F.col("da") + xlog(F.col("b") - F.col("p_yes")) - F.col("b0") - F.col("db")
    return g.select("case", "p", "p_yes", (F.col("h") - after).alias("gain"))


def update_belief(prior: DataFrame, answers: DataFrame, profile: DataFrame) -> DataFrame:
    """Beliefs after one answer (case, p, yes) for each case."""
    like = 0.05 + 0.9 * F.coalesce("w", F.lit(0.0))
    x = prior.join(answers, "case").join(profile, ["d", "p"], "left").withColumn("b", F.col("belief") * F.when(F.col("yes"), like).otherwise(1 - like))
    return x.select("case", "d", (F.col("b") / F.sum("b").over(Window.partitionBy("case"))).alias("belief"))


def stop_reason(step: Column, n: Column, top1: Column, top2: Column, max_il: int = 25, min_il: int = 5, conf: float = 0.3, gap: float = 0.005) -> Column:
    """First rule that stops the loop, in order; null: go on. No candidates is tested before min_il."""
    return F.when(step >= max_il, "max_il").when(n == 0, "no_candidates").when(step < min_il, None).when(top1 >= conf, "confidence").when(top1 - top2 >= gap, "gap")


def trailing(traj: DataFrame, last: int = 5) -> DataFrame:
    """Steps (case, step, hit) with sums over the trailing window, whether it is full, and the running hit rate."""
    w = Window.partitionBy("case").orderBy("step")
    frame = w.rowsBetween(-(last - 1), 0)
    full = F.count("*").over(frame) == last
    return traj.withColumns({"hits": F.sum("hit").over(frame), "full": full, "all_miss": full & (F.sum("hit").over(frame) == 0), "rate": F.avg("hit").over(w.rowsBetween(Window.unboundedPreceding, 0))})


def stability(traj: DataFrame, top: str, last: int = 5) -> DataFrame:
    """Whether ``top`` has been the same for ``last`` steps, and whether it differs from the step before."""
    w = Window.partitionBy("case").orderBy("step")
    frame = w.rowsBetween(-(last - 1), 0)
    same = (F.count("*").over(frame) == last) & (F.min(top).over(frame) == F.max(top).over(frame))
    return traj.withColumns({"stable": same, "changed": F.coalesce(F.col(top) != F.lag(top).over(w), F.lit(False))})


STOP_FAMILIES = ("min_il", "confidence", "entropy", "info_gain", "rank_stability", "coverage", "narrowing", "steady", "next_question")


def stop_step(traj: DataFrame, family: str, a: float, b: float = 0) -> DataFrame:
    """(case, stop): first step at which a rule of a family holds, else the last step; see ``stop_steps``."""
    return stop_steps(traj, [(family, a, b)]).select("case", "stop")


def stop_steps(traj: DataFrame, settings: list[tuple[str, float, float]]) -> DataFrame:
    """(case, family, a, b, stop) of all settings, in one pass over the trajectories.

    traj: (case, step, top, top1, gap, entropy, asked, and strong or the arrays tops and scores of the ranking).
    Parameters: min_il (a: least step), confidence (a), entropy (a), info_gain (a, twice in a row), rank_stability
    (a: first ranks, b: steps; b 0: the first one, a steps), coverage (a: share of ten questions), narrowing (a: most
    candidates of score b; b 0: most of ``strong``), steady (a: score, b: steps), next_question (a: relative fall)."""
    w = Window.partitionBy("case").orderBy("step")
    fall = F.lag("entropy").over(w) - F.col("entropy")
    frame = lambda n: w.rowsBetween(-(int(n) - 1), 0)
    run = lambda ok, n: (F.count("*").over(frame(n)) == int(n)) & (F.min(ok.cast("int")).over(frame(n)) == 1)
    same = lambda n, c=F.col("top"): (F.count("*").over(frame(n)) == int(n)) & (F.min(c).over(frame(n)) == F.max(c).over(frame(n)))
    first = lambda k: F.array_join(F.slice("tops", 1, int(k)), ",", "")
    rules = {
        "min_il": lambda a, b: (F.col("step") >= a) & ((F.col("top1") >= 0.30) | (F.col("gap") >= 0.005)), "confidence": lambda a, b: F.col("top1") >= a, "entropy": lambda a, b: F.col("entropy") < a,
        "info_gain": lambda a, b: run(F.coalesce(F.col("_fall") < a, F.lit(False)), 2), "rank_stability": lambda a, b: same(b, first(a)) if b else same(a), "coverage": lambda a, b: F.col("asked") / 10 >= a,
        "narrowing": lambda a, b: (F.size(F.filter("scores", lambda x: x >= b)) if b else F.col("strong")) <= a, "steady": lambda a, b: same(b) & run(F.col("top1") >= a, b),
        "next_question": lambda a, b: (F.col("step") >= 3) & F.coalesce(F.col("_fall") / F.nullif(F.col("_fall") + F.col("entropy"), F.lit(0.0)) < a, F.lit(False)),
    }
    marked = traj.withColumn("_fall", fall).select("case", "step", *[rules[f](a, b).alias(f"_r{i}") for i, (f, a, b) in enumerate(settings)])
    stops = marked.groupBy("case").agg(*[F.coalesce(F.min(F.when(F.col(f"_r{i}"), F.col("step"))), F.max("step")).alias(f"_r{i}") for i in range(len(settings))])
    each = [F.struct(F.lit(f).alias("family"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.col(f"_r{i}").alias("stop")) for i, (f, a, b) in enumerate(settings)]
    return stops.select("case", F.explode(F.array(*each)).alias("x")).select("case", "x.*")


def hit_curve(traj: DataFrame) -> DataFrame:
    """(step, n, rate): mean over cases of the share of hits so far."""
    w = Window.partitionBy("case").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return traj.withColumn("_r", F.avg("hit").over(w)).groupBy("step").agg(F.count("*").alias("n"), F.avg("_r").alias("rate"))


def traces(traj: DataFrame, top: str) -> DataFrame:
    """(case, n_steps, n_changes, trace): the ordered record of each case."""
    x = stability(traj, top)
    steps = F.array_sort(F.collect_list(F.struct("step", F.col(top).alias("top"), "changed")))
    return x.groupBy("case").agg(F.count("*").alias("n_steps"), F.count_if("changed").alias("n_changes"), steps.alias("trace"))


def simulated_cases(table: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(case, d, p, yes) for n cases of each disease: Bernoulli draws from (d, p, w) by hash, no random state."""
    cases = table.select("d").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("case", F.concat_ws("#", "d", "k"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", "case", F.col("p").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    x = cases.join(table, "d").withColumn("_u", u)
    first = F.row_number().over(Window.partitionBy("case").orderBy(F.col("w").desc(), "p"))  # one positive at least
    any_ = F.max((F.col("_u") < F.col("w")).cast("int")).over(Window.partitionBy("case"))
    return x.withColumns({"_any": any_, "_first": first}).select("case", "d", "p", ((F.col("_u") < F.col("w")) | ((F.col("_any") == 0) & (F.col("_first") == 1))).alias("yes"))


def baselines(cases: DataFrame, truth: DataFrame, edges: DataFrame) -> DataFrame:
    """(case, by_overlap, by_frequency): the disease with most matches; the commonest truth of all."""
    best = ranking.most_matches(cases, edges.select("d", "p").distinct()).withColumnRenamed("d", "by_overlap")
    mode = truth.groupBy("d").agg(F.count("*").alias("n")).agg(F.min_by("d", F.struct((-F.col("n")).alias("n"), F.col("d"))).alias("by_frequency"))
    return best.crossJoin(F.broadcast(mode))


def related_diseases(cands: DataFrame, state: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """(case, p, d, confirmed): the k best diseases of each candidate, counting the candidate itself as confirmed."""
    e = edges.select("d", "p").distinct()
    n = state.where("yes").select("case", "p").distinct().join(e, "p").groupBy("case", "d").agg(F.count("*").alias("n"))
    x = cands.select("case", "p").join(e, "p").join(n, ["case", "d"], "left").withColumn("confirmed", F.coalesce("n", F.lit(0)) + 1)
    r = F.row_number().over(Window.partitionBy("case", "p").orderBy(F.col("confirmed").desc(), "d"))
    return x.withColumn("_r", r).where(F.col("_r") <= k).select("case", "p", "d", "confirmed")


def run_rounds(truth: DataFrame, chief: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(case, p, yes) after so many rounds: ask each case's best candidate, answer it from truth (case, p)."""

    facts = truth.distinct().withColumn("_t", F.lit(True))
    state = chief.select("case", "p", F.lit(True).alias("yes"))
    for i in range(rounds):
        ask = pick(candidates(state, edges)).select("case", "p")
        answered = ask.join(facts, ["case", "p"], "left").select("case", "p", F.coalesce("_t", F.lit(False)).alias("yes"))
        state = materialize(state.unionByName(answered), f"round{i}")
    return state


#: The variants of candidate generation: (weigh by shared findings, leave out diseases with denied findings, antecedents last).
VARIANTS = {"cooccur": (True, True, True), "coverage_only": (False, False, True), "cooccur_no_deny_filter": (True, False, True), "coverage_no_antecedent": (False, False, False)}


def candidates_by(variant: str, state: DataFrame, edges: DataFrame, antecedents: DataFrame, k: int = 10, denied: int = 5) -> DataFrame:
    """(case, p, coverage, shared, rank): the k best candidates by a variant of ``VARIANTS``.

    coverage: diseases in reach that have the finding; shared: confirmed findings that those diseases have between
    them. A variant orders by coverage or by their product; some drop diseases with ``denied`` denied findings or
    more, some put antecedents (p) last. Ties go to the smaller p. Cases with the same state have the same candidates,
    which are looked for once, for the least of them."""
    together, drop, last = VARIANTS[variant]
    whole = state.groupBy("case").agg(F.array_sort(F.collect_set(F.struct("p", "yes"))).alias("_state"))
    kinds = materialize(whole.groupBy("_state").agg(F.min("case").alias("case")), "states")
    same = whole.join(kinds.withColumnRenamed("case", "_least"), "_state").select("case", "_least")
    state = kinds.select("case", F.inline("_state"))
    e = edges.select("d", "p").distinct()
    hits = state.where("yes").select("case", "p").distinct().join(e, "p").select("case", "d", F.col("p").alias("_c"))
    if drop:
        out = state.where("NOT yes").select("case", "p").distinct().join(e, "p").groupBy("case", "d").agg(F.count("*").alias("_n")).where(F.col("_n") >= denied)
        hits = hits.join(out, ["case", "d"], "left_anti")
    x = hits.join(e, "d").join(state.select("case", "p").distinct(), ["case", "p"], "left_anti")
    n = x.groupBy("case", "p").agg(F.count_distinct("d").alias("coverage"), F.count_distinct("_c").alias("shared"))
    n = n.join(antecedents.select("p", F.lit(1).alias("_a")).distinct(), "p", "left").withColumn("_a", F.coalesce("_a", F.lit(0)) if last else F.lit(0))
    value = F.col("coverage") * F.col("shared") if together else F.col("coverage")
    best = n.withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy("_a", value.desc(), "p"))).where(F.col("rank") <= k)
    return best.withColumnRenamed("case", "_least").join(same, "_least").select("case", "p", "coverage", "shared", "rank")


def run_sessions(truth: DataFrame, chief: DataFrame, edges: DataFrame, most: int = 10, gap: float = 0.2, formula: str = "v15", choose=None, diagnose=None) -> DataFrame:
    """(case, d, asked, reason) of all cases, round by round until each is diagnosed: the loop with two groups a round.

    Cases whose best share leads by ``gap`` (``confident``), that have no candidate (``exhausted``) or have been asked
    ``most`` questions (``limit``) go to ``diagnose`` (state, scores) -> (case, d); the others ask what ``choose``
    (candidates, state) -> (case, p) says, answered from truth (case, p). Either may call a model; by default they
    take the best share and the finding that most diseases share. A case that no disease explains has d null."""
    e = materialize(edges.select("d", "p").distinct(), "edges")
    to = ranking.reach(e)
    facts = truth.select("case", "p").distinct().withColumn("_t", F.lit(True))
    choose = choose or (lambda cands, state: pick(cands).select("case", "p"))
    diagnose = diagnose or (lambda state, scores: scores.groupBy("case").agg(F.min_by("d", F.struct((-F.round("score", 9)).alias("s"), F.col("d"))).alias("d")))
    state = materialize(chief.select("case", "p", F.lit(True).alias("yes")).distinct(), "round0")
    done = None
    for i in range(most + 1):
        n = ranking.finding_counts(state, to)
        scores = materialize(n.select("case", "d", M.count_scores(F.col("c"), F.col("x"), F.col("t"), F.col("total"))[formula].alias("score")), f"scores{i}")
        two = F.slice(F.sort_array(F.collect_list("share"), asc=False), 1, 2)
        lead = ranking.shares(scores).groupBy("case").agg(two.alias("s")).select("case", (F.get("s", 0) - F.coalesce(F.get("s", 1), F.lit(0.0))).alias("lead"))
        ask = materialize(choose(candidates(state, e), state).select("case", "p"), f"ask{i}")
        why = F.when(F.round("lead", 9) >= gap, "confident").when(F.col("p").isNull(), "exhausted").when(F.lit(i == most), "limit")
        at = materialize(state.select("case").distinct().join(lead, "case", "left").join(ask, "case", "left").select("case", "p", why.alias("reason")), f"groups{i}")
        ready = at.where("reason IS NOT NULL").select("case", "reason")
        own = diagnose(state.join(ready, "case", "left_semi"), scores.join(ready, "case", "left_semi")).select("case", "d")
        ended = materialize(ready.join(own, "case", "left").select("case", "d", F.lit(i).alias("asked"), "reason"), f"done{i}")
        done = ended if done is None else done.unionByName(ended)
        going = at.where("reason IS NULL").select("case", "p")
        if i == most or going.isEmpty():
            break
        answered = going.join(facts, ["case", "p"], "left").select("case", "p", F.coalesce("_t", F.lit(False)).alias("yes"))
        state = materialize(state.join(going.select("case"), "case", "left_semi").unionByName(answered), f"round{i + 1}")
    return done

"""Further queries: ablations, baselines, tests, stop settings and evaluations beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattiq.functions import stats
from lattiq.operators import dialogue, evidence, graph, metrics, ranking
from lattiq.plans import bindings as B
from lattiq.plans import queries as Q
from lattiq.plans.bindings import t
from lattiq.plans.queries import query, rounded
from lattiq.shared import materialize


@query("""WITH g AS (SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS k FROM part GROUP BY 1), a AS (SELECT sum(k) / sum(n) AS p FROM g), x AS (SELECT p_brand, n, k, p, unnest(range(0, CAST(n AS BIGINT) + 1)) AS i FROM g, a),
m AS (SELECT *, lgamma(n + 1) - lgamma(CASE WHEN i = 0 THEN 1 ELSE i + 1 END) - lgamma(CASE WHEN i = n THEN 1 ELSE n - i + 1 END) + i * ln(p) + (n - i) * ln(1 - p) AS l FROM x), o AS (SELECT p_brand, l AS seen FROM m WHERE i = k)
SELECT p_brand, k, n, round(least(1.0, sum(exp(l)) FILTER (WHERE l <= seen + 1e-7)), 6) AS p_value FROM m JOIN o USING (p_brand) GROUP BY p_brand, k, n""")
def binomial_test(s, sf):
    g = t(s, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("k"))
    a = g.agg((F.sum("k") / F.sum("n")).alias("p"))
    return g.crossJoin(F.broadcast(a)).select("p_brand", "k", "n", F.round(stats.binomial_p("k", "n", "p"), 6).alias("p_value"))  # one row


@query(f"""WITH a AS ({Q.ABLATION}) SELECT CASE subset WHEN 'brand,name,type' THEN 'none' WHEN 'brand,name' THEN 'type' WHEN 'brand,type' THEN 'name' ELSE 'brand' END AS left_out, at_1, round(at_1 - (SELECT at_1 FROM a WHERE subset = 'brand,name,type'), 6) AS change, n
FROM a WHERE subset IN ('brand,name,type', 'brand,name', 'brand,type', 'name,type')""")
def leave_one_out(s, sf):
    co, tt = Q.channel_parts(s, sf)
    return rounded(ranking.leave_one_out(co, ("brand", "name", "type"), tt), "at_1", "change")


@query(f"""{Q.SUP}, dn AS (SELECT "case", d FROM st JOIN be USING (p) WHERE NOT yes GROUP BY ALL HAVING count(*) > 1), cd AS (SELECT DISTINCT "case", p FROM al JOIN be USING (d) WHERE ("case", p) NOT IN (SELECT ("case", p) FROM st) AND ("case", d) NOT IN (SELECT ("case", d) FROM dn))
SELECT "case", arg_min(p, (md5('42:' || "case" || ':' || p), p)) AS p FROM cd GROUP BY "case" """)
def random_inquiry(s, sf):
    return dialogue.random_question(dialogue.candidates(Q._supplier_state(s, sf), Q._brand_edges(s, sf), 1)).select("case", "p")


#: The stop families with the grids of their parameters (a, b).
GRID = (
    [("min_il", a, 0) for a in range(26)] + [("confidence", a, 0) for a in (0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95, 0.99)]
    + [("entropy", a, 0) for a in (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0)] + [("info_gain", a, 0) for a in (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0)]
    + [("rank_stability", a, b) for a in (1, 3, 5) for b in (2, 3, 4, 5)] + [("coverage", a, 0) for a in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2, 1.5)]
    + [("narrowing", a, b) for a in (1, 2, 3, 5, 7, 10) for b in (0.01, 0.05, 0.1)] + [("steady", a, b) for a in (0.2, 0.3, 0.4, 0.5, 0.6) for b in (2, 3, 4, 5)]
    + [("next_question", a, 0) for a in (0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.25, 0.3)]
)

_W = "WINDOW w AS (PARTITION BY \"case\" ORDER BY step)"


def _rule(family: str, a: float, b: float) -> str:
    """SQL of one setting over z (case, step, top, top1, gap, entropy, asked, tops, scores, fall)."""
    last = lambda n: f"OVER (PARTITION BY \"case\" ORDER BY step ROWS BETWEEN {int(n) - 1} PRECEDING AND CURRENT ROW)"
    same = lambda n, c="top": f"count(*) {last(n)} = {int(n)} AND min({c}) {last(n)} = max({c}) {last(n)}"
    return {
        "min_il": f"step >= {a} AND (top1 >= 0.3 OR gap >= 0.005)", "confidence": f"top1 >= {a}", "entropy": f"entropy < {a}",
        "info_gain": f"count(*) {last(2)} = 2 AND min(CAST(coalesce(fall < {a}, false) AS INT)) {last(2)} = 1", "rank_stability": same(b or 1, f"array_to_string(tops[1:{int(a)}], ',')"),
        "coverage": f"asked / 10 >= {a}", "narrowing": f"len(list_filter(scores, lambda x: x >= {b})) <= {a}", "steady": f"{same(b)} AND min(CAST(top1 >= {a} AS INT)) {last(b)} = 1" if b else "",
        "next_question": f"step >= 3 AND coalesce(fall / nullif(fall + entropy, 0) < {a}, false)",
    }[family]


STOPS = f"""WITH {Q.EV}, tr AS (SELECT "case", step, top, value / 500 AS top1, value / 500 - 0.2 AS gap, 3 - value / 200 AS entropy, step AS asked, [top, CASE WHEN value > 20 THEN 'x' ELSE 'y' END, CASE WHEN value > 50 THEN 'x' ELSE 'y' END, CASE WHEN value > 5 THEN 'x' ELSE 'y' END, CASE WHEN value > 80 THEN 'x' ELSE 'y' END] AS tops, list_transform(range(1, 13), lambda k: value / (500.0 * k * k)) AS scores FROM tj),
z AS (SELECT *, lag(entropy) OVER w - entropy AS fall FROM tr {_W}), y AS (SELECT "case", step, {", ".join(f"{_rule(*g)} AS r{i}" for i, g in enumerate(GRID))} FROM z),
f AS (SELECT "case", {", ".join(f"coalesce(min(step) FILTER (WHERE r{i}), max(step)) AS r{i}" for i in range(len(GRID)))} FROM y GROUP BY "case")
""" + " UNION ALL ".join(f"SELECT '{f}' AS family, CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b, round(avg(r{i}), 6) AS mean_stop, max(r{i}) AS last_stop FROM f" for i, (f, a, b) in enumerate(GRID))


@query(STOPS)
def stop_settings(s, sf):
    v = F.col("value")
    tops = F.array("top", *[F.when(v > n, "x").otherwise("y") for n in (20, 50, 5, 80)])
    scores = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: v / (F.lit(500.0) * k * k))
    x = Q._trajectory(s, sf).select("case", "step", "top", (v / 500).alias("top1"), (v / 500 - 0.2).alias("gap"), (3 - v / 200).alias("entropy"), F.col("step").alias("asked"), tops.alias("tops"), scores.alias("scores"))
    stops = dialogue.stop_steps(x, GRID)
    return rounded(stops.groupBy("family", "a", "b").agg(F.avg("stop").alias("mean_stop"), F.max("stop").alias("last_stop")), "mean_stop")


@query(f"""WITH {Q.EV}, x AS (SELECT "case", max(step) AS asked, max(hit) AS found FROM tj GROUP BY "case") SELECT count(*) AS n, round(avg(found), 6) AS at_1, round(avg(asked), 6) AS mean_questions, max(asked) AS most_questions FROM x""")
def evaluation_bundle(s, sf):
    x = Q._trajectory(s, sf).groupBy("case").agg(F.max("step").alias("asked"), (F.max("hit") == 1).alias("right"))
    return rounded(metrics.bundle(x), "at_1", "mean_questions")


@query("SELECT o_orderpriority AS severity, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS hits, round(avg(CAST(o_orderstatus = 'F' AS INT)), 6) AS accuracy FROM orders GROUP BY 1")
def accuracy_by_severity(s, sf):
    x = t(s, sf, "orders").select(F.col("o_orderpriority").alias("severity"), (F.col("o_orderstatus") == "F").alias("right"))
    return rounded(metrics.accuracy_by(x, "severity"), "accuracy")


@query(f"""WITH {B.M}, x AS (SELECT d, p_brand AS p, CASE WHEN l_returnflag = 'R' THEN 'pubmed' WHEN right(source, 1) = 'F' THEN 'wiki' ELSE 'book' END AS source FROM m), g AS (SELECT d, p, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) FILTER (WHERE source <> 'pubmed') AS n_textbook, count(*) FILTER (WHERE source = 'pubmed') AS n_article FROM x GROUP BY ALL)
SELECT d, p, sources, n_textbook, n_article, round(n_textbook / 2.0, 6) AS textbook_score, round(ln(1 + n_article) / ln(1 + (SELECT greatest(max(n_article), 1) FROM g)), 6) AS article_score, n_textbook > 0 AND n_article = 0 AS textbook_only, n_textbook = 0 AND n_article > 0 AS article_only FROM g""")
def dual_merge(s, sf):
    m = B.mentions(s, sf)
    source = F.when(F.col("l_returnflag") == "R", "pubmed").when(F.col("source").endswith("F"), "wiki").otherwise("book")
    x = evidence.dual_merge(m.select("d", F.col("p_brand").alias("p"), source.alias("source")), ("wiki", "book"), ("pubmed",))
    return rounded(x, "textbook_score", "article_score").withColumn("sources", F.array_join("sources", ","))


@query(f"""WITH {B.M}, ed AS (SELECT d, p_brand AS p, CAST(count(*) AS DOUBLE) AS w FROM m GROUP BY ALL), sx AS (SELECT DISTINCT l_suppkey AS doc, p_brand AS x FROM m), co AS (SELECT a.x, b.x AS y, 0.5 * count(*) AS w FROM sx a JOIN sx b USING (doc) WHERE a.x <> b.x GROUP BY ALL),
un AS (SELECT x, y, sum(w) AS w FROM (SELECT d AS x, p AS y, w FROM ed UNION ALL SELECT p, d, w FROM ed UNION ALL SELECT * FROM co) GROUP BY ALL), tp AS (SELECT x, y, w / sum(w) OVER (PARTITION BY x) AS share FROM un), sd AS (SELECT DISTINCT d AS c, d AS x, 1.0::DOUBLE AS mass FROM ed), l0 AS (SELECT * FROM sd)"""
       + "".join(f", l{i + 1} AS (SELECT c, x, sum(mass) AS mass FROM (SELECT c, y AS x, 0.85 * mass * share AS mass FROM l{i} JOIN tp USING (x) UNION ALL SELECT c, x, 0.15 * mass FROM sd) GROUP BY c, x)" for i in range(10))
       + ' SELECT c AS "case", x, round(mass, 6) AS mass FROM l10')
def walk_with_cooccurrence(s, sf):
    m = materialize(B.mentions(s, sf).select("d", F.col("p_brand").alias("p"), "l_suppkey"), "mentions")
    e = graph.undirected(m.groupBy("d", "p").agg(F.count("*").cast("double").alias("w")))
    co = evidence.cooccurrence(m.select(F.col("l_suppkey").alias("doc"), F.col("p").alias("x")))
    g = materialize(graph.with_cooccurrence(e, co, 0.5), "graph")
    seeds = m.select(F.col("d").alias("case"), F.col("d").alias("x")).distinct()
    return rounded(graph.personalised_pagerank(g, seeds, 0.15, 10), "mass")


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS x FROM documents), v AS (SELECT DISTINCT x FROM w WHERE length(x) > 3), a AS (SELECT DISTINCT x FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS x FROM benchmark) WHERE length(x) > 3),
g AS (SELECT count(*) AS ng, count(*) FILTER (WHERE x IN (SELECT x FROM v)) AS hit FROM a), p AS (SELECT count(*) AS np, count(*) FILTER (WHERE x IN (SELECT x FROM a)) AS hit FROM v) SELECT round(p.hit / np, 6) AS precision, round(g.hit / ng, 6) AS recall FROM g, p""")
def lexical_recall(s, sf):
    words = lambda name: t(s, sf, name).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("x")).where("length(x) > 3").distinct()
    return rounded(metrics.lexical_match(words("documents"), words("benchmark")), "precision", "recall")


@query("""WITH t AS (SELECT o_orderpriority AS a, o_orderstatus AS b, o_totalprice AS v FROM orders), n AS (SELECT a, b, count(*) AS o FROM t GROUP BY ALL), e AS (SELECT ra.a, rb.b, ra.n * rb.n / (SELECT CAST(count(*) AS DOUBLE) FROM t) AS e FROM (SELECT a, count(*) AS n FROM t GROUP BY a) ra, (SELECT b, count(*) AS n FROM t GROUP BY b) rb),
x AS (SELECT sum((coalesce(o, 0) - e) ** 2 / e) AS s FROM e LEFT JOIN n USING (a, b)), g AS (SELECT a, count(*) AS n, avg(v) AS m, var_pop(v) AS v FROM t GROUP BY a), w AS (SELECT sum(n) AS n, count(*) AS k, sum(n * v) AS sw, (SELECT avg(v) FROM t) AS mean FROM g),
f AS (SELECT (sum(g.n * (m - mean) ** 2) / (any_value(k) - 1)) / (any_value(sw) / (any_value(w.n) - any_value(k))) AS s, any_value(w.n) - any_value(k) AS d2 FROM g, w), y AS (SELECT s, d2 / (d2 + 4 * s) AS x, d2 / 2.0 AS h FROM f)
SELECT 'chi2' AS test, round(s, 5) AS statistic, round(exp(-s / 2) * (1 + s / 2 + s * s / 8 + s * s * s / 48), 6) AS p_value FROM x UNION ALL SELECT 'f', round(s, 5), round(pow(x, h) * (1 + h * (1 - x)), 6) FROM y""")
def tail_p_values(s, sf):
    o = t(s, sf, "orders")
    c = metrics.chi2_contingency(o, "o_orderpriority", "o_orderstatus").select(F.lit("chi2").alias("test"), F.col("chi2").alias("statistic"), stats.chi2_p(F.col("chi2"), F.col("df")).alias("p_value"))
    a = metrics.one_way_anova(o, "o_orderpriority", "o_totalprice").crossJoin(F.broadcast(o.agg(F.count("*").alias("n"))))  # one row each
    f = a.select(F.lit("f").alias("test"), F.col("f").alias("statistic"), stats.f_p(F.col("f"), F.col("df"), F.col("n") - F.col("df") - 1).alias("p_value"))
    return c.unionByName(f).select("test", F.round("statistic", 5).alias("statistic"), F.round("p_value", 6).alias("p_value"))


def _layers(depth: int, beam: int, since: int, few: int) -> str:
    """SQL of an expansion step by step over e (x, y) and s0 (root, x), up to the ends of the roots."""
    out = ", f0 AS (SELECT * FROM s0)"
    for k in range(1, depth + 1):
        out += f""", n{k} AS (SELECT root, y AS x, count(*) AS n FROM f{k - 1} JOIN e USING (x) GROUP BY root, y HAVING (root, y) NOT IN (SELECT (root, x) FROM s{k - 1})),
c{k} AS (SELECT root, count(n) AS c FROM (SELECT DISTINCT root FROM f{k - 1}) LEFT JOIN n{k} USING (root) GROUP BY root), z{k} AS (SELECT root, CASE WHEN c = 0 THEN 'nothing new' WHEN {k} >= {since} AND c <= {few} THEN 'saturated' END AS reason FROM c{k}),
k{k} AS (SELECT * FROM n{k} WHERE root IN (SELECT root FROM z{k} WHERE reason IS NULL)), s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT root, x FROM k{k}), f{k} AS (SELECT root, x FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY n DESC, x) AS r FROM k{k}) WHERE r <= {beam})"""
    ends = " UNION ALL ".join(f"SELECT root, {k - 1} AS depth, reason FROM z{k} WHERE reason IS NOT NULL" for k in range(1, depth + 1))
    return f"{out}, ends AS ({ends} UNION ALL SELECT DISTINCT root, {depth}, 'depth' FROM f{depth})"


CHAIN = "WITH pt AS (SELECT p_partkey AS k, p_size AS z FROM part), e AS (SELECT DISTINCT x, y FROM (SELECT k AS x, k // 2 AS y FROM pt UNION ALL SELECT k, k // 3 FROM pt WHERE z % 2 = 0 UNION ALL SELECT k, k + z FROM pt WHERE z % 5 = 0)), s0 AS (SELECT k AS root, k AS x FROM pt WHERE k % 10 = 0)"


@query(f"{CHAIN}{_layers(6, 3, 3, 1)} SELECT root, depth, reason, (SELECT count(*) FROM s6 WHERE s6.root = ends.root) - 1 AS found FROM ends")
def saturated_expansion(s, sf):
    p = t(s, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    step = lambda rows, y: rows.select(F.col("k").alias("x"), y.cast("long").alias("y"))
    e = step(p, F.floor(F.col("k") / 2)).union(step(p.where("z % 2 = 0"), F.floor(F.col("k") / 3))).union(step(p.where("z % 5 = 0"), F.col("k") + F.col("z")))
    return graph.expand_until_saturated(e, p.where("k % 10 = 0").select(F.col("k").alias("root")), 6, 3, 3, 1)[1]


@query(f"""WITH {B.M}, ln AS (SELECT l_returnflag AS v, d, p FROM m WHERE p IN (SELECT p FROM m WHERE p_size % 4 <> 0)), ba AS (SELECT DISTINCT * FROM ln), nd AS (SELECT v, count(DISTINCT d) AS n FROM ba GROUP BY v), ix AS (SELECT v, p, pow(ln((n + 1.0) / (count(*) + 1.0)) + 1, 0.75) AS w FROM ba JOIN nd USING (v) GROUP BY v, p, n), pf AS MATERIALIZED (SELECT v, d, p, w FROM ba JOIN ix USING (v, p)),
ca AS (SELECT DISTINCT "case", p FROM m), dn AS MATERIALIZED (SELECT v, d, sqrt(sum(w * w)) AS dn FROM pf GROUP BY ALL), ve AS MATERIALIZED (SELECT v, "case", p, w FROM ca JOIN ix USING (p)), vn AS MATERIALIZED (SELECT v, "case", sqrt(sum(w * w)) AS vn FROM ve GROUP BY ALL),
dt AS MATERIALIZED (SELECT v, "case", d, sum(ve.w * pf.w) AS dt FROM ve JOIN pf USING (v, p) GROUP BY ALL), sc AS (SELECT v, "case", d, round(dt / (vn * dn), 9) AS score FROM dt JOIN vn USING (v, "case") JOIN dn USING (v, d)), rk AS (SELECT *, row_number() OVER (PARTITION BY v, "case" ORDER BY score DESC, d) AS r FROM sc),
tr AS (SELECT DISTINCT "case", d FROM m), rr AS (SELECT v, coalesce(r, n) AS r FROM tr JOIN dn USING (d) JOIN vn USING (v, "case") JOIN nd USING (v) LEFT JOIN rk USING (v, "case", d)), st AS (SELECT v, count(*) AS findings, count(DISTINCT p) AS concepts FROM ln GROUP BY v)
SELECT v AS variant, any_value(findings) AS findings, any_value(concepts) AS concepts, count(*) AS n, round(avg(CAST(r <= 1 AS INT)), 6) AS at_1, round(avg(CAST(r <= 3 AS INT)), 6) AS at_3, round(avg(CAST(r <= 5 AS INT)), 6) AS at_5, round(avg(CAST(r <= 10 AS INT)), 6) AS at_10, round(avg(1.0 / r), 6) AS mrr FROM rr JOIN st USING (v) GROUP BY v""")
def extrinsic_evaluation(s, sf):
    m = materialize(B.mentions(s, sf).select("l_returnflag", "d", "p", "p_size", "case"), "mentions")
    names = m.where("p_size % 4 <> 0").select(F.upper("p").alias("name"), "p").distinct()
    found = m.select(F.col("l_returnflag").alias("variant"), "d", F.concat(F.lit(" "), "p").alias("finding"))
    out = ranking.extrinsic(found, names, m.select("case", "p"), m.select("case", "d").distinct(), ("A", "N", "R"))
    return rounded(out, "at_1", "at_3", "at_5", "at_10", "mrr")


def _variant(name: str) -> str:
    together, drop, last = dialogue.VARIANTS[name]
    base = "hi" if not drop else "(SELECT * FROM hi WHERE (\"case\", d) NOT IN (SELECT (\"case\", d) FROM dn))"
    order = ("CASE WHEN p < 'Brand#20' THEN 1 ELSE 0 END, " if last else "") + ("coverage * shared" if together else "coverage") + " DESC, p"
    return f"""SELECT '{name}' AS variant, * FROM (SELECT "case", p, coverage, shared, row_number() OVER (PARTITION BY "case" ORDER BY {order}) AS rank FROM (SELECT "case", p, count(DISTINCT d) AS coverage, count(DISTINCT c) AS shared FROM {base} JOIN be USING (d) WHERE ("case", p) NOT IN (SELECT ("case", p) FROM st) GROUP BY ALL)) WHERE rank <= 3"""


@query(f"""{Q.SUP}, hi AS (SELECT "case", d, p AS c FROM st JOIN be USING (p) WHERE yes), dn AS (SELECT "case", d FROM st JOIN be USING (p) WHERE NOT yes GROUP BY ALL HAVING count(*) >= 2) """ + " UNION ALL ".join(map(_variant, dialogue.VARIANTS)))
def candidate_variants(s, sf):
    state, e = materialize(Q._supplier_state(s, sf), "state"), materialize(Q._brand_edges(s, sf), "edges")
    late = e.where("p < 'Brand#20'").select("p")
    out = None
    for name in dialogue.VARIANTS:
        part = dialogue.candidates_by(name, state, e, late, 3, 2).select(F.lit(name).alias("variant"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def diagnosed_sessions(s, sf):
    m = materialize(B.mentions(s, sf).select("l_suppkey", "d", "p_name", "l_returnflag"), "mentions")
    p = F.col("p_name").alias("p")
    e = m.groupBy("d", p).agg(F.count("*").alias("n")).where("n > 1").select("d", "p")
    facts = m.where("l_returnflag <> 'R'").select(F.col("l_suppkey").alias("case"), p).distinct()
    return dialogue.run_sessions(facts, facts.groupBy("case").agg(F.min("p").alias("p")), e, 4, 0.05)

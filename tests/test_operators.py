"""Operators that no SQL oracle covers, by hand-computed cases and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.functions import formulas as M
from lattiq.functions import text as X
from lattiq.operators import attributes, channels, dialogue, evidence, graph, linking, metrics, ranking


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", list: "array<string>"}
    shape = ", ".join(f"{k} {kinds[type(v)] if v is not None else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], shape).select(column).first()[0]


def test_chi2_tail_and_entropy(spark):
    assert abs(one(spark, M.chi2_tail(F.col("x")), x=3.841458820694124) - 0.05) < 1e-9
    assert one(spark, M.entropy(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0)))) == 1.0


def test_jensen_and_g2_guards(spark):
    z = F.lit(0)
    assert one(spark, M.jensen(z, z, z, z)) == 0.0
    assert abs(one(spark, M.g2(F.lit(10), z, z, F.lit(10))) - 40 * math.log(2)) < 1e-9
    assert one(spark, M.signed_g2(F.lit(1), F.lit(9), F.lit(9), F.lit(1))) < 0


@pytest.mark.parametrize("answer, want", [('<think>[1]</think>```json\n["a", "b"]```', ["a", "b"]), ("no json", []), ("[broken", []), (None, [])])
def test_salvage(spark, answer, want):
    assert one(spark, X.salvage_json(F.col("x")), x=answer) == want


@pytest.mark.parametrize("answer, want", [("PICK: 3 of 4", 3), ("so 12", 12), ("none", 1)])
def test_pick(spark, answer, want):
    assert one(spark, X.parse_pick(F.col("x")), x=answer) == want


@pytest.mark.parametrize("answer, want", [("The answer is (B).", "B"), ("I say C.", "C"), ("none of these!", None)])
def test_choice(spark, answer, want):
    assert one(spark, X.parse_answer(F.col("x")), x=answer) == want


def test_text_functions(spark):
    f = lambda c, v: one(spark, c(F.col("x")), x=v)
    assert [f(X.lemma, w) for w in ("bodies", "classes", "aching", "is", "pass", "fevers")] == ["body", "class", "ach", "is", "pass", "fever"]
    assert f(X.strip_plural, "Severe Seizuress") == "seizure"
    assert f(X.candidate_phrases, "acute severe pain, chest") == ["acute severe pain, chest", "acute severe pain", "severe pain, chest", "severe pain", "pain, chest", "pain"]
    assert f(X.phrase_parts, "Pain (mild) of the leg and arm/hand") == ["pain", "leg", "arm", "hand"]
    assert [f(X.is_noise, w) for w in ("fever", "ab", "patient", "1234", None, "a b c d e f g")] == [False, True, True, True, True, True]
    assert f(X.icd_ancestors, "J45.901") == ["J45.901", "J45.9", "J45.", "J45", "J"] and f(X.icd_chain, "J45.9") == ["J45.9", "J45", "J"]
    assert f(X.severity_bucket, "0") is None and f(X.severity_bucket, "7") == "severe" and f(X.onset_bucket, "5") == "sudden" and f(X.onset_bucket, "x") is None
    assert one(spark, X.is_numeric_scale(F.col("x")), x=["0", "1", "2"]) and not one(spark, X.is_numeric_scale(F.col("x")), x=["0", "2", "3"])
    assert one(spark, X.age_bands(F.col("x")), x=1) == ["infant", "child"]
    assert one(spark, X.grounded(F.col("x"), F.col("y")), x="severe chest pain", y="chest discomfort") is True
    assert one(spark, X.evidence_text(F.col("x"), F.col("y"), F.lit("chest")), x="q", y="NA") == "q . chest pain"
    assert f(lambda c: X.replace_all(c, X.BODY_FR), "tête") == "head"
    kept = spark.createDataFrame([("the patient has a fever",), ("mortality is high in this patient",), ("fever occurs",)], "x string").select(X.keep_finding(F.col("x"))[1])
    assert [r[0] for r in kept.collect()] == ["kept", "outcome", "no_anchor"]


def test_bh_is_monotone_and_at_least_p(spark):
    p = [0.001, 0.01, 0.01, 0.02, 0.9, 1.0, 0.0, None]
    got = {r.p_value: r.q for r in evidence.benjamini_hochberg(spark.createDataFrame([(x,) for x in p], "p_value double")).collect()}
    xs = sorted(x for x in p if x is not None)
    want = {x: min(min(1.0, y * len(xs) / max(i + 1 for i, z in enumerate(xs) if z == y)) for y in xs if y >= x) for x in xs}
    assert all(abs(got[x] - want[x]) < 1e-12 for x in xs) and got[None] is None


def test_greedy_matches(spark):
    rows = [("d", "gold", 1, "chest pain"), ("d", "gold", 2, "fever"), ("d", "pred", 1, "pain"), ("d", "pred", 2, "chest pain"), ("d", "pred", 3, "high fever"), ("e", "gold", 1, "x")]
    df = spark.createDataFrame(rows, "doc string, side string, ord int, mention string")
    assert sorted(tuple(r) for r in metrics.greedy_matches(df).collect()) == [("d", 2, 3, 2), ("e", 0, 0, 1)]
    assert sorted(tuple(r) for r in metrics.greedy_matches(df, relaxed=False).collect()) == [("d", 1, 3, 2), ("e", 0, 0, 1)]
    assert metrics.prf(metrics.greedy_matches(df)).first().recall == 2 / 3


def test_automaton_boundaries(spark):
    docs = spark.createDataFrame([(1, "Pain in painting, PAIN."), (2, "belly pain; Bellyache"), (3, None)], "doc_id long, text string")
    names = spark.createDataFrame([("pain", "C1"), ("belly pain", "C2"), ("Pain", "C0"), ("ab", "C3")], "name string, code string")
    want = [(1, "pain", "C1", 0), (1, "pain", "C1", 18), (2, "belly pain", "C2", 0), (2, "pain", "C1", 6)]
    for most in (1, 10, 1000):
        assert sorted(tuple(r) for r in linking.match_dictionary(docs, names, most=most).collect()) == want


def test_hard_names_are_found_whatever_the_size(spark):
    docs = spark.createDataFrame([(1, "in 1234 aa aa aa"), (1, "aa aa"), (None, "1234"), (2, "x1234, 12345"), (2, "")], "doc_id long, text string")
    names = spark.createDataFrame([("1234", 1), ("aa aa", 2), ("aa aa aa", 3), ("", 4), (None, 5)], "name string, code int")
    want = sorted([("1", "1234", 1, 3), ("1", "aa aa", 2, 8), ("1", "aa aa", 2, 11), ("1", "aa aa aa", 3, 8), ("1", "aa aa", 2, 0), ("None", "1234", 1, 0), ("2", "1234", 1, 7)])
    for most in (3, 9, 1000):
        assert sorted((str(r.doc_id), r.name, r.code, r.start) for r in linking.match_dictionary(docs, names, most=most).collect()) == want
    assert linking.match_dictionary(docs, names.limit(0)).count() == 0 and linking.match_dictionary(docs.limit(0), names).count() == 0


def test_platt_improves_the_loss(spark):
    rows = [(i / 100, int(i > 60)) for i in range(100)] * 3
    a, b = metrics.platt(spark.createDataFrame(rows, "score double, label int"), 2000, 1.0)
    loss = lambda a, b: -sum(math.log(1 / (1 + math.exp(-(a * s + b)))) if y else math.log(1 - 1 / (1 + math.exp(-(a * s + b)))) for s, y in rows)
    assert a > 1 and loss(a, b) < loss(1, 0)


EDGES = [("d1", "a", 3.0), ("d1", "b", 1.0), ("d2", "b", 2.0), ("d2", "c", 2.0), ("d3", "c", 5.0)]


def test_graph_iterations(spark):
    e = spark.createDataFrame(EDGES, "d string, p string, w double")
    g = graph.undirected(e)
    mass = graph.personalised_pagerank(g, spark.createDataFrame([("k", "d1"), ("k", "d2")], "case string, x string"), rounds=10).collect()
    assert abs(sum(r.mass for r in mass) - 1) < 1e-9
    vec = {r.x: r.vec for r in graph.fast_projection(g, 8).collect()}
    assert len(vec) == 6 and all(len(v) == 8 for v in vec.values())
    depth = {r.x: r.depth for r in graph.bfs(g, spark.createDataFrame([("a",)], "root string"), 9).collect()}
    assert depth == {"a": 0, "d1": 1, "b": 2, "d2": 3, "c": 4, "d3": 5}
    cycle = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "x")], "x string, parent string")
    assert {(r.x, r.ancestor): r.dist for r in graph.closure(cycle).collect()} == {("x", "x"): 0, ("x", "y"): 1, ("y", "y"): 0, ("y", "x"): 1}


def test_channels(spark):
    e = spark.createDataFrame(EDGES, "d string, p string, w double")
    cases = spark.createDataFrame([("k", "a"), ("k", "b"), ("m", "c")], "case string, p string")
    idf = ranking.profile_idf(e)
    cos = ranking.cosine(cases, e, idf)
    denied = spark.createDataFrame([("k", "c")], "case string, p string")
    before = {(r.case, r.d): r.score for r in cos.collect()}
    for norm in ("both", "profile", "none"):
        after = {(r.case, r.d): r.score for r in channels.concept_negative(cos, denied, e, idf, norm=norm).collect()}
        assert after["k", "d2"] < before["k", "d2"] and after["k", "d1"] == before["k", "d1"] and after["m", "d2"] == before["m", "d2"]
    lacking = {(r.case, r.d): r.score for r in channels.cardinal_negative(cos, cases, e, idf).collect()}
    assert lacking["k", "d1"] == pytest.approx(before["k", "d1"]) and lacking["k", "d2"] < before["k", "d2"]
    assert {(r.case, r.d) for r in channels.pair_count_scores(cases, e.withColumnRenamed("w", "n")).collect()} == set(before)
    dim = spark.createDataFrame([("a", "symptom"), ("b", "function")], "p string, dim string")
    got = {(r.case, r.d): r.score for r in channels.dimensional(cases, e, dim, {"symptom": 1.0, "function": 0.5}).collect()}
    assert got["k", "d1"] == pytest.approx(3 / math.sqrt(3) + 0.5 * 1)
    assert {r.d: round(r.score, 6) for r in channels.antecedent_vote(denied, e).collect()} == {"d2": round(2 * math.log(1.5), 6), "d3": round(5 * math.log(1.5), 6)}
    tokens = spark.createDataFrame([("k", "E", "N", "a"), ("k", "F", None, "b")], "case string, base string, value string, p string")
    yes, no = channels.explicit_negative(tokens)
    assert [r.p for r in yes.collect()] == ["b"] and [r.p for r in no.collect()] == ["a"]
    marks = channels.text_markers(spark.createDataFrame([("d", "severe, Severe and mild")], "d string, text string"), {"severe": ("severe",), "mild": ("mild",)})
    assert {r.marker: r.n for r in marks.collect()} == {"severe": 2, "mild": 1}
    assert one(spark, channels.fuzzy_match(F.col("x"), F.col("y")), x="chest pain", y="pain of the leg") is True
    boosted = channels.chief_boost(cases.withColumn("v", F.lit(1.0)), cases.where("p = 'a'"))
    assert {r.p: r.v for r in boosted.collect()} == {"a": 2.0, "b": 1.0, "c": 1.0}


def test_tie_break_and_overlap(spark):
    s = spark.createDataFrame([("k", "d1", 1.0), ("k", "d2", 1.0), ("k", "d3", 0.5)], "case string, d string, score double")
    features = spark.createDataFrame([("d1", "fever"), ("d1", "rash"), ("d2", "cough")], "d string, name string")
    texts = spark.createDataFrame([("k", "fever and rash")], "case string, text string")
    assert {r.d: r.overlap for r in ranking.overlap_tie_break(s, features, texts).collect()} == {"d1": 2, "d2": 0}


def test_oracle_lookahead_prefers_the_telling_question(spark):
    e = spark.createDataFrame(EDGES, "d string, p string, w double")
    state = spark.createDataFrame([("k", "b", True)], "case string, p string, yes boolean")
    truth = spark.createDataFrame([("k", "b"), ("k", "a")], "case string, p string")
    first = spark.createDataFrame([("k", "a"), ("k", "c")], "case string, p string")
    for rollouts in (0, 4):
        got = {r.q: r.value for r in channels.oracle_lookahead(state, first, truth, e, rollouts, 1).collect()}
        assert set(got) == {"a", "c"} and all(0 <= v <= 1 for v in got.values())
    assert got["a"] >= got["c"]
    gains = dialogue.expected_gain(state, dialogue.candidates(state, e), e)
    assert all(r.ig_expected <= r.h0 + 1e-9 for r in gains.collect())
    assert dialogue.select_question(gains, "minimax_score").count() == 1


def test_logistic_classifier_learns(spark):
    cases = spark.createDataFrame([(f"{d}{i}", p) for d, p in (("x", "a"), ("y", "b")) for i in range(10)], "case string, p string")
    truth = spark.createDataFrame([(f"{d}{i}", d) for d in "xy" for i in range(10)], "case string, d string")
    model, rows = channels.logistic_classifier(cases, truth, 64)
    assert model.transform(rows).where("prediction = label").count() == 20


def test_similar_pairs(spark):
    rows = [(1, [1.0, 0.0, 0.1, 0.3]), (2, [1.0, 0.0, 0.1, 0.31]), (3, [0.0, 1.0, 0.0, 0.0]), (4, [0.0, 0.0, 0.0, 0.0]), (5, None)]
    got = channels.similar_pairs(spark.createDataFrame(rows, "id long, vec array<double>")).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)] and got[0].cosine > 0.99


def test_similar_pairs_and_canonical_ids_are_exact(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(250, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    angle = np.arccos(rng.uniform(0.8, 0.83, 250))[:, None]
    x = np.concatenate([base, (base * np.cos(angle) + side * np.sin(angle)) * 3])  # each with one right above the threshold
    cos = x @ x.T / np.outer(*[np.linalg.norm(x, axis=1)] * 2)
    ids = [f"n{i:03}" for i in rng.permutation(len(x))]
    want = {tuple(sorted((ids[i], ids[j]))): cos[i, j] for i, j in zip(*np.nonzero(np.triu(cos >= 0.8, 1)))}
    df = spark.createDataFrame([*zip(ids, x.tolist()), ("short", [1.0]), ("none", None), ("zero", [0.0] * 16), (None, [1.0] * 16)], "id string, vec array<double>")
    got = channels.similar_pairs(df, 0.8).collect()
    assert len(got) == len(want) > 250 and all(abs(r.cosine - want[r.a, r.b]) < 1e-9 for r in got)
    assert sorted(map(tuple, channels.similar_pairs(df, 0.8, block=64).select("a", "b").collect())) == sorted(want)
    root = {i: i for i in [*ids, "short", "none", "zero"]}
    for _ in root:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.id: r.canonical for r in channels.canonical_ids(df, 0.8).collect()} == root
    assert channels.canonical_ids(df.limit(0)).count() == 0
    assert {r.id: r.canonical for r in channels.canonical_ids(df, 0.8, block=50).collect()} == root


def test_canonical_ids_of_copies_and_of_an_id_with_several_vectors(spark):
    rng = np.random.default_rng(6)
    a, b, c = np.eye(3)
    rows = [(i, v.tolist()) for i, v in zip(range(400), [a * (1 + i % 4) for i in range(150)] + [a + rng.normal(size=3) * 1e-3 for _ in range(150)] + [b] * 100)]
    rows += [(900, c.tolist()), (901, c.tolist()), (901, b.tolist()), (902, [0.0] * 3), (902, c.tolist()), (903, [float("nan")] * 3)]
    got = {r.id: r.canonical for r in channels.canonical_ids(spark.createDataFrame(rows, "id long, vec array<double>"), 0.95, block=64).collect()}
    want = {i: 0 if i < 300 else 300 for i in range(400)} | {900: 300, 901: 300, 902: 300, 903: 903}
    assert got == want


def test_spanning_forest_connects_what_all_links_connect():
    rng = np.random.default_rng(1)
    for density in (0.0, 0.01, 0.05, 0.5, 1.0):
        near = rng.random((40, 30)) < density
        rows, cols = channels._spanning(near)
        assert near[rows, cols].all()

        def parts(pairs):
            root = list(range(70))
            for i, j in list(pairs) * 70:
                root[i] = root[30 + 10 + j] = min(root[i], root[30 + 10 + j])
            return root

        full, some = parts(zip(*np.nonzero(near))), parts(zip(rows, cols))
        assert full == some and len(rows) == 70 - len(set(full))


def test_model_boundary(spark):
    rows = spark.createDataFrame([("k", "fever"), ("m", "x{text}")], "case string, text string")
    asked = linking.build_prompts(rows, "list")
    out = linking.call_model(asked, "prompt", lambda texts: [f'["{t.splitlines()[-1]}"]' for t in texts])
    assert [r[0] for r in out.select(X.salvage_json(F.col("answer"))).collect()] == [["fever"], ["x{text}"]]
    wins = linking.tournament(spark.createDataFrame([("k", "a", "b", "a"), ("k", "a", "c", "a")], "case string, a string, b string, winner string"))
    assert {r.x: r.wins for r in wins.collect()} == {"a": 2, "b": 0, "c": 0}
    assert one(spark, linking.yes_probability(F.lit(0.0), F.lit(0.0))) == 0.5
    rank = spark.createDataFrame([("k", "d", 1, 0.5)], "case string, d string, rank int, score double")
    record = linking.audit_record(rank, spark.createDataFrame([("k", "d", "p", "s")], "case string, d string, p string, source string")).first().record
    assert '"diagnoses":[{"rank":1,"d":"d"' in record


def test_attributes(spark):
    rows = spark.createDataFrame([("k", 2, "p", "leg", "mild"), ("k", 1, "p", "arm", None), ("k", 3, "p", "leg", "severe")], "case string, ord int, p string, place string, severity string")
    r = attributes.case_records(rows).first()
    assert r.places == ["arm", "leg"] and r.severity == "mild"
    assert one(spark, attributes.alignment(F.array(F.lit("a")), F.lit(None).cast("map<string,double>"))) == 0.5
    with_dist = F.create_map(F.lit("a"), F.lit(0.25))
    assert one(spark, attributes.alignment(F.array(F.lit("a"), F.lit("b")), with_dist)) == 0.125


def test_evaluation_excludes_cases_without_scores(spark):
    s = spark.createDataFrame([("k", "d1", 1.0), ("k", "d2", 2.0), ("m", "d1", 1.0)], "case string, d string, score double")
    t = spark.createDataFrame([("k", "d1"), ("m", "d9"), ("z", "d1")], "case string, d string")
    r = ranking.evaluate(s, t).first()
    assert (r.n, r.at_1, r.at_3) == (2, 0.0, 0.5) and r.mrr == pytest.approx((0.5 + 1 / 50) / 2)


def test_reports(spark, tmp_path):
    import numpy as np

    from lattiq.operators import reports

    items = spark.createDataFrame([("fever", "severe", "odd", "bad fever", "a bad fever came"), ("rash", "mild", "sudden", "not there", "text"), (" ", "mild", None, "x", "x")], "name string, severity string, onset string, span string, text string")
    assert [(r.name, r.severity, r.onset) for r in reports.valid_grounded(items).collect()] == [("fever", "severe", None), ("rash", None, None)]
    assert one(spark, reports.validated(F.col("x"), F.col("y"), ("acute",)), x="acute", y="Acute onset") == "acute" and one(spark, reports.validated(F.col("x"), F.col("y"), ("acute",)), x="acute", y="slow") is None
    tokens = spark.createDataFrame([("k", 2, "OTHER", "cough"), ("k", 1, "OTHER", "fever"), ("k", 3, "PAIN", "knee"), ("k", 4, "HISTORY", "smoker")], "case string, ord int, role string, phrase string")
    assert reports.case_text(tokens).first().text == "PAIN: knee\nOTHER: fever; cough\nHISTORY: smoker"
    up = graph.closure(spark.createDataFrame([("a1", "a"), ("b1", "b")], "x string, parent string"))
    got = reports.pair_evaluation(spark.createDataFrame([("a", "b"), ("a", "z")], "a string, b string"), spark.createDataFrame([("b1", "a1"), ("a1", "a1")], "a string, b string"), up).first()
    assert (got.precision, got.recall) == (1.0, 0.5)
    assert [r.supported for r in reports.faithfulness(spark.createDataFrame([("c", "s", 0.4), ("c", "t", 0.6)], "claim string, sentence string, score double")).collect()] == [True]
    np.save(tmp_path / "m.npy", np.array([[1.0, 2.0], [3.0, 4.0]]))
    m = reports.read_score_matrix(spark, spark.read.format("binaryFile").load(str(tmp_path / "m.npy")), ["x", "y"])
    assert [(r.case, r.d, r.score) for r in m.orderBy("case", "d").collect()] == [(0, "x", 1.0), (0, "y", 2.0), (1, "x", 3.0), (1, "y", 4.0)]


def test_the_name_cascade_against_brute_force(spark):
    import random

    rng = random.Random(4)
    make = lambda a, b: "".join(rng.choice("ab ") for _ in range(rng.randrange(a, b))).strip() or "a"
    keys = [(make(1, 40), rng.randrange(9)) for _ in range(150)]
    names = sorted({make(1, 40) for _ in range(60)} | {k[:-1] + "b" for k, _ in keys[:20]} | {k[0] + "x" for k in keys[20:30]} | {f"b{k[0]}" for k in keys[30:40]})
    table = {}
    for k, c in keys:
        table[k] = min(c, table.get(k, 99))
    want = {}
    for n in names:
        norm = n.replace("x", "")
        if n in table or norm in table:
            want[n] = (table[n], "exact") if n in table else (table[norm], "normal")
            continue
        near = [(-min(len(n), len(k)) / max(len(n), len(k)), k) for k in table if len(n) >= 9 and len(k) >= 5 and (k in n or n in k) and 2 * min(len(n), len(k)) > max(len(n), len(k))]
        want[n] = (table[min(near)[1]], "partial") if near else (None, None)
    left = spark.createDataFrame([(n,) for n in names] + [(None,), (names[0],)], "name string")
    got = evidence.cascade_join(left, spark.createDataFrame(keys + [(None, 1)], "key string, code int"), F.regexp_replace("name", "x", "")).collect()
    assert len(got) == len(names) + 2 and {r.name: (r.code, r.tier) for r in got if r.name} == want
    assert len({t for _, t in want.values()}) == 4


def test_codes_fall_back_to_their_parents(spark):
    left = spark.createDataFrame([(1, " j93.0"), (2, "SLE"), (3, "Z9"), (4, None), (5, "J93.1")], "x int, icd string")
    right = spark.createDataFrame([("J93", "C1", 2), ("j93 ", "C0", 1), ("M32", "C2", 3), ("J93.1", "C3", 4)], "icd string, code string, ord int")
    got = {r.x: (r.code, r.tier) for r in evidence.icd_join(left, right, {"SLE": "M32"}).collect()}
    assert got == {1: ("C0", "parent"), 2: ("C2", "exact"), 3: (None, None), 4: (None, None), 5: ("C3", "exact")}


def test_cases_expand_by_parents_synonyms_and_children(spark):
    pairs = lambda *p: spark.createDataFrame(list(p), "x string, y string")
    cases = spark.createDataFrame([("k", "a")], "case string, p string")
    up, syn, down = pairs(("a", "b"), ("b", "c"), ("c", "d")), pairs(("a", "a2"), ("c", "c2"), ("c2", "no")), pairs(("a", "a0"), ("c", "c0"))
    found = lambda *x, **kw: {r.p for r in evidence.expand_cases(cases, up, *x, **kw).collect()}
    assert found() == {"a", "b", "c"} and found(depth=1) == {"a", "b"}
    assert found(syn) == {"a", "b", "c", "a2", "c2"} and found(syn, down) == {"a", "b", "c", "a2", "c2", "a0"}


def test_lookahead_against_brute_force(spark):
    import random

    rng = random.Random(6)
    edges = {(f"d{i}", p) for i in range(6) for p in "abcdefgh" if rng.random() < 0.5}
    state, true, first = {"a": True, "b": False}, set("acg"), ["c", "d", "e"]
    by_d = {}
    for d, p in edges:
        by_d.setdefault(d, set()).add(p)
    want = {}
    for q in first:
        pool = {p for f in by_d.values() if "a" in f for p in f} - set(state) - {q}
        asked = {q, *sorted(pool, key=lambda p: (-sum(p in f for f in by_d.values()), p))[:2]}
        yes, no = {"a"} | (asked & true), {"b"} | (asked - true)
        raw = [len(f & yes) ** 2 / (len(f & yes) + len(f & no) + 1) for f in by_d.values() if f & yes]
        want[q] = max(raw) / sum(raw)
    rows = lambda xs, shape: spark.createDataFrame(xs, shape)
    got = channels.oracle_lookahead(rows([("k", p, y) for p, y in state.items()], "case string, p string, yes boolean"), rows([("k", q) for q in first], "case string, p string"), rows([("k", p) for p in sorted(true)], "case string, p string"), rows(sorted(edges), "d string, p string"), depth=2).collect()
    assert {r.q: round(r.value, 9) for r in got} == {q: round(v, 9) for q, v in want.items()}


def test_binomial_p_values():
    from lattiq.functions import stats

    assert abs(stats._two_sided(8, 10, 0.5) - 0.109375) < 1e-12 and abs(stats._two_sided(0, 5, 0.2) - 0.59) < 0.01 and stats._two_sided(5, 10, 0.5) == pytest.approx(1)
    assert stats._two_sided(0, 0, 0.3) == 1.0 and stats._two_sided(3, 3, 1.0) == 1.0 and stats._two_sided(1, 3, 0.0) == 0.0


def test_the_entry_imports_without_the_corpus_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'edge_weights' in q and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120).returncode == 0


def test_sessions_against_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    edges = sorted({(f"d{i}", f"p{j}") for i in range(8) for j in range(12) if rng.random() < 0.45})
    facts = {c: {f"p{j}" for j in range(12) if rng.random() < 0.4} | {f"p{c % 12}"} for c in range(40)} | {99: {"unknown"}}
    chief = {c: min(ps) for c, ps in facts.items()}
    of = {d: {p for e, p in edges if e == d} for d, _ in edges}
    want = {}
    for case, true in facts.items():
        yes, no, asked = {chief[case]}, set(), 0
        while True:
            score = {d: round(len(ps & yes) ** 2 / (len(ps & yes) + len(ps & no) + 1), 9) for d, ps in of.items() if ps & yes}
            share = [*sorted((v / sum(score.values()) for v in score.values()), reverse=True), 0.0, 0.0]
            counts = {}
            for d in score:
                for p in of[d] - yes - no:
                    counts[p] = counts.get(p, 0) + 1
            reason = "confident" if score and round(share[0] - share[1], 9) >= 0.15 else "exhausted" if not counts else "limit" if asked == 4 else None
            if reason:
                want[case] = (min(score, key=lambda d: (-score[d], d)) if score else None, asked, reason)
                break
            p = min(counts, key=lambda q: (-counts[q], q))
            (yes if p in true else no).add(p)
            asked += 1
    frame = lambda rows, shape: spark.createDataFrame(rows, shape)
    truth = frame([(c, p) for c, ps in facts.items() for p in ps], "case long, p string")
    e, first = frame(edges, "d string, p string"), frame(list(chief.items()), "case long, p string")
    got = {r.case: (r.d, r.asked, r.reason) for r in dialogue.run_sessions(truth, first, e, 4, 0.15).collect()}
    assert got == want and {r[2] for r in want.values()} == {"confident", "exhausted", "limit"}
    named = dialogue.run_sessions(truth, first, e, 0, 2.0, diagnose=lambda state, scores: state.select("case", F.lit("model").alias("d")).distinct())
    assert {(r.d, r.asked) for r in named.collect()} == {("model", 0)}


def test_tails_of_chi_squared_and_f():
    from lattiq.functions import stats

    for df, x in ((1, 0.3), (1, 40.0), (3, 2.5), (7, 7.0), (50, 80.0)):
        at = np.linspace(0, x, 400_001)[1:] if df > 1 else np.linspace(0, np.sqrt(x), 400_001)[1:]
        if df == 1:  # a square of a normal
            below = 2 * np.trapezoid(np.exp(-(at**2) / 2) / np.sqrt(2 * np.pi), at) + 2 * at[0] / np.sqrt(2 * np.pi)
        else:
            below = np.trapezoid(np.exp((df / 2 - 1) * np.log(at) - at / 2 - math.lgamma(df / 2) - df / 2 * math.log(2)), at)
        assert abs(stats._gamma_tail(df / 2, x / 2) - (1 - below)) < 1e-6
    for a, b, x in ((2, 2.5, 0.4), (30, 4.5, 0.8), (5, 60, 0.05), (400, 2, 0.999)):
        at = np.linspace(0, x, 400_001)[1:]
        below = np.trapezoid(np.exp((a - 1) * np.log(at) + (b - 1) * np.log1p(-at) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)), at)
        assert abs(stats._beta_share(x, a, b) - below) < 1e-6


def test_expansion_without_edges_and_ties_of_the_beam(spark):
    e = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "x"), ("b", "y"), ("x", "z")], "x string, y string")
    seeds = spark.createDataFrame([("r",), ("alone",), ("r",)], "root string")
    found, ends = graph.expand_until_saturated(e, seeds, 5, beam=1, since=9)
    assert {(r.x, r.depth) for r in found.collect()} == {("a", 1), ("b", 1), ("x", 2), ("z", 3)}  # b is found, not expanded
    assert {tuple(r) for r in ends.collect()} == {("r", 3, 4, "nothing new"), ("alone", 0, 0, "nothing new")}
    assert {tuple(r) for r in graph.expand_until_saturated(e, seeds, 5, beam=1, since=2, few=1)[1].collect()} == {("r", 1, 2, "saturated"), ("alone", 0, 0, "nothing new")}

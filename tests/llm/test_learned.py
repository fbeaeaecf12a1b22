"""Toxicity, quality and the pipeline: held-out accuracy, monotone pieces, edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lattiq.llm import queries, quality, toxicity

SF = "/root/testdata/sf0.01"


def test_ordinal_regression_recovers_an_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    s = x @ np.array([2.0, -1.0, 0.0])
    y = ((s[:, None] + rng.logistic(size=(3000, 1))) > np.array([-1.0, 0.5, 2.0])).sum(axis=1)
    w, t = toxicity.fit_ordinal(x, y, toxicity.ToxicityParams())
    assert np.allclose(w, [2, -1, 0], atol=0.25) and np.allclose(t, [-1, 0.5, 2], atol=0.25)


def test_toxicity_learns_planted_words_and_takes_edge_cases(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    make = lambda bad: " ".join(rng.choice(words) for _ in range(40)) + " vile foul" * bad
    docs = [(i, make(i % 5 == 0), i) for i in range(400)]
    extra = [(1000, None, 0), (1001, "", 0), (None, "vile foul", 0), (5, "vile foul words", 0), (5, "vile foul words", 0)]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, TOXIC int")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 400, 2)] + [(None, 0, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert len(got) == 405
    assert all(r.toxic == ("vile" in (r.text or "")) for r in got)
    assert all(0 <= r.severity <= 3 and (r.severity > 0.5) == r.toxic for r in got)
    none = toxicity.score(df, toxicity.fit(df, labels.limit(0)))
    assert none.where("toxic").count() in (0, 405) and toxicity.score(df.limit(0), toxicity.fit(df.limit(0), labels)).count() == 0


def test_a_labelled_id_of_many_texts_is_fitted_by_one(spark):
    docs = [(i, "vile foul " * (i % 4 == 0) + f"good plain words {i}") for i in range(80)] + [(0, f"vile foul again {i}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    got = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert len(got) == 380 and all(r.toxic == ("vile" in r.text) for r in got)
    stats = quality.with_statistics(df)
    assert quality.fit(stats, labels).weights.tolist() == quality.fit(stats.distinct().repartition(7), labels).weights.tolist()


def test_isotonic_is_the_best_monotone_fit():
    x, y = np.array([1.0, 1, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 0, 1])
    at, level = quality.isotonic(x, y)
    assert (np.diff(level) >= 0).all() and (np.diff(at) > 0).all()
    assert np.allclose(np.interp(x, at, level)[-1], 1) and abs(level[0] - 1 / 3) < 1e-12


def test_random_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(3)
    n, scale = quality.N_STATS, 4.0
    m = quality.QualityModel(np.zeros(n), np.ones(n), rng.normal(size=(n, 20_000)) / scale, rng.uniform(0, 2 * np.pi, 20_000), np.zeros(1), (np.zeros(1), np.zeros(1)))
    x = rng.normal(size=(2, n))
    z = m.features(x)[:, :-1]
    assert abs(z[0] @ z[1] - np.exp(-((x[0] - x[1]) ** 2).sum() / (2 * scale**2))) < 0.03


def test_quality_of_held_out_rows(spark):
    got = queries.op5_quality(spark, SF)
    labels = queries.table(spark, SF, "labels")
    r = got.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert r.n > 50 and r.right > 0.95
    assert got.count() == queries.table(spark, SF, "documents").count() and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_quality_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "one two", None), (2, "\x00 \n\n", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Score string")
    stats = quality.with_statistics(df)
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1), (7, 1)], "doc_id long, quality int")
    for y in (labels, labels.limit(0)):
        got = quality.score(stats, quality.fit(stats, y), column="stats")
        assert got.count() == 4 and got.where("score IS NULL").count() == 0 and "Score" not in got.columns
    assert quality.score(df.limit(0), quality.fit(stats.limit(0), labels)).count() == 0


def test_pipeline_stage_by_stage(spark):
    docs = queries.table(spark, SF, "documents").withColumn("extra", F.lit(1))
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns and 0 < docs.count() < before, name
        before = docs.count()
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mixed.count() == before
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in docs.collect())


def test_the_pipeline_gives_the_texts_of_the_mix(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert all(sum(len(m.text.split()) for m in r.mixture) == r.taken for r in got)
    assert any(r.taken == 0 and not r.mixture for r in got) and any(len(r.mixture) == 2 for r in got)


def test_degenerate_labels_reject_nothing(spark):
    docs = spark.createDataFrame([(i, f"some plain words {i} of clean text") for i in range(40)], "doc_id long, text string")
    shape, stats = "doc_id long, quality int, toxic int", quality.with_statistics(docs)
    for rows in ([], [(i, 0, 1) for i in range(20)], [(i, 1, 0) for i in range(20)], [(i, 1, i % 2) for i in range(20)], [(99, 0, 1)]):
        labels = spark.createDataFrame(rows, shape)
        assert toxicity.score(docs, toxicity.fit(docs, labels)).where("NOT toxic").count() == 40
        assert quality.score(docs, quality.fit(stats, labels)).where("predicted = 1").count() == 40
    assert quality.fit(stats, spark.createDataFrame([(i, i % 2, 0) for i in range(20)], shape)).fitted


def test_pipeline_on_empty_documents(spark):
    docs = queries.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_scores_are_those_of_a_plain_reading_of_the_models(spark):
    """A frozen model of each kind, applied in plain Python to every text."""
    import math
    import re

    docs, labels = queries.table(spark, SF, "documents").select("doc_id", "text"), queries.table(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        words = re.findall(b"[a-z0-9\x80-\xff]+", (r.text or "").translate({c: c + 32 for c in range(65, 91)}).encode())
        s = 0.0
        for i, name in enumerate(model.words):
            n = sum(w.startswith(name[1:]) if name[:1] == b" " else w == name for w in words)
            s += sum(model.weights[3 * i + k] * x for k, x in enumerate((1.0, float(n > 1), math.log1p(100 * n / len(words)))) if n)
        above = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
        assert abs(got[r.doc_id].severity - sum(above)) < 1e-9 and got[r.doc_id].toxic == (above[0] >= 0.5)
    stats = quality.with_statistics(docs)
    m = quality.fit(stats, labels)
    scored = {r.doc_id: r.score for r in quality.score(stats, m, column="stats").collect()}
    for r in stats.collect():
        z = [min(6, max(-6, (x - a) / b)) for x, a, b in zip(r.stats, m.mean, m.sd)]
        raw = m.weights[-1] + sum(w * math.sqrt(2 / len(m.phase)) * math.cos(sum(a * b for a, b in zip(z, m.freq[:, k])) + m.phase[k]) for k, w in enumerate(m.weights[:-1]))
        x, y = m.knots
        k = int(np.searchsorted(x, raw))
        want = y[0] if k == 0 else y[-1] if k == len(x) else y[k - 1] + (y[k] - y[k - 1]) * (raw - x[k - 1]) / (x[k] - x[k - 1])
        assert abs(scored[r.doc_id] - min(1, max(0, want))) < 1e-6


def test_pipeline_stages_return_columns_of_any_name(spark):
    shape = "doc_id long, text string, toxic string, score string, severity int, predicted int, n_words int, items int, component_id string, stats int, source string, m map<string,int>"
    plain = [r.text for r in queries.table(spark, SF, "documents").where("lang = 'en'").orderBy("doc_id").limit(60).collect()]
    rows = [(i if i % 9 else None, t, "no", "high", 1, 2, 3, 4, "c", 5, "s", {"a": i}) for i, t in enumerate([*plain, None, "", plain[0], plain[0], "word " * 200_000])]
    docs = spark.createDataFrame(rows + [rows[1]], shape)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.schema.simpleString() == docs.schema.simpleString(), name
        kept = got.collect()
        assert {(r.toxic, r.score, r.severity, r.predicted, r.n_words, r["items"], r.component_id, r.stats) for r in kept} <= {("no", "high", 1, 2, 3, 4, "c", 5)}
        assert {str(r) for r in kept} <= {str(r) for r in docs.collect()} and kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows) + 1


def plain_pipeline(docs, labels, bench, spark):
    """The stages in plain Python, but for the two models, which are fitted on each stage's input: ids kept, and words taken."""
    from test_dedup import classes_of, plain_fingerprint
    from test_text_operators import plain_judge

    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string")
    bad = {r.doc_id for r in toxicity.score(frame(docs), toxicity.fit(frame(docs), labels)).where("toxic").collect()}
    docs = [d for d in docs if d[0] not in bad]
    model = quality.fit(quality.with_statistics(frame(docs)), labels)
    good = {r.doc_id for r in quality.score(frame(docs), model).where("score >= 0.7").collect()}
    docs = sorted(d for d in docs if d[0] in good)
    fps = [plain_fingerprint(d[1]) for d in docs]
    roots = classes_of(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    docs = [d for i, d in enumerate(docs) if roots[i] == i]
    out = []
    for d in docs:
        n, hit, _, _ = plain_judge(d[1], bench)
        if not (hit and 20 * hit >= n):
            out.append(d)
    return out


def test_pipeline_against_brute_force(spark):
    rows = [(r.doc_id, r.text, r.source) for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()]
    bench = [(str(r.item_id), r.text) for r in queries.table(spark, "/root/testdata/sf0.001", "benchmark").collect()]
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    want = plain_pipeline(rows, queries.table(spark, "/root/testdata/sf0.001", "labels"), bench, spark)
    assert sorted(r.doc_id for r in got) == [d[0] for d in want]
    from lattiq.llm import mixing

    sizes = {}
    for i, text, source in want:
        sizes.setdefault(source, []).append(len([w for w in text.translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w]))
    names = sorted(sizes)
    for name, goal in zip(names, mixing.targets([sum(sizes[n]) for n in names])):
        assert sum(r.taken for r in got if r.source == name) == int(goal)

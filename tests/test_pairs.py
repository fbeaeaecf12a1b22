"""Sums over the pairs of a case and a disease: no pair is shuffled, blocks and tasks do not change a result."""

import re

import pytest
from test_queries import SF, same

from lattiq.operators import ranking
from lattiq.plans.queries import QUERIES


def above(df):
    """The plan's lines above the place where pairs arise."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return lines[: next(i for i, x in enumerate(lines) if re.search(r"Generate explode\(_to", x))]


def rows_of(df):
    return sorted(map(repr, (tuple(same(x) for x in r) for r in df.collect())))


NAMES = [
    "finding_counts", "attribute_aware_scores", "clamped_score_family", "corrected_score_family", "count_score_family", "min_match_filter", "normalised_scores", "score_cutoffs",
    "tied_diagnoses", "top_k_diagnoses", "weighted_edge_scores", "bound_attributes", "reference_baselines", "differential_macro", "extrinsic_evaluation",
]


@pytest.mark.parametrize("name", NAMES)
def test_pairs_stay_in_the_task_where_they_arise(spark, name):
    lines = above(QUERIES[name](spark, SF))
    if name == "differential_macro":  # its metrics, above the ranks, are sums of few rows
        lines = lines[max(i for i, x in enumerate(lines) if "Window [row_number" in x) :]
    if name == "extrinsic_evaluation":  # a union, and one number a case is summed up
        lines = lines[next(i for i, x in enumerate(lines) if "collect_list" in x) :]
    assert not [x for x in lines if "Exchange hashpartitioning" in x or "Exchange rangepartitioning" in x]


FACTS = [(1, "a", True), (1, "a", True), (1, "b", False), (1, "z", True), (1, "y", True), (1, None, True), (2, "b", True), (2, "b", False), (2, "c", True), (3, "a", False), (4, "z", True)]
LINKS = [("d1", "a"), ("d1", "b"), ("d1", "b"), ("d2", "b"), ("d2", "c"), ("d3", "c"), ("d3", "q"), ("d4", None), (None, "a")]


def counted(facts, links):
    e = {(d, p) for d, p in links if d and p}
    out = []
    for case in {f[0] for f in facts}:
        mine = {(p, y) for k, p, y in facts if k == case and p}
        total = sum(y for _, y in mine)
        for d in {d for d, _ in e}:
            c, x = (sum((d, p) in e and y == want for p, y in mine) for want in (True, False))
            if c:
                out.append((case, d, c, x, sum(a == d for a, _ in e), total))
    return out


@pytest.mark.parametrize("limit", [1, 3, 1 << 19])
@pytest.mark.parametrize("mentions", [False, True])
def test_counts_by_blocks(spark, monkeypatch, limit, mentions):
    monkeypatch.setattr(ranking, "EDGES", limit)
    monkeypatch.setattr(ranking, "PAIRS", limit)
    facts = FACTS
    if mentions:
        facts = [(k, p, max(y for a, b, y in FACTS if (a, b) == (k, p))) for k, p, _ in FACTS]
    df = ranking.finding_counts(spark.createDataFrame(FACTS, "case long, p string, yes boolean"), spark.createDataFrame(LINKS, "d string, p string"), mentions=mentions)
    assert rows_of(df) == sorted(map(repr, counted(facts, LINKS)))


def test_no_edges_and_no_rows(spark):
    none = spark.createDataFrame([], "d string, p string")
    facts = spark.createDataFrame(FACTS, "case long, p string, yes boolean")
    assert ranking.finding_counts(facts, none).count() == 0
    assert ranking.finding_counts(facts.where("false"), spark.createDataFrame(LINKS, "d string, p string")).count() == 0


def test_weights_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "EDGES", 2)
    edges = spark.createDataFrame([("d1", "a", 0.5), ("d1", "b", 2.0), ("d2", "b", 4.0), ("d2", "b", 4.0), ("d3", "q", 1.0), (None, "a", 8.0)], "d string, p string, w double")
    got = ranking.weighted_sum(spark.createDataFrame(FACTS, "case long, p string, yes boolean"), edges)
    assert rows_of(got) == sorted(map(repr, [(1, "d1", 2.5), (1, "d2", 8.0), (1, None, 8.0), (2, "d1", 2.0), (2, "d2", 8.0), (3, "d1", 0.5), (3, None, 8.0)]))


def test_candidates_of_equal_states_are_looked_for_once(spark):
    from lattiq.operators import dialogue

    links = [("d1", "a"), ("d1", "b"), ("d1", "c"), ("d2", "b"), ("d2", "c"), ("d2", "e"), ("d3", "a"), ("d3", "e"), ("d4", "f")]
    states = {1: {"a": True}, 2: {"a": True}, 3: {"a": True, "b": False}, 4: {"b": True, "a": True}, 5: {"f": True}, 6: {"a": False}}
    state = spark.createDataFrame([(k, p, y) for k, x in states.items() for p, y in x.items()] + [(1, "a", True)], "case long, p string, yes boolean")
    args = state, spark.createDataFrame(links, "d string, p string"), spark.createDataFrame([("b",)], "p string"), 10, 1
    for name, (together, drop, last) in dialogue.VARIANTS.items():
        want = []
        for case, x in states.items():
            hits = {(d, p) for d, p in links if x.get(p)}
            if drop:
                hits = {(d, p) for d, p in hits if not any((d, q) in links and not y for q, y in x.items())}
            rows = []
            for q in "abcef":
                ds = {d for d, _ in hits if (d, q) in links}
                cs = {p for d, p in hits if d in ds}
                if ds and q not in x:
                    rows.append((last and q == "b", -len(ds) * (len(cs) if together else 1), q, len(ds), len(cs)))
            want += [(case, q, n, m, i) for i, (_, _, q, n, m) in enumerate(sorted(rows), 1)]
        got = dialogue.candidates_by(name, *args)
        assert rows_of(got) == sorted(map(repr, want))
        assert any("/states-" in f for f in got.inputFiles())


@pytest.mark.parametrize("cells", [0, 1, 9, 1 << 20])
@pytest.mark.parametrize("mentions", [False, True])
def test_cutoffs_in_matrices_and_rows(spark, monkeypatch, cells, mentions):
    facts = spark.createDataFrame(FACTS + [(6, "a", None), (None, "b", True), (None, "a", True)], "case long, p string, yes boolean")
    to = ranking.reach(spark.createDataFrame(LINKS, "d string, p string").distinct())
    score = lambda c, x: c * c / (c + x + 1.0)
    with monkeypatch.context() as m:
        m.setattr(ranking, "DENSE", 0)
        want = rows_of(ranking.count_cutoffs(facts, to, score, 0.5, mentions))
    monkeypatch.setattr(ranking, "CELLS", cells)
    assert want and rows_of(ranking.count_cutoffs(facts, to, score, 0.5, mentions)) == want


def test_cutoffs_make_no_row_before_a_pair_is_kept(spark):
    plan = QUERIES["score_cutoffs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not re.search(r"Window|functions=\[count_if", plan)


def test_rounded_array(spark):
    from lattiq.functions import formulas

    x = [0.0, 1.0, 0.8, 2.5e-9, 0.1234567885, 0.1234567895, 1e-10, 5e-10, 0.49999999949, *[(k * 2 + 1) / 2e9 for k in range(500)], *[1 / k for k in range(2, 500)]]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").selectExpr("round(x, 9)").collect()]
    assert formulas.rounded_array(__import__("numpy").array(x), 9).tolist() == got


@pytest.mark.parametrize("most", [0, 1 << 10])
@pytest.mark.parametrize("limit", [1, 3, 1 << 19])
def test_most_matches_by_blocks(spark, monkeypatch, limit, most):
    monkeypatch.setattr(ranking, "EDGES", limit)
    monkeypatch.setattr(ranking, "DENSE", most)
    links = {("d9", "a"), ("d9", "b"), ("d10", "a"), ("d10", "b"), ("é", "c"), ("d2", "c"), ("d2", "b"), ("z", "c"), ("d3", "q")}
    cases = [(1, "a"), (1, "b"), (1, "b"), (2, "c"), (3, "b"), (3, "c"), (4, "x"), (5, None), (None, "q")]
    want = []
    for case in {k for k, _ in cases}:
        mine = {p for k, p in cases if k == case and p}
        n = {d: sum((d, p) in links for p in mine) for d, _ in links}
        if max(n.values()):
            want.append((case, min(n, key=lambda d: (-n[d], d.encode()))))
    got = ranking.most_matches(spark.createDataFrame(cases, "case long, p string"), spark.createDataFrame(sorted(links), "d string, p string"))
    assert rows_of(got) == sorted(map(repr, want))


def test_baselines_sort_no_pairs(spark):
    assert not [x for x in above(QUERIES["reference_baselines"](spark, SF)) if re.search(r"SortAggregate|\bSort \[", x)]


def test_cutoffs_deal_no_row_after_the_lists_are_written(spark):
    plan = QUERIES["score_cutoffs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange (hash|range)partitioning", plan)


@pytest.mark.parametrize("cells", [0, 1 << 20])
@pytest.mark.parametrize("most", [0, 1 << 10])
def test_cutoffs_of_lists(spark, monkeypatch, most, cells):
    names = {"a": 3, "b": 4, "c": 7, "q": 9, "y": 12, "z": -5, None: None}
    rows = [*FACTS, (6, "a", None), (None, "b", True), (None, "a", True), (7, None, True)]
    facts = {}
    for case, p, yes in rows:
        said = facts.setdefault(case, {})
        said[names[p]] = yes if said.get(names[p]) is None else yes or said[names[p]]
    lists = spark.createDataFrame([(case, list(x.items())) for case, x in facts.items()], "case long, facts array<struct<p: long, yes: boolean>>")
    links = spark.createDataFrame([(d, names[p]) for d, p in set(LINKS)], "d string, p long")
    score = lambda c, x: c * c / (c + x + 1.0)
    old = ranking.reach(spark.createDataFrame(LINKS, "d string, p string").distinct())
    with monkeypatch.context() as m:
        m.setattr(ranking, "DENSE", 0)
        want = rows_of(ranking.count_cutoffs(spark.createDataFrame(rows, "case long, p string, yes boolean"), old, score, 0.5, True))
    monkeypatch.setattr(ranking, "CELLS", cells)
    monkeypatch.setattr(ranking, "EDGES", 1)
    monkeypatch.setattr(ranking, "DENSE", most)
    to = ranking.reach(links, matrix=True)
    assert ranking.dense(to) == bool(most)  # also of more edges than are broadcast
    assert want and rows_of(ranking.count_cutoffs(lists, to, score, 0.5, True)) == want


def test_cutoffs_put_equal_shares_together(spark):
    facts = spark.createDataFrame([(k, [(1, True), (2, True), (3, k == 1)]) for k in (1, 2)], "case long, facts array<struct<p: long, yes: boolean>>")
    to = ranking.reach(spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 2), ("d", 1), ("d", 3)], "d string, p long"), matrix=True)
    got = ranking.count_cutoffs(facts.coalesce(1), to, lambda c, x: c * c / (c + x + 1.0)).collect()
    assert [(r.case, r.d) for r in got] == [(1, d) for d in "bdac"] + [(2, d) for d in "bacd"]
    assert all(a.case != b.case or a.share >= b.share for a, b in zip(got, got[1:]))


def test_cutoffs_of_odd_tables(spark, tmp_path):
    import duckdb

    from lattiq.plans.queries import ORACLES

    c = duckdb.connect()
    made = {
        "customer": "VALUES (1, 5, 'A'), (2, 5, 'B'), (3, NULL, 'A'), (2, 7, 'B'), (NULL, 1, 'C'), (4, 5, 'A')|c_custkey, c_nationkey, c_mktsegment",
        "orders": "VALUES (10, 1), (11, 2), (12, 3), (10, 4), (13, 9), (NULL, 1), (14, NULL), (10, 2), (15, 4)|o_orderkey, o_custkey",
        "part": "VALUES (1, 'x', 'B1', 'T'), (2, 'x', 'B1', 'T'), (3, 'y', 'B1', 'T'), (-4, 'z', 'B2', 'T'), (NULL, 'z', 'B2', 'T'), (3, 'w', 'B1', 'T')|p_partkey, p_name, p_brand, p_type",
        "lineitem": "VALUES (10, 1, 'R'), (10, 2, 'N'), (10, 3, 'R'), (11, 3, 'A'), (11, -4, NULL), (11, -4, 'R'), (12, 1, 'N'), (13, 1, 'N'), (NULL, 1, 'N'), (10, NULL, 'N'), (15, 2, 'A'), (15, -4, 'A'), (15, 8, 'A')|l_orderkey, l_partkey, l_returnflag",
    }
    for name, x in made.items():
        values, columns = x.split("|")
        c.execute(f"CREATE TABLE {name} AS SELECT * FROM ({values}) v ({columns})")
        for k in [k for k in columns.split(", ") if k.endswith("key") and k != "c_nationkey"]:
            c.execute(f"ALTER TABLE {name} ALTER {k} TYPE BIGINT")
    for k in ("p_size INT", "l_linenumber INT", "l_quantity DOUBLE", "l_suppkey BIGINT", "l_linestatus VARCHAR"):
        c.execute(f"ALTER TABLE {'part' if k[0] == 'p' else 'lineitem'} ADD COLUMN {k}")
    c.execute("UPDATE lineitem SET l_linestatus = 'O'")
    for name in made:
        c.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got = QUERIES["score_cutoffs"](spark, str(tmp_path))
    want = c.execute(ORACLES["score_cutoffs"])
    at = [[x[0] for x in want.description].index(k) for k in got.columns]
    assert rows_of(got) == sorted(map(repr, [tuple(same(r[i]) for i in at) for r in want.fetchall()]))
    assert got.count() > 5

"""SimHash and embedding near-dedup against brute force, and their edge cases."""

import itertools
import random

import numpy as np
import xxhash

from lattiq.llm import common, embeddings, simhash


def classes_of(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split(" ")
    words = [w for x in words for w in x.replace("\t", "\n").split("\n") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_the_plain_one():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 700):
        text = " ".join(rng.choice(["A", "b", "É", "dog", "x\ty"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    long = " ".join(str(rng.random()) for _ in range(40_000))  # more than one chunk
    assert simhash.fingerprint(long.encode()) == plain_fingerprint(long)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    for one_task in (0, 20, common.ONE_TASK_EDGES):
        rows = common.components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long").repartition(3), one_task).collect()
        roots = {r.node: r.root for r in rows}
        assert len(rows) == len(roots) == 401
        assert len({roots[i] for i in range(101)}) == 1 and len({roots[i] for i in range(1000, 1300)}) == 1 and roots[0] != roots[1000]
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_fingerprints_are_those_of_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(150)]
    hot = rng.getrandbits(64)
    fps = base + [x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for x in base[:60]]
    fps += [hot ^ (sum(1 << rng.randrange(64) for _ in range(rng.randrange(4)))) & (1 << 64) - 1 for _ in range(400)]  # a heavy key
    fps = sorted({x & (1 << 64) - 1 for x in fps})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = classes_of(len(fps), [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2])
    for heavy in (4, 64, 10_000):
        edges = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"), simhash.SimHashParams(heavy=heavy))
        at = {x: i for i, x in enumerate(signed)}
        links = [(at[r.a], at[r.b]) for r in edges.collect()]
        assert all((fps[i] ^ fps[j]).bit_count() <= 2 for i, j in links)
        assert classes_of(len(fps), links) == want


def test_thresholds_meet_the_generalised_pigeonhole_principle():
    rng = np.random.default_rng(3)
    for n in (100, 10**6, 10**9):
        sample = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
        for t in (0, 1, 2):
            plan = simhash.allocate(sample, n, t)
            assert sum(x + 1 for _, x in plan) == t + 1
            assert sum(m.bit_count() for m, _ in plan) <= 64


def test_near_duplicates_edge_cases(spark):
    shape = "doc_id long, text string, FP string, source string"
    text = "one two three four five six"
    rows = [(5, text, "x", None), (3, text, "y", "s"), (3, text, "y", "s"), (9, None, None, None), (8, "", "", ""), (None, text, None, None), (4, "quite another text of words", None, None)]
    docs = spark.createDataFrame(rows, shape)
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 3), (3, 3), (3, 3), (4, 4), (5, 3), (8, 8), (9, 8)]
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 8]
    empty = simhash.near_duplicates(spark.createDataFrame([], shape))
    assert empty.count() == 0 and simhash.deduplicate(spark.createDataFrame([], shape)).count() == 0


def test_an_id_of_several_texts_keeps_one_row_a_group(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(40)) for _ in range(30)]
    rows = [(5, t) for t in texts] + [(5, texts[0]), (7, texts[1]), (2, texts[2]), (9, texts[3]), (9, "some other words that stand alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = {}
    for i, t in rows:  # the texts are unlike: groups are those of equal fingerprints within two bits
        fp = plain_fingerprint(t)
        at = next((k for k in parts if (k ^ fp).bit_count() <= 2), fp)
        parts.setdefault(at, []).append((i, t))
    assert len(parts) == 31
    want = sorted(min(rs) for rs in parts.values())
    assert sorted(tuple(r) for r in simhash.deduplicate(docs).collect()) == want


def plain_links(vectors):
    links = []
    for i, j in itertools.combinations(range(len(vectors)), 2):
        a, b = vectors[i], vectors[j]
        if a is None or b is None or len(a) != len(b) or not len(a) or any(v is None or not np.isfinite(v) for v in [*a, *b]):
            continue
        a, b = np.array(a, float), np.array(b, float)
        n = np.sqrt((a @ a) * (b @ b))
        if n > 0 and a @ b / n >= 0.95:
            links.append((i, j))
    return links


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 32))
    rows = [v.tolist() for v in base] + [(v + rng.normal(size=32) * 0.15).tolist() for v in base[:70]] + [base[0].tolist()] * 5
    rows += [(base[1] + rng.normal(size=32) * 0.02).tolist() for _ in range(60)]  # a hot bucket, cut into blocks
    rows += [None, [], [0.0] * 32, [float("nan")] * 32, [float("inf")] * 32, [None] * 32, [1.0, 2.0], [2.0, 4.0], (base[2] * 1e-30).tolist()]
    links = plain_links(rows)
    degree = [sum(i in x for x in links) for i in range(len(rows))]
    want = classes_of(len(rows), links)
    df = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = sorted(embeddings.near_duplicates(df, embeddings.EmbeddingParams(block=16)).collect())
    wide = embeddings.EmbeddingParams(fill=2.0**-22)  # bands of over 24 bits
    assert wide.shape(100)[0] > 24 and sorted(embeddings.near_duplicates(df, wide).collect()) == got
    for tiles in (embeddings.EmbeddingParams(small=4, tile=8, block=20), embeddings.EmbeddingParams(small=1, tile=512)):
        assert sorted(embeddings.near_duplicates(df, tiles).collect()) == got
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got] == [(i, degree[i], want[i], want[i] == i) for i in range(len(rows))]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_recall_right_at_the_threshold():
    p = embeddings.EmbeddingParams()
    for n in (10**4, 10**6, 10**9):
        bits, bands = p.shape(n)
        agree = 1 - np.arccos(p.threshold) / np.pi
        assert (1 - agree**bits) ** bands <= p.miss * 1.01


def test_deduplicate_keeps_columns_of_any_name_and_type(spark):
    shape = "doc_id long, component_id string, __bits int, slot int, fp string, root string, c0 int, m map<string,int>, row int, text string"
    text, other = "one two three four five six seven", "quite some other words that stand here alone"
    rows = [(5, "x", 1, 2, "f", "r", 7, {"a": 1}, 3, text), (3, "y", 1, 2, "f", "r", 8, {"a": 2}, 3, text), (3, "y", 1, 2, "f", "r", 8, {"a": 2}, 3, text), (3, "z", 1, 2, "f", "r", 9, None, 3, other)]
    rows += [(None, "n", 0, 0, "f", "r", 1, {"b": 1}, 3, "no id at all in these words"), (None, "n", 0, 0, "f", "r", 1, {"b": 1}, 3, "no id at all in these words"), (None, "n", 0, 0, "f", "r", 2, {}, 3, text)]
    docs = spark.createDataFrame(rows, shape)
    kept = simhash.deduplicate(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    got = sorted(((r.doc_id, r.component_id, r.c0, r.m) for r in kept.collect()), key=str)
    assert got == sorted([(3, "y", 8, {"a": 2}), (3, "z", 9, None), (None, "n", 1, {"b": 1})], key=str)


def test_measured_recall_of_bands():
    """Pairs right at and above the threshold that share no band, for the shape of a million classes."""
    rng, p = np.random.default_rng(9), embeddings.EmbeddingParams()
    bits, n = p.shape(10**6)
    bands = embeddings.Bands(p, bits, n)
    for cosine, least in ((0.95, 0.99), (0.97, 0.999)):
        a = rng.normal(size=(3000, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.normal(size=a.shape)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        ka, kb = (bands.keys(bands.code(x)[0], 64) for x in (a, b))
        assert (ka == kb).any(axis=1).mean() >= least


def test_estimates_are_unbiased_and_bounded():
    rng, p = np.random.default_rng(10), embeddings.EmbeddingParams()
    bits, n = p.shape(1000)
    bands = embeddings.Bands(p, bits, n)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    sign = np.unpackbits(bands.code(a)[0], axis=1)[:, :64] * 2.0 - 1
    turned = bands.code(a)[1]
    factor = np.abs(turned).sum(axis=1) / 8
    guess = (sign / 8 * bands.code(b)[1]).sum(axis=1) / factor
    slack = p.sigmas * np.sqrt((1 - factor**2) / 63) / factor
    assert abs(guess.mean() - 0.95) < 0.005 and (guess + slack >= 0.95).mean() > 0.9995

"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

Statistics of the whole text (never its id, language or source) are standardised and mapped to
``features`` cosines that approximate a Gaussian kernel; normal equations are summed by partition
and solved once; pool-adjacent-violators turns the ridge scores into probabilities of label 1.

Fitting uses at most ``max_train`` labelled rows, drawn by a hash of their id, in ``parts`` tasks.
Edge cases: null and empty texts have the statistics of a text without words and are scored; very long
texts are measured as a whole; without labelled rows every score is 0.5; if they lack a class, all
texts are predicted good; labels that repeat an id count once, as the smallest; a labelled id of
several texts is fitted by the one of the least statistics; equal ridge scores are calibrated alike;
rows with equal or null ids are scored each for itself; an empty table gives an empty result; an input
column named like a result is replaced (``lattiq.llm.common.apart`` keeps all).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.llm.common import append_columns, texts_of


@dataclass(frozen=True)
class QualityParams:
    max_train: int = 50_000
    parts: int = 16  # tasks that fit, and sums (0.5 MB each at 256 features) that the driver adds
    features: int = 256
    scale: float = 4.0  # kernel width, in standard deviations
    ridge: float = 1e-2
    threshold: float = 0.7
    seed: int = 11


#: Kind of each byte: 0 other control, 1 white space, 2 digit, 3 upper, 4 lower, 5 sentence mark, 6 rare mark, 7 beyond ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 2, 3, 4, 7
_KIND[[c for c in range(33, 127) if _KIND[c] == 0]] = 6
_KIND[[ord(c) for c in ".,;:'?\"-"]] = 5
_END = frozenset(b".,;:'?\"-")
N_STATS = 18


def statistics(text: bytes) -> list[float]:
    n = max(1, len(text))
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=8) / n
    words = text.split()
    m = max(1, len(words))
    counts, lines = Counter(words), [x for x in text.split(b"\n") if x.strip()]
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    rare = sum(n for w, n in counts.items() if w[-1] not in _END and not 48 <= w[-1] <= 57 and w[-1] < 128 and not w[-1:].isalpha())
    alone = sum(n for w, n in counts.items() if not w.isalnum() and len(w) == 1)
    top = counts.most_common(1)[0][1] if counts else 0
    pairs = len(set(zip(words, words[1:])))
    return [
        *kinds.tolist(),
        np.log1p(len(words)),
        np.log1p(len(text) / m),
        repeats / m,
        len(counts) / m**0.75,
        top / m,
        rare / m,
        alone / m,
        pairs / m,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(m / max(1, len(lines))),
    ]


STATS = T.StructField("stats", T.ArrayType(T.DoubleType()))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics of each text."""
    return append_columns(docs, "text", lambda c: [pa.array([statistics(t) for t in texts_of(c)], pa.list_(pa.float64()))], [STATS])


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    sd: np.ndarray
    freq: np.ndarray  # (statistics, features)
    phase: np.ndarray
    weights: np.ndarray  # one more, for the intercept
    knots: tuple[np.ndarray, np.ndarray]  # ridge scores and their calibrated probabilities
    fitted: bool = True  # on labels of both classes

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.sd, -6, 6)
        return np.concatenate([np.cos(z @ self.freq + self.phase) * np.sqrt(2 / self.freq.shape[1]), np.ones((len(z), 1))], axis=1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(stats):
            return np.zeros(0)
        return np.clip(np.interp(self.features(stats) @ self.weights, *self.knots), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; equal x are pooled first. Knots at the means of the blocks."""
    xs, at = np.unique(x, return_inverse=True)
    n, total = np.bincount(at).astype(float), np.bincount(at, weights=y)
    blocks: list[list[float]] = []  # n, sum of y, sum of x
    for i in range(len(xs)):
        blocks.append([n[i], total[i], xs[i] * n[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 2] / b[:, 0], b[:, 1] / b[:, 0]


def draw(labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """(doc_id, y) of the labelled rows that fitting uses: at most ``max_train``, so they may be sent out."""
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).cast("double").alias("y"))
    return rows.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(p.max_train)


def labelled(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """Those rows of ``docs`` that fitting uses."""
    return docs.join(F.broadcast(draw(labels, p).select("doc_id")), "doc_id", "left_semi")


def fit(stats: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> QualityModel:
    """Learn from ``stats(doc_id, stats)`` and ``labels(doc_id, quality)``."""
    rows = stats.select("doc_id", "stats").join(F.broadcast(draw(labels, p)), "doc_id").repartition(p.parts, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("stats", "y")).alias("r")).sortWithinPartitions("doc_id").select("r.*").persist()
    rng = np.random.default_rng(p.seed)
    freq, phase = rng.normal(size=(N_STATS, p.features)) / p.scale, rng.uniform(0, 2 * np.pi, p.features)
    got = rows.agg(F.count("*").alias("n"), F.count_distinct("y").alias("classes"), *[f(F.col("stats")[i]).alias(f"{f.__name__}{i}") for f in (F.avg, F.stddev_pop) for i in range(N_STATS)]).first()
    if not got.n:
        rows.unpersist()
        return QualityModel(np.zeros(N_STATS), np.ones(N_STATS), freq, phase, np.zeros(p.features + 1), (np.zeros(1), np.full(1, 0.5)), False)
    mean, sd = (np.array([got[f"{f}{i}"] for i in range(N_STATS)]) for f in ("avg", "stddev_pop"))
    model = QualityModel(mean, np.maximum(sd, 1e-6), freq, phase, np.zeros(p.features + 1), (np.zeros(1), np.zeros(1)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((p.features + 1, p.features + 1)), np.zeros(p.features + 1)
        for batch in batches:
            z = model.features(np.array(batch.column(0).to_pylist(), float).reshape(-1, N_STATS))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            a, b = a + z.T @ z, b + z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["a", "b"])

    few = rows.coalesce(p.parts)  # however many partitions the shuffle gave, so many sums of fixed size come to the driver at most
    parts = few.mapInArrow(sums, "a binary, b binary").collect()
    a = sum(np.frombuffer(r.a).reshape(p.features + 1, -1) for r in parts)
    b = sum(np.frombuffer(r.b) for r in parts)
    weights = np.linalg.solve(a + p.ridge * np.eye(len(b)), b)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = model.features(np.array(batch.column(0).to_pylist(), float).reshape(-1, N_STATS)) @ weights
            y = batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["raw", "y"])

    pairs = few.mapInArrow(raw, "raw binary, y binary").collect()  # 16 bytes for each of max_train rows at most
    z, y = (np.concatenate([np.frombuffer(r[i]) for r in pairs]) for i in range(2))
    rows.unpersist()
    return QualityModel(model.mean, model.sd, freq, phase, weights, isotonic(z, y), got.classes > 1)


FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def score(docs: DataFrame, model: QualityModel, p: QualityParams = QualityParams(), column: str = "text") -> DataFrame:
    """``docs`` with the probability of good quality and the decision; from ``stats`` or from texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(c: pa.Array) -> list:
        stats = c.to_pylist() if column == "stats" else [statistics(t) for t in texts_of(c)]
        s = held.value.score(np.array(stats, float).reshape(-1, N_STATS))
        return [pa.array(s, pa.float64()), pa.array(((s >= p.threshold) | (not held.value.fitted)).astype(np.int32), pa.int32())]

    return append_columns(docs, column, run, FIELDS)

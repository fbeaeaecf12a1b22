"""Toxicity grades by cumulative-link ordinal regression on sparse words.

P(grade <= k) = sigmoid(t_k - w.x): one weight vector for all ordered thresholds t_1 < t_2 < t_3.
x is sparse: for each selected word or word beginning, whether it occurs, whether it occurs twice,
and the logarithm of its rate, over the whole text. The label table says toxic or not; a toxic
training text gets grade 1, 2 or 3 by the rate of telling words in it (terciles). The result is the
expected grade, and a text is rejected if grade 0 has a probability below one half.

Fitting uses at most ``max_train`` labelled ids, drawn by a hash, with one text each. Their texts are
written to the shared folder once, and all passes of the fit read that table; the driver gets the word
counts that may be selected and each text's few features, packed. Scoring covers all rows.

Edge cases: null and empty texts have no words and get the base rate; very long texts are counted as
a whole; without labels, or with one class only, no word is selected, all texts get the base rate and
none is called toxic; rows with equal or null ids are scored each for itself; labels that repeat an id
count once, as the largest; a labelled id of several texts is fitted by the least of them; of words
that tell alike the longer, then the smaller in bytes, comes first; an empty table gives an empty
result; an input column named like a result is replaced (``lattiq.llm.common.apart`` keeps all).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.llm.common import append_columns, texts_of
from lattiq.shared import materialize

#: Bytes: A-Z to a-z; ASCII other than letters and digits to a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class ToxicityParams:
    max_train: int = 20_000
    vocabulary: int = 200
    least_rows: int = 4  # labelled texts that hold a selected word
    least_g2: float = 12.0  # log-likelihood ratio of its counts
    grades: int = 4
    l2: float = 1e-4
    steps: int = 600
    rate: float = 0.1
    reject: float = 0.5


#: Bytes of the word beginnings that are features beside the words; a beginning is written with a blank.
_BEGINNINGS = (5, 6, 7, 8)


def tally(text: bytes) -> Counter:
    return Counter(text.translate(_WORDS).split())


def items(counts: Counter) -> set[bytes]:
    return {*counts, *(b" " + w[:n] for w in counts for n in _BEGINNINGS if len(w) >= n)}


class Vocabulary:
    def __init__(self, words: tuple[bytes, ...]) -> None:
        self.words = {w: i for i, w in enumerate(words) if w[:1] != b" "}
        self.starts = [(n, {w[1:]: i for i, w in enumerate(words) if w[:1] == b" " and len(w) == n + 1}) for n in _BEGINNINGS]
        self.starts = [x for x in self.starts if x[1]]
        least = min(_BEGINNINGS)
        self.least, self.gate = least, frozenset(w.lstrip(b" ")[:least] for w in words)  # how a word with features begins

    def items_of(self, word: bytes) -> tuple[int, ...]:
        whole = (self.words[word],) if word in self.words else ()
        return whole + tuple(known[word[:n]] for n, known in self.starts if word[:n] in known)

    def vector(self, text: bytes) -> list[tuple[int, float]]:
        """(feature, value): up to three features for each item that occurs."""
        words, least, gate, seen = text.translate(_WORDS).split(), self.least, self.gate, Counter()
        for w, n in Counter([w for w in words if w[:least] in gate]).items():
            for i in self.items_of(w):
                seen[i] += n
        total = max(1, len(words))
        return [x for i in sorted(seen) for x in ((3 * i, 1.0), (3 * i + 1, float(seen[i] > 1)), (3 * i + 2, math.log1p(100 * seen[i] / total))) if x[1]]


class SparseRows:
    """A matrix of (row, column, value) entries."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]) -> None:
        self.row, self.column, self.value, self.shape = row, column, value, shape

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    @property
    def T(self) -> SparseRows:
        return SparseRows(self.column, self.row, self.value, self.shape[::-1])


@dataclass(frozen=True)
class OrdinalModel:
    words: tuple[bytes, ...]
    weights: tuple[float, ...]  # three for each word
    thresholds: tuple[float, ...]

    def above(self, s: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - s[:, None], -700, 700)))


def fit_ordinal(x: np.ndarray | SparseRows, y: np.ndarray, p: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that minimise the penalised negative log likelihood (Adam, full batch)."""
    n, v, k = len(y), x.shape[1], p.grades
    share = (np.array([(y < g).sum() for g in range(1, k)]) + 0.5 * np.arange(1, k) / k) / (n + 0.5)
    cut = np.log(share / (1 - share))
    params = np.concatenate([np.zeros(v), cut[:1], np.log(np.maximum(np.diff(cut), 1e-2))])
    m, s2 = np.zeros_like(params), np.zeros_like(params)
    lower, upper = y > 0, y < k - 1
    for step in range(1, p.steps + 1):
        w, t0, gaps = params[:v], params[v], np.exp(params[v + 1 :])
        t = t0 + np.concatenate([[0], np.cumsum(gaps)])
        s = x @ w
        hi = np.where(upper, 1 / (1 + np.exp(np.clip(s - t[np.minimum(y, k - 2)], -30, 30))), 1.0)
        lo = np.where(lower, 1 / (1 + np.exp(np.clip(s - t[np.maximum(y - 1, 0)], -30, 30))), 0.0)
        prob = np.maximum(hi - lo, 1e-12)
        grad_s = 1 - hi - lo  # of the negative log likelihood
        grad_t = np.zeros(k - 1)
        np.add.at(grad_t, np.minimum(y, k - 2)[upper], (-hi * (1 - hi) / prob)[upper])
        np.add.at(grad_t, (y - 1)[lower], (lo * (1 - lo) / prob)[lower])
        tail = np.cumsum(grad_t[::-1])[::-1]
        g = np.concatenate([x.T @ grad_s / n + p.l2 * w, [tail[0] / n], tail[1:] * gaps / n])
        m, s2 = 0.9 * m + 0.1 * g, 0.99 * s2 + 0.01 * g * g
        params -= p.rate * (m / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.99**step)) + 1e-8)
    return params[:v], params[v] + np.concatenate([[0], np.cumsum(np.exp(params[v + 1 :]))])


def _counted(batches: Iterator[pa.RecordBatch], flush: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """(word, b, a): in how many clean and toxic texts of a task; more than ``flush`` words are given out early."""
    seen = [Counter(), Counter()]

    def made() -> pa.RecordBatch:
        words = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen[0][w] for w in words], pa.int64()), pa.array([seen[1][w] for w in words], pa.int64())], names=["word", "b", "a"])

    for batch in batches:
        for text, y in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
            seen[y].update(items(tally(text)) | {b""})
            if len(seen[0]) + len(seen[1]) > flush:
                yield made()
                seen = [Counter(), Counter()]
    yield made()


def _select(counts: DataFrame, p: ToxicityParams) -> tuple[list, int, int]:
    """The rows (word, b, a) of the words that are features, and the numbers of clean and toxic texts."""
    total = counts.where(F.octet_length("word") == 0).first()
    n0, n1 = (total.b, total.a) if total else (0, 0)
    if not n0 or not n1:
        return [], n0, n1
    a, b, n = F.col("a"), F.col("b"), n0 + n1
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    cells = [(a, (a + b) * n1 / n), (b, (a + b) * n0 / n), (n1 - a, (n - a - b) * n1 / n), (n0 - b, (n - a - b) * n0 / n)]
    ranked = counts.where(F.octet_length("word") > 0).withColumn("g2", 2 * sum(part(o, F.greatest(e, F.lit(1e-9))) for o, e in cells)).where(F.col("g2") >= p.least_g2)
    chosen, spans = [], {}
    for r in ranked.orderBy(F.col("g2").desc(), F.octet_length("word").desc(), "word").limit(4 * p.vocabulary).collect():
        stem = bytes(r.word).lstrip(b" ")
        if len(chosen) < p.vocabulary and not any(w.startswith(stem) for w in spans.get((r.a, r.b), ())):  # else it marks the same texts
            chosen.append(r)
            spans.setdefault((r.a, r.b), []).append(stem)
    return chosen, n0, n1


def fit(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> OrdinalModel:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``."""
    drawn = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    drawn = drawn.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(p.max_train)  # so many ids at most are sent out
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = materialize(rows.select("text", "y", F.col("doc_id").cast("string").alias("name")), "drawn")
    counts = rows.select("text", "y").mapInArrow(_counted, "word binary, b long, a long").groupBy("word").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    chosen, n0, n1 = _select(materialize(counts.where(F.col("a") + F.col("b") >= p.least_rows), "words"), p)
    base = math.log((n1 + 0.5) / (n0 + 0.5))
    if not chosen:
        return OrdinalModel((), (), tuple(-base + i for i in range(p.grades - 1)))
    words = tuple(bytes(r.word) for r in chosen)
    known, telling = Vocabulary(words), np.array([r.a * n0 > r.b * n1 for r in chosen])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [known.vector(t) for t in texts_of(batch.column(0))]
            at = [np.array([i for i, _ in v], "<u2").tobytes() for v in vectors]
            value = [np.array([x for _, x in v], "<f8").tobytes() for v in vectors]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["name", "y", "at", "value"])

    got = rows.mapInArrow(mark, "name string, y int, at binary, value binary").toArrow().sort_by("name")  # max_train rows at most
    toxic, at = got["y"].to_numpy(), [np.frombuffer(x, "<u2") for x in got["at"].to_pylist()]
    x = SparseRows(np.repeat(np.arange(len(at)), [len(i) for i in at]), np.concatenate(at).astype(np.int64), np.frombuffer(b"".join(got["value"].to_pylist()), "<f8"), (len(at), 3 * len(words)))
    rates = np.zeros(3 * len(words))
    rates[2::3] = telling
    strength = x @ rates
    cuts = np.quantile(strength[toxic == 1], [(g + 1) / (p.grades - 1) for g in range(p.grades - 2)])
    y = np.where(toxic == 1, 1 + (strength[:, None] > cuts[None, :]).sum(axis=1), 0)
    w, t = fit_ordinal(x, y, p)
    return OrdinalModel(words, tuple(w.tolist()), tuple(t.tolist()))


FIELDS = [T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]


def score(docs: DataFrame, model: OrdinalModel, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """``docs`` with expected severity (0 to 3), probability of grade 1 or more, likeliest grade, toxic."""
    known, weights = Vocabulary(model.words), model.weights

    def run(column: pa.Array) -> list:
        s = np.array([math.fsum(weights[i] * x for i, x in known.vector(t)) for t in texts_of(column)], float)
        above = model.above(s)
        each = -np.diff(np.concatenate([np.ones((len(s), 1)), above, np.zeros((len(s), 1))], axis=1), axis=1)
        return [pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(each.argmax(axis=1), pa.int32()), pa.array((above[:, 0] >= p.reject) & bool(model.words))]

    return append_columns(docs, "text", run, FIELDS)

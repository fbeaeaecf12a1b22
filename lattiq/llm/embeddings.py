"""Embedding near-dedup with randomised-rotation binary codes.

Vectors are normalised in double precision; equal ones collapse to one class first. Each class is
coded once, and the codes are a written table: the signs of its coordinates under random rotations, the
correction factor <x-bar, o> of the first rotation's code x-bar, and that rotation's coordinates in
8 bits. Bands of code bits propose pairs. A pair's inner product is estimated without bias from one
side's code and factor and the other side's 8-bit coordinates; a pair whose upper confidence bound is
below the threshold goes. Only rows that some pair leaves undecided fetch their vectors, and only those
pairs are computed exactly.

The width of a band follows the number of classes, so that a vector meets about ``fill`` unrelated ones
in a bucket at any size, and the number of bands follows from ``miss``, the chance that a pair right at
the threshold shares no band. Large buckets are cut into blocks that meet pair by pair, in tiles of a
matrix. A pair is counted in its first shared band only, so no pair is ever written: blocks give link
counts and a spanning forest.

Edge cases: null, empty and zero vectors and those with null or non-finite components link with
nothing; vectors of different lengths never link, very long ones are coded like any other; rows with
equal or null ids are vectors of their own; a cosine of exactly the threshold links; columns other than
vec_id and embedding are not read, so names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.llm.common import append_columns, components
from lattiq.shared import materialize


@dataclass(frozen=True)
class EmbeddingParams:
    threshold: float = 0.95
    miss: float = 1e-3
    fill: float = 0.25
    sigmas: float = 4.0  # of the estimate, on either side
    block: int = 4096  # rows of a bucket that are compared at once with as many others
    small: int = 48  # rows of a group up to which pairs are listed, not laid out as a matrix
    tile: int = 512
    seed: int = 5

    def shape(self, n: int) -> tuple[int, int]:
        """Bits of a band and number of bands for n classes."""
        bits = int(min(48, max(4, math.ceil(math.log2(max(n, 2) / self.fill)))))  # 48 bits do for 10^13 classes
        agree = 1 - math.acos(self.threshold) / math.pi
        return bits, math.ceil(math.log(self.miss) / math.log1p(-(agree**bits)))


def rotation(dim: int, seed: int, number: int) -> np.ndarray:
    """A uniformly random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, number]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _unit(values: list | None) -> np.ndarray | None:
    if values is None or not len(values) or any(v is None for v in values):
        return None
    x = np.array(values, np.float64) + 0.0  # -0.0 becomes 0.0
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum())


def _classes(column: pa.Array) -> list:
    units = [_unit(v) for v in column.to_pylist()]
    raw = [None if u is None else u.tobytes() for u in units]
    return [pa.array([None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary())]


def _stack(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw)).reshape(len(raw), -1)


def _by_length(raw: list[bytes]) -> Iterator[np.ndarray]:
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n)


class Bands:
    """Sign codes under as many rotations as the bands need, and the band keys that lie in a code."""

    def __init__(self, p: EmbeddingParams, bits: int, n_bands: int) -> None:
        self.p, self.bits, self.n_bands, self.turns = p, bits, n_bands, {}

    def per(self, dim: int) -> int:
        """Bands of one rotation."""
        return max(1, dim // self.bits)

    def rotations(self, dim: int) -> list[np.ndarray]:
        if dim not in self.turns:
            self.turns[dim] = [rotation(dim, self.p.seed, i) for i in range(math.ceil(self.n_bands / self.per(dim)))]
        return self.turns[dim]

    def code(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed signs (rows, bytes) under all rotations, and the coordinates under the first."""
        turned = [units @ r.T for r in self.rotations(units.shape[1])]
        return np.packbits(np.concatenate([x > 0 for x in turned], axis=1), axis=1), turned[0]

    def keys(self, codes: np.ndarray, dim: int) -> np.ndarray:
        """(rows, bands) of 31-bit keys; those of vectors of different lengths seldom agree."""
        use, per = min(self.bits, dim), self.per(dim)
        powers, out = 1 << np.arange(use, dtype=np.int64), []
        signs = np.unpackbits(codes, axis=1)
        for at in range(0, math.ceil(self.n_bands / per) * dim, dim):
            out.append(signs[:, at : at + per * use].reshape(len(codes), per, use) @ powers)
        keys = np.concatenate(out, axis=1)[:, : self.n_bands] * 64 + dim % 64
        if self.bits > 24:  # wider codes are hashed to 31 bits; equal codes stay equal
            keys = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).view(np.int64)
        return keys.astype(np.int32)


CODED = "cid long, size long, code binary, factor double, levels binary, step double, keys array<int>"


def _coder(p: EmbeddingParams, bits: int, n_bands: int):
    """(cid, unit, size) to ``CODED``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(p, bits, n_bands)
        for batch in batches:
            raw, n = batch.column(1).to_pylist(), batch.num_rows
            code, levels, keys = [b""] * n, [b""] * n, np.zeros((n, n_bands), np.int32)
            factor, step = np.zeros(n), np.zeros(n)
            for at in _by_length(raw):
                packed, first = bands.code(_stack([raw[i] for i in at]))
                keys[at] = bands.keys(packed, first.shape[1])
                factor[at] = np.abs(first).sum(axis=1) / math.sqrt(first.shape[1])  # <x-bar, o>
                step[at] = np.abs(first).max(axis=1) / 127
                level = np.rint(first / step[at, None]).astype(np.int8)
                for k, i in enumerate(at):
                    code[i], levels[i] = packed[k].tobytes(), level[k].tobytes()
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, n_bands, dtype=np.int32), keys.ravel())
            columns = [batch.column(0), batch.column(2), pa.array(code, pa.binary()), pa.array(factor), pa.array(levels, pa.binary()), pa.array(step), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["cid", "size", "code", "factor", "levels", "step", "keys"])

    return run


HEADS = ("band", "bucket", "lo", "hi")


class Chunk:
    """Whole groups of coded rows of one vector length, in order of group and cid."""

    def __init__(self, table: pa.Table, at: np.ndarray, bands: Bands) -> None:
        column = lambda c: table.column(c).to_numpy()[at]
        heads = np.stack([column(c) for c in HEADS], axis=1)
        packed, levels = ([table.column(c)[int(i)].as_py() for i in at] for c in ("code", "levels"))
        dim, p = len(levels[0]), bands.p
        codes = np.frombuffer(b"".join(packed), np.uint8).reshape(len(at), -1)
        self.p, self.band, self.alone, self.own, self.size = p, heads[:, 0], heads[:, 2] == heads[:, 3], column("own"), column("size")
        self.begins = np.flatnonzero(np.concatenate(([True], (heads[1:] != heads[:-1]).any(axis=1))))
        self.ends = np.concatenate((self.begins[1:], [len(at)]))
        self.keys = bands.keys(codes, dim)
        sign = np.unpackbits(codes, axis=1)[:, :dim].astype(np.float32) * 2 - 1
        factor, step = column("factor"), column("step")
        self.sign = sign / np.float32(math.sqrt(dim)) / factor[:, None].astype(np.float32)
        self.turned = np.frombuffer(b"".join(levels), np.int8).reshape(len(at), dim) * step[:, None].astype(np.float32)
        off = np.sqrt(np.maximum(1 - factor**2, 0) / max(1, dim - 1)) / factor  # of an estimate
        self.least = (p.threshold - p.sigmas * (off + step.max(initial=0) / math.sqrt(12) / factor) - 1e-6).astype(np.float32)
        self.unit = _stack([table.column("unit")[int(i)].as_py() for i in at]) if "unit" in table.column_names else None

    def listed(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Undecided pairs (i, j) of the small groups, in their first shared band."""
        sizes = self.ends - self.begins
        end = np.repeat(np.where(sizes <= self.p.small, self.ends, 0), sizes)
        live, d = np.arange(len(end)), 1
        while len(live := live[live + d < end[live]]):
            for at in range(0, len(live), 8192):
                i = live[at : at + 8192]
                i = i[self.alone[i] | (self.own[i] != self.own[i + d])]
                i = i[np.einsum("ij,ij->i", self.sign[i], self.turned[i + d]) >= self.least[i]]
                i = i[(self.keys[i] == self.keys[i + d]).argmax(axis=1) == self.band[i]]
                if len(i):
                    yield i, i + d
            d += 1

    def tiles(self) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """Rows, rows and the matrix of their undecided pairs, of the large groups."""
        t = self.p.tile
        for s, e in zip(self.begins.tolist(), self.ends.tolist()):
            if e - s <= self.p.small:
                continue
            for a in range(s, e, t):
                for b in range(a, e, t):
                    i, j = slice(a, min(a + t, e)), slice(b, min(b + t, e))
                    maybe = self.sign[i] @ self.turned[j].T >= self.least[i, None]
                    if a == b:
                        maybe &= np.tri(i.stop - a, dtype=bool).T & ~np.eye(i.stop - a, dtype=bool)
                    if not self.alone[s]:
                        maybe &= self.own[i, None] != self.own[None, j]
                    for k in range(self.band[s]):  # pairs of an earlier band are done there
                        if not maybe.any():
                            break
                        maybe &= self.keys[i, k, None] != self.keys[None, j, k]
                    if maybe.any():
                        yield i, j, maybe

    def undecided(self) -> np.ndarray:
        """The rows that some pair leaves undecided."""
        marked = np.zeros(len(self.own), bool)
        for i, j in self.listed():
            marked[i] = marked[j] = True
        for i, j, maybe in self.tiles():
            marked[i] |= maybe.any(axis=1)
            marked[j] |= maybe.any(axis=0)
        return np.flatnonzero(marked)

    def links(self) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Links of each row, counted with their classes' sizes, and forest edges."""
        root, counts, threshold = list(range(len(self.own))), np.zeros(len(self.own), np.int64), self.p.threshold

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        def join(i: int, j: int) -> None:
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)

        def exact(i, j) -> np.ndarray:
            return np.einsum("ij,ij->i", self.unit[i], self.unit[j]) >= threshold

        for i, j in self.listed():
            sure = exact(i, j)
            i, j = i[sure], j[sure]
            np.add.at(counts, i, self.size[j])
            np.add.at(counts, j, self.size[i])
            for x, y in zip(i.tolist(), j.tolist()):
                join(x, y)
        for i, j, maybe in self.tiles():
            cosine = self.unit[i] @ self.unit[j].T
            linked = maybe & (cosine >= threshold)
            close = np.argwhere(maybe & (np.abs(cosine - threshold) < 1e-9))  # where the order of the sum may matter
            linked[close[:, 0], close[:, 1]] = exact(i.start + close[:, 0], j.start + close[:, 1])
            counts[i] += linked @ self.size[j]
            counts[j] += linked.T @ self.size[i]
            rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            label, part = rows.copy(), linked[np.ix_(rows, columns)]
            while len(rows):  # the smallest row that a row reaches through shared columns
                through = np.where(part, label[:, None], len(linked)).min(axis=0)
                after = np.where(part, through[None, :], len(linked)).min(axis=1)
                if (after == label).all():
                    break
                label = after
            for x, y in zip((rows + i.start).tolist(), (label + i.start).tolist() if len(rows) else []):
                join(x, y)
            for x, y in zip((columns + j.start).tolist(), (through + i.start).tolist() if len(rows) else []):
                join(x, y)
        return counts, [(i, find(i)) for i in range(len(root)) if root[i] != i]


def _by_group(batches: Iterator[pa.RecordBatch], rows_at_once: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole groups; rows that agree in HEADS lie together."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:  # a group may end in a later batch; its rows so far wait
        held.append(batch)
        rows += batch.num_rows
        if rows < rows_at_once:
            continue
        table = pa.Table.from_batches(held)
        heads = np.stack([table.column(c).to_numpy() for c in HEADS], axis=1)
        cut = rows - int((heads == heads[-1]).all(axis=1)[::-1].argmin()) if (heads != heads[-1]).any() else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        rows -= cut
    if rows:
        yield pa.Table.from_batches(held)


def link(classes: DataFrame, p: EmbeddingParams) -> DataFrame:
    """(cid, other, links): link counts (other null) and forest edges of ``classes(cid, unit, size)``."""
    bits, n_bands = p.shape(classes.count())
    coded = materialize(classes.select("cid", "unit", "size").mapInArrow(_coder(p, bits, n_bands), CODED), "codes")
    banded = coded.select("cid", F.posexplode("keys").alias("band", "bucket"))
    full = materialize(banded.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    met = banded.join(full, ["band", "bucket"])
    nb = F.ceil(F.col("n") / p.block)
    met = met.withColumns({"own": F.pmod(F.xxhash64("cid"), nb).cast("int"), "other": F.explode(F.sequence(F.lit(0), (nb - 1).cast("int")))})
    met = met.select("cid", "band", "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own")
    dealt = lambda x: x.repartition(*HEADS).sortWithinPartitions(*HEADS, "cid")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, Chunk]]:
        bands = Bands(p, bits, n_bands)
        for table in _by_group(batches):
            lengths = table.column("levels").combine_chunks()
            for at in _by_length(lengths.to_pylist()):  # buckets of different lengths differ, but for rare equal keys
                yield table, at, Chunk(table, at, bands)

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at, chunk in chunks(batches):
            if len(keep := at[chunk.undecided()]):
                yield from table.take(keep).combine_chunks().to_batches()

    def recompute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at, chunk in chunks(batches):
            counts, edges = chunk.links()
            cid, some = table.column("cid").to_numpy()[at], np.flatnonzero(counts)
            a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
            other = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(cid[b], pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([cid[some], cid[a]]), pa.int64()), other, pa.array(np.concatenate([counts[some], np.zeros(len(a), np.int64)]), pa.int64())], names=["cid", "other", "links"])

    rows = dealt(met.join(coded.drop("keys"), "cid"))
    left = materialize(rows.mapInArrow(estimate, rows.schema), "undecided")
    return dealt(left.join(classes.select("cid", "unit"), "cid")).mapInArrow(recompute, "cid long, other long, links long")


def near_duplicates(rows: DataFrame, p: EmbeddingParams = EmbeddingParams()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``rows(vec_id, embedding)``."""
    fields = [T.StructField("key", T.BinaryType()), T.StructField("unit", T.BinaryType())]
    keyed = materialize(append_columns(rows.select("vec_id", "embedding"), "embedding", _classes, fields).select("vec_id", "key", "unit"), "vectors")
    classes = keyed.where("key IS NOT NULL").groupBy("key").agg(F.first("unit").alias("unit"), F.count("*").alias("size"), F.min("vec_id").alias("least"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = materialize(link(classes, p), "links")
    roots = components(found.where("other IS NOT NULL").select("cid", "other")).toDF("cid", "root")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.select("cid", "key", "size", "least").join(roots, "cid", "left").join(links, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = materialize(named, "named")
    least = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")  # read anew, so that a large component's rows can be split in the join
    by_key = materialize(named.join(least, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id"), "components")
    out = keyed.select("vec_id", "key").join(by_key, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").isNull() & F.col("component_id").isNull()))


ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.95 * a.n * b.n AND a.n > 0 AND b.n > 0),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a)
SELECT v.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = v.vec_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = v.vec_id
""".replace("WITH v", "WITH RECURSIVE v", 1)

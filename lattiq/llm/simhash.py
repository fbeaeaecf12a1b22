"""SimHash near-dedup by the generalised pigeonhole principle.

Two fingerprints that differ in at most t bits agree up to t_i bits in some partition i of the
bits, whenever the sum of (t_i + 1) is t + 1. Correlated bits go into one partition, and dynamic
programming picks the number of partitions and their unequal thresholds (-1: not probed) from
estimated probe and candidate counts. Probes meet on (partition, value) and candidates are verified.

Edge cases: null and empty texts have fingerprint zero and link like any other; very long texts are
fingerprinted whole, in chunks of shingles; a bit set in exactly half the hashes is 0; rows with equal,
repeated or null doc_ids each keep their own row (a group without any id has a null component_id); of
other columns only ``deduplicate`` takes note, and keeps them; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.llm.common import append_columns, components, texts_of
from lattiq.shared import materialize

BITS = 64
_CHUNK = 1 << 15


@dataclass(frozen=True)
class SimHashParams:
    shingle_words: int = 3
    seed: int = 42
    max_bits: int = 2
    sample: int = 4096  # fingerprints from which costs are estimated; results do not depend on it
    heavy: int = 64  # rows of a probe key beyond which its members take the linear path


def fingerprint(text: bytes, shingle_words: int = 3, seed: int = 42) -> int:
    words = text.lower().split()  # on bytes: only A-Z, and splits at \x20 \x09-\x0D alone
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle_words + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = (ends[shingle_words - 1 :] if len(words) >= shingle_words else ends[-1:]).tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(joined[i:j], seed) for i, j in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, p: SimHashParams = SimHashParams(), text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with the 64-bit fingerprint of each whole text as a signed long."""

    def run(column: pa.Array) -> list:
        made = np.array([fingerprint(x, p.shingle_words, p.seed) for x in texts_of(column)], np.uint64)
        return [pa.array(made.view(np.int64), pa.int64())]

    return append_columns(docs, text, run, [T.StructField(out, T.LongType())])


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of near-equal size, each grown from correlated bits. bits: (n, 64) of 0/1."""
    x = bits - bits.mean(axis=0)
    sd = np.sqrt((x**2).sum(axis=0))
    corr = np.abs(x.T @ x / np.maximum(np.outer(sd, sd), 1e-9))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for i in range(m):
        size = len(free) // (m - i)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(sample: np.ndarray, n: int, max_bits: int) -> list[tuple[int, int]]:
    """[(mask, threshold)] of the cheapest plan. sample: some distinct fingerprints of the n."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    p = bits.mean(axis=0)
    agree = np.clip(p * p + (1 - p) * (1 - p), 0.05, 0.999)
    best: tuple[float, list] = (np.inf, [])
    for m in range(1, max_bits + 3):
        groups, cost = group_bits(bits, m), []
        for g in groups:
            mask = np.uint64(sum(1 << b for b in g))
            part = sample & mask
            pairs, odds = len(sample) * (len(sample) - 1) / 2, ((1 - agree) / agree)[g]
            near = np.zeros(max_bits + 1)
            for at in range(0, len(part), 512):
                d = np.bitwise_count(part[at : at + 512, None] ^ part[None, :])
                near += [(d <= t).sum() for t in range(max_bits + 1)]
            row, model, probes = [0.0], agree[g].prod(), 0
            terms = [1.0, odds.sum(), (odds.sum() ** 2 - (odds**2).sum()) / 2]
            for t in range(max_bits + 1):
                probes += comb(len(g), t)
                chance = max((near[t] - len(sample)) / 2 / max(pairs, 1), model * sum(terms[: t + 1]))
                row.append(n * probes + n * n / 2 * chance)
            cost.append(row)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:  # spend max_bits + 1 units; u units on a partition probe it up to u - 1 bits
            after: dict[int, tuple[float, list[int]]] = {}
            for spent, (total, chosen) in table.items():
                for u in range(max_bits + 2 - spent):
                    x = (total + row[u], [*chosen, u - 1])
                    if spent + u not in after or x[0] < after[spent + u][0]:
                        after[spent + u] = x
            table = after
        total, chosen = table[max_bits + 1]
        if total < best[0]:
            best = (total, [(sum(1 << b for b in g), t) for g, t in zip(groups, chosen) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _flips(mask: int, t: int) -> list[int]:
    """XOR patterns of 1 to t bits inside the mask."""
    out, ones = [], [b for b in range(BITS) if mask >> b & 1]
    frontier = [(0, -1)]
    for _ in range(t):
        frontier = [(x | 1 << ones[j], j) for x, i in frontier for j in range(i + 1, len(ones))]
        out += [_signed(x) for x, _ in frontier]
    return out


def link_fingerprints(fps: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``fps(fp)`` within ``max_bits`` bits.

    Pairs that meet in ordinary keys come as they are. The members of a key with over ``heavy`` rows
    are linked through the values one bit away from them: for two bits, two fingerprints are that
    near exactly if they share such a value (or their own), and at most 65 share one, so this costs
    65 rows a member, with no group that grows; one link to the smallest member stands for each.
    """
    if p.max_bits > 2:
        raise ValueError("the exact path for heavy keys holds for at most two bits")
    n = fps.count()
    drawn = [r.fp for r in fps.orderBy(F.xxhash64("fp", F.lit(p.seed)), "fp").limit(p.sample).collect()]
    if n < 2:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    plan = allocate(np.array(drawn, np.int64).view(np.uint64), n, p.max_bits)
    rows = None
    for i, (mask, t) in enumerate(plan):
        own = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        part = fps.select(F.lit(i).alias("part"), own.alias("value"), "fp", F.lit(True).alias("home"))
        if t > 0:
            flips = F.array(*[F.lit(x) for x in _flips(mask, t)])
            guests = fps.select(F.lit(i).alias("part"), F.explode(F.transform(flips, lambda f, o=own: o.bitwiseXOR(f))).alias("value"), "fp", F.lit(False).alias("home"))
            part = part.unionByName(guests)
        rows = part if rows is None else rows.unionByName(part)
    keys = rows.groupBy("part", "value").agg(F.count("*").alias("n"), F.count_if("home").alias("h")).where("n > 1 AND h > 0")
    keys = materialize(keys.select("part", "value", "n"), "keys")  # read anew, so that a heavy key's rows can be split in the join
    met = materialize(rows.join(keys, ["part", "value"]), "met")
    light = met.where(F.col("n") <= p.heavy)
    left = light.where("home").select("part", "value", F.col("fp").alias("a"))
    right = light.select("part", "value", F.col("fp").alias("b"))
    near = left.join(right, ["part", "value"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= p.max_bits)).select("a", "b")
    heavy = met.where(F.col("n") > p.heavy).select("fp").distinct()
    steps = F.array(F.lit(0), *[F.lit(_signed(1 << b)) for b in range(BITS if p.max_bits == 2 else 0)])
    if p.max_bits == 1:  # two values one bit apart: the smaller one's neighbour is the other
        spread = heavy.select("fp", F.explode(F.array(*[F.col("fp").bitwiseAND(F.lit(~_signed(1 << b))) for b in range(BITS)])).alias("via"))
    else:
        spread = heavy.select("fp", F.explode(F.transform(steps, lambda s: F.col("fp").bitwiseXOR(s))).alias("via"))
    star = spread.groupBy("via").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # at most 65
    star = star.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct() if p.max_bits else star.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).limit(0)
    return near.unionByName(star)


def classes_of(docs: DataFrame, p: SimHashParams) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp), and each fingerprint's (fp, root, component_id)."""
    rows = materialize(with_fingerprints(docs.select("doc_id", "text"), p).select("doc_id", "fp"), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(link_fingerprints(classes.select("fp"), p)).toDF("fp", "root")
    named = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, materialize(named.join(least, "root").select("fp", "root", "component_id"), "components")


def near_duplicates(docs: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs(doc_id, text)``."""
    rows, by_fp = classes_of(docs, p)
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


_SLOTS, _SLOT_BITS = 1 << 17, 64


def _slot(c) -> tuple:
    h = F.pmod(F.xxhash64(c, F.lit(9)), F.lit(_SLOTS * _SLOT_BITS))
    return F.shiftright(h, 6), h.bitwiseAND(F.lit(_SLOT_BITS - 1)).cast("int")


def deduplicate(docs: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id.

    Texts that stay are not shuffled if they can be told apart cheaply: the ids to drop set bits of
    a table of fixed size (2^17 rows at most, so it may be broadcast). Rows whose bit is clear stay;
    only the others are joined with the ids. The more ids go, the more rows take the join, and the
    result is the same. If several rows of a group have its smallest id, or none has an id, the one
    with the least text stays, then that of the least columns (as JSON); rows that share an id but lie
    in different groups are not related. Columns of any name and type come through untouched.
    """
    rows, by_fp = classes_of(docs, p)
    names = [f"c{i}" for i in range(len(docs.columns))]  # while here, so that no column meets a name used below
    inner, id_, text = docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    verdict = rows.where("doc_id IS NOT NULL").join(by_fp, "fp").groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("stay"), F.count("*").alias("n"))
    odd = materialize(verdict.where("stay <> 1 OR n <> 1"), "dropped")  # ids of which not just one row comes and stays
    slot, bit = _slot(F.col(id_))
    from_id, in_id = _slot(F.col("doc_id"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), in_id)
    bits = odd.select(from_id.alias("slot"), one.alias("one")).groupBy("slot").agg(F.bit_or("one").alias("bits"))
    told = inner.where(F.col(id_).isNotNull()).join(F.broadcast(bits), slot == F.col("slot"), "left")
    mark = F.call_function("shiftright", F.col("bits"), bit).bitwiseAND(F.lit(1).cast("long")) == 1
    hit = F.coalesce(mark, F.lit(False))
    sure, unsure = told.where(~hit).select(*names), told.where(hit).select(*names)
    out = sure.unionByName(unsure.join(odd.select(F.col("doc_id").alias(id_)), id_, "left_anti").select(*names))
    least = F.min_by(F.struct(*names), F.struct(text, F.to_json(F.struct(*names)))).alias("row")
    again = odd.where("stay > 0").select(F.col("doc_id").alias(id_))
    nameless = by_fp.where("component_id IS NULL").select("fp", "root")
    if not again.isEmpty():  # an id of several rows
        marked = with_fingerprints(unsure.join(again, id_, "left_semi").select(*names), p, text).join(by_fp, "fp")
        stays = marked.where(F.col(id_) == F.col("component_id"))
        out = out.unionByName(stays.groupBy("root").agg(least).select("row.*"))
    if not nameless.isEmpty():
        marked = with_fingerprints(inner.where(F.col(id_).isNull()), p, text).join(nameless, "fp")
        out = out.unionByName(marked.groupBy("root").agg(least).select("row.*"))
    return out.toDF(*docs.columns)

"""Benchmark decontamination with training suffix arrays.

Each shard of documents (an Arrow batch) becomes one token array with a sorted array of its
suffixes. Only suffixes that begin with the leading words of some benchmark window can hold a match
of window length, so the array leaves the others out. Every test suffix, cut to a window, is
binary-searched in it (equal windows once): the interval that shares the window gives all its
occurrences. From each place that has one, the match goes on through the sorted suffixes of the
benchmark, whose interval narrows word by word; where it would become empty, the longest verbatim match
from that place is known, with all items that hold it. A match holds a whole window of its item (13 words,
or all of a shorter item); others are not looked for, and ``longest`` is 0 without one.

Of equally long matches the smallest item_id as a string is named, at its first place in the document.

Edge cases: null and empty texts have no words, are never contaminated and match nothing; an item
without words is skipped; a null item_id is skipped; repeated items count once by their id, and equal
ones are searched once; repeated rows are judged each for itself; very long texts are judged whole; an
input column named like a result is replaced (``lattiq.llm.common.apart`` keeps all), others stay; an
empty benchmark or document table works.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.llm.common import append_columns, free_name, texts_of
from lattiq.shared import materialize

#: Bytes: A-Z to a-z; all but digits, letters and bytes from 0x80 on to a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class DecontamParams:
    window: int = 13
    lead: int = 4  # words by which suffixes are chosen for the array
    share: int = 20  # contaminated from one hit word in so many
    block_bytes: int = 32 << 20  # of benchmark text that one pass holds; more text takes more passes


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Benchmark:
    """Items as token arrays, their distinct windows, and their sorted suffixes. Token ids start at 1; 0 stands for other words.

    Items of equal words are one text; each window knows by a set's number which texts hold it.
    """

    def __init__(self, items: list[tuple[str, bytes]], p: DecontamParams) -> None:
        self.p, self.ids = p, {}
        texts: dict[tuple[int, ...], list[str]] = {}
        for name, text in items:
            if words := words_of(text):
                texts.setdefault(tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in words), []).append(name)
        order = sorted(texts, key=lambda t: min(texts[t]))  # so that the smaller text has the smaller name
        self.names = [sorted(set(texts[t])) for t in order]
        ends = np.cumsum([len(t) + 1 for t in order], dtype=np.int64)
        self.tokens = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)  # a zero ends each text
        self.text_of = np.repeat(np.arange(len(order)), [len(t) + 1 for t in order])
        held: dict[tuple[int, ...], list[int]] = {}  # window -> its first place, then texts
        for k, t in enumerate(order):
            start = int(ends[k]) - len(t) - 1
            self.tokens[start : start + len(t)] = t
            n = min(p.window, len(t))
            for i in range(len(t) - n + 1):
                x = held.setdefault(t[i : i + n], [start + i])
                if x[-1] != k or len(x) == 1:
                    x.append(k)
        sets: dict[tuple[int, ...], int] = {}
        self.at = np.array([x[0] for x in held.values()], np.int64)
        self.length = np.array([len(w) for w in held], np.int64)
        self.set_of = np.array([sets.setdefault(tuple(x[1:]), len(sets)) for x in held.values()], np.int64)
        self.sets = list(sets)
        self._sort_suffixes()
        rng = np.random.default_rng(7)
        self.mult = rng.integers(1, 1 << 62, size=p.lead, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.leads = {}  # number of leading words -> bitmap over 2^20 hashes, for windows at least so long
        for g in range(1, p.lead + 1):
            own = self.at[np.minimum(self.length, p.lead) == g]
            if len(own):
                bits = np.zeros(1 << 20, bool)
                bits[self._hash(self.tokens, own, g)] = True
                self.leads[g] = bits

    def _sort_suffixes(self) -> None:
        """``suffixes``: the places of all words, ordered by what follows up to the end of the text (prefix doubling)."""
        n = len(self.tokens)
        rank, k = self.tokens.astype(np.int64), 1
        while n:
            after = np.concatenate([rank[k:], np.zeros(min(k, n), np.int64)])[:n]
            after[rank == 0] = 0  # nothing goes beyond an end
            sa = np.lexsort((after, rank))
            new = np.concatenate(([0], np.cumsum((rank[sa][1:] != rank[sa][:-1]) | (after[sa][1:] != after[sa][:-1]))))
            more, rank = new[-1] + 1, np.empty(n, np.int64)
            rank[sa] = new  # ends keep rank 0
            k *= 2
            if k >= n or more == n:
                break
            if k > int(np.diff(np.flatnonzero(self.tokens == 0), prepend=-1).max()):
                break  # longer than any text
        self.suffixes = sa[self.tokens[sa] > 0] if n else np.zeros(0, np.int64)

    def longest(self, tokens: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, words, text) of the longest matches of each document, among those that begin at the given places.

        first: where documents begin."""
        lo, hi, length = np.zeros(len(at), np.int64), np.full(len(at), len(self.suffixes), np.int64), np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        while len(live):
            key = tokens[at[live] + length[live]]
            live, key = live[key > 0], key[key > 0]
            a = _narrow(self.tokens, self.suffixes, length[live], lo[live], hi[live], key, "left")
            b = _narrow(self.tokens, self.suffixes, length[live], a, hi[live], key, "right")
            some = a < b
            live = live[some]
            lo[live], hi[live] = a[some], b[some]
            length[live] += 1
        doc, top = np.searchsorted(first, at, side="right") - 1, np.zeros(len(first), np.int64)
        np.maximum.at(top, doc, length)
        best = np.flatnonzero(length == top[doc])
        spans, which = np.unique(np.stack([lo[best], hi[best]]), axis=1, return_inverse=True)
        least = np.array([self.text_of[self.suffixes[a:b]].min() for a, b in spans.T.tolist()])  # the text of the smallest name
        return at[best], length[best], least[which.ravel()]

    def _hash(self, tokens: np.ndarray, at: np.ndarray, g: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for i in range(g):
            h += tokens[at + i].astype(np.uint64) * self.mult[i]
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def starts(self, tokens: np.ndarray) -> np.ndarray:
        """Positions of the padded tokens that may begin an occurrence of a window."""
        known = np.flatnonzero(tokens > 0)
        keep = np.zeros(len(known), bool)
        for g, bits in self.leads.items():
            keep |= bits[self._hash(tokens, known, g)]
        return known[keep]


def _narrow(tokens: np.ndarray, sa: np.ndarray, depth, lo: np.ndarray, hi: np.ndarray, key: np.ndarray, side: str) -> np.ndarray:
    """Binary search, in many intervals at once, for each one's key among the words ``depth`` on."""
    a, b = lo.copy(), hi.copy()
    while (open_ := a < b).any():
        mid = (a + b) >> 1
        t = tokens[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + depth, len(tokens) - 1)]  # closed intervals may point beyond
        low = open_ & ((t < key) if side == "left" else (t <= key))
        a = np.where(low, mid + 1, a)
        b = np.where(open_ & ~low, mid, b)
    return a


def _sorted(tokens: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Positions ordered by their next n tokens (a suffix array to that depth), then position."""
    order = np.lexsort([at, *[tokens[at + i] for i in range(n - 1, -1, -1)]])
    return at[order]


def _bounds(tokens: np.ndarray, sa: np.ndarray, bench: Benchmark, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of many benchmark windows of n words at once: intervals [lo, hi) of the array."""
    lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(sa), np.int64)
    for i in range(n):  # within an interval of equal first i words, the next words are sorted
        key = bench.tokens[bench.at[which] + i]
        first = _narrow(tokens, sa, i, lo, hi, key, "left")
        lo, hi = first, _narrow(tokens, sa, i, first, hi, key, "right")
        if not (lo < hi).any():
            break
    return lo, np.maximum(lo, hi)


def scan_shard(texts: list[bytes], bench: Benchmark) -> list[dict]:
    """For each text: words, hit words, items with occurring windows, and the longest match."""
    p, get = bench.p, bench.ids.get
    parts, counts = [], np.zeros(len(texts), np.int64)
    gap = [0] * p.window
    for i, t in enumerate(texts):
        words = words_of(t)
        counts[i] = len(words)
        parts.append(np.fromiter([get(w, 0) for w in words] + gap, np.int32, len(words) + p.window))
    tokens = np.concatenate([*parts, np.zeros(p.window, np.int32)]) if parts else np.zeros(p.window, np.int32)
    first = np.concatenate(([0], np.cumsum(counts + p.window)))
    out = [{"n_words": int(n), "n_hit": 0, "items": [], "longest": 0, "longest_item": None, "longest_at": None, "spans": []} for n in counts]
    at = bench.starts(tokens) if len(bench.at) else np.zeros(0, np.int64)
    change, touched, places = np.zeros(len(tokens) + 1, np.int32), {}, []  # places: (position, words, text)
    for n in np.unique(bench.length) if len(at) else ():
        which = np.flatnonzero(bench.length == n)
        sa = _sorted(tokens, at, int(n))
        lo, hi = _bounds(tokens, sa, bench, which, int(n))
        found = np.flatnonzero(lo < hi)
        if not len(found):
            continue
        size = hi[found] - lo[found]
        pos = sa[np.repeat(lo[found] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]
        np.add.at(change, pos, 1)
        np.add.at(change, pos + n, -1)
        doc = np.searchsorted(first, pos, side="right") - 1
        for d, k in np.unique(np.stack([doc, np.repeat(bench.set_of[which[found]], size)]), axis=1).T.tolist():
            touched.setdefault(d, set()).update(bench.sets[k])
        if n < p.window:  # a whole item of so few words
            places.append((pos, np.full(len(pos), n), np.repeat(bench.text_of[bench.at[which[found]]], size)))
        else:
            places.append(bench.longest(tokens, np.unique(pos), first))
    if not places:
        return out
    cover = np.cumsum(change[:-1]) > 0
    hit = np.concatenate(([0], np.cumsum(cover)))
    pos, length, text = (np.concatenate(x) for x in zip(*places))
    doc = np.searchsorted(first, pos, side="right") - 1
    order = np.lexsort((pos, text, -length, doc))
    best = dict(zip(doc[order].tolist()[::-1], order.tolist()[::-1]))  # the first of each document
    for d, texts_here in touched.items():
        edge = np.flatnonzero(np.diff(cover[first[d] : first[d + 1]].astype(np.int8), prepend=0, append=0)).tolist()
        out[d]["spans"] = list(zip(edge[::2], edge[1::2]))
        out[d] |= {"n_hit": int(hit[first[d + 1]] - hit[first[d]]), "items": sorted({n for k in texts_here for n in bench.names[k]}), "longest": int(length[best[d]])}
        out[d] |= {"longest_item": bench.names[text[best[d]]][0], "longest_at": int(pos[best[d]] - first[d])}
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())] + [T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType()), T.StructField("longest_item", T.StringType()), T.StructField("longest_at", T.LongType()), T.StructField("spans", _SPANS)]


_FOUND = ("items", "longest", "longest_item", "longest_at", "spans")
_TYPES = {"items_sha256": pa.string(), "contaminated": pa.bool_(), "items": pa.list_(pa.string()), "longest_item": pa.string(), "spans": pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))}


def _scan(docs: DataFrame, items: list[tuple[str, bytes]], p: DecontamParams, fields: list[T.StructField]) -> DataFrame:
    """``docs`` with what one block of items gives; the items go to the tasks."""
    held, cache = docs.sparkSession.sparkContext.broadcast((items, p)), {}

    def run(column: pa.Array) -> list:
        if "b" not in cache:
            cache["b"] = Benchmark(*held.value)
        rows = scan_shard(texts_of(column), cache["b"])
        for r in rows:
            r |= {"n_items": len(r["items"]), "items_sha256": hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), "contaminated": r["n_hit"] > 0 and p.share * r["n_hit"] >= r["n_words"]}
            r["spans"] = [{"a": a, "b": b} for a, b in r["spans"]]
        return [pa.array([r[f.name] for r in rows], _TYPES.get(f.name, pa.int64())) for f in fields]

    return append_columns(docs, "text", run, fields)


def judge(docs: DataFrame, benchmark: DataFrame, p: DecontamParams = DecontamParams()) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated, items (with occurring
    windows), the longest verbatim match: its words, item and place in the document (in words), and
    spans: the maximal runs [a, b) of hit words, in order.

    The benchmark's text is measured first. Up to ``block_bytes`` of it go to the tasks in one pass;
    a larger benchmark is cut into blocks of about that size by a hash of item and text, each a pass
    over the documents, and the hit intervals of a row are united; all results are the same. ``docs``
    is then written once with a number for each row, so that all passes name rows alike whatever
    executors come and go.
    """
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = -(-total // p.block_bytes) or 1
    part = lambda b: sorted((r.item_id, r.text.encode()) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect())
    if blocks == 1:
        return _scan(docs, part(0), p, FIELDS)
    new = {f.name.lower() for f in FIELDS}
    row = free_name(docs, "row")
    keyed = materialize(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]).withColumn(row, F.monotonically_increasing_id()), "numbered")
    fields = [f for f in FIELDS if f.name in _FOUND]
    found = None
    for b in range(blocks):
        one = materialize(_scan(keyed.select(row, "text"), part(b), p, fields).where(F.size("items") > 0).drop("text"), f"block{b}")
        found = one if found is None else found.unionByName(one)
    best = F.min_by(F.struct("longest", "longest_item", "longest_at"), F.struct(-F.col("longest"), F.col("longest_item"), F.col("longest_at")))
    found = found.groupBy(row).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), best.alias("best"))
    none, zero = F.array().cast(_SPANS), F.lit(0).cast("long")

    def unite(s, x):
        last = F.try_element_at(s, F.lit(-1))
        longer = F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        return F.when((F.size(s) > 0) & (x["a"] <= last["b"]), longer).otherwise(F.concat(s, F.array(x)))

    found = found.select(row, "items", F.aggregate("spans", none, unite).alias("spans"), "best.*").withColumn("n_hit", F.aggregate("spans", zero, lambda s, x: s + x["b"] - x["a"]))
    words = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"), F.lit(0))), F.lit(0))
    out = keyed.join(found, row, "left").withColumns({"n_words": F.when(F.col("text").isNull(), 0).otherwise(words).cast("long"), "n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>")), "longest": F.coalesce("longest", F.lit(0).cast("long")), "spans": F.coalesce("spans", none)})
    out = out.withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256), "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * p.share >= F.col("n_words"))})
    return out.select(*[c for c in keyed.columns if c != row], *[f.name for f in FIELDS])


ORACLE = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(lower_az, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
      FROM (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)),
bw AS (SELECT item, least(len(w), 13) AS n, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bw),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
dw AS (SELECT doc_id, n, w, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
occ AS (SELECT doc_id, item, i, x.n FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM dw) x JOIN win USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

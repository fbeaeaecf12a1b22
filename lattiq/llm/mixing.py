"""Mixing sources to target weights, cut at each source's exact word budget.

Every document gets a hash-random key, and within a source documents are ordered by it. Whole epochs
come first; the rest of the budget is cut exactly, inside one document if need be. The place of the
cut is found by distributed prefix sums over ranges of the key: words are summed for 4,096 ranges of
each source, a prefix sum finds the range that the budget ends in, that range is cut into 4,096 again,
and the last one's documents (a 2^-24th of the source, equal ones counted, not listed) are sorted. So
no task ever sees more than some thousand sums or documents of a source, whatever its share of all
rows, and what is sent to all tasks is one row a source: its budget and its cut. Texts never move.

One plan gives both results: ``mix`` says how many words of each document are taken, and
``with_mixture`` also gives their texts, one an epoch, the last one cut; ``mixture`` has a row for
each. The cut text ends with the last word taken.

Edge cases: null text has size 0 and takes nothing; a null source is a source of its own, the last
one; repeated rows are separate documents (if the cut falls among rows of equal id and size, these
alone are sorted by text, over many tasks, and counted off); very long texts are one row each, and may
be cut inside; columns other than doc_id, source and text are not read, so names cannot clash; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.shared import materialize

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (3, 1, 2)  # of the sources by code point, repeating
    share: Fraction = Fraction(3, 2)  # of all words
    most_epochs: int = 2
    range_bits: int = 12  # of the key, for each of two levels of ranges
    most_sent: int = 100_000  # sources up to which their table is sent to all tasks


def targets(sizes: list[int], p: MixParams = MixParams()) -> list[float]:
    """Each source's target: weights share the total, capped, the excess reshared until it fits.

    The sources with the least room for their weight are capped first, so one sorted pass does.
    """
    weight = [p.weights[i % len(p.weights)] for i in range(len(sizes))]
    out = [float(p.most_epochs * s) for s in sizes]
    rest, free = Fraction(sum(sizes)) * p.share, sum(weight)
    order = sorted(range(len(sizes)), key=lambda i: Fraction(sizes[i], weight[i]))
    for at, i in enumerate(order):
        each = rest / free
        if each * weight[i] <= p.most_epochs * sizes[i]:
            for k in order[at:]:
                out[k] = float(each * weight[k])
            break
        rest, free = rest - p.most_epochs * sizes[i], free - weight[i]
    return out


DIGEST = ("doc_id", "size", "source_size", "target", "taken", "source")


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, source, size, key) and more of each row."""
    size = F.coalesce(F.size(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
    size = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(size)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key"), *more)


def _budgets(slim: DataFrame, p: MixParams) -> tuple[DataFrame, int]:
    """(src, source_size, target, epochs, rest) of each source, rest: words beyond whole epochs; their number."""
    sources = slim.groupBy("source").agg(F.sum("size").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    sizes = [r.n for r in sources]
    goal = targets(sizes, p)
    epochs = [int(t) // n if n else 0 for n, t in zip(sizes, goal)]
    shape = T.StructType([T.StructField(n, k) for n, k in (("src", T.StringType()), ("source_size", T.LongType()), ("target", T.DoubleType()), ("epochs", T.IntegerType()), ("rest", T.LongType()))])
    columns = [[r.source for r in sources], sizes, goal, epochs, [int(t) - e * n for n, t, e in zip(sizes, goal, epochs)]]
    made = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int64()))]
    return slim.sparkSession.createDataFrame(pa.table(made, names=shape.names), shape), len(sizes)


def _cuts(slim: DataFrame, budgets: DataFrame, send, p: MixParams) -> DataFrame:
    """(src, cut, start, n): the key, id and size that a source's rest ends in, words before it, rows alike."""
    unit, bits = F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), p.range_bits

    def narrowed(groups: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
        """The group in which each source's rest ends; found: what comes before all of its groups."""
        w = Window.partitionBy("src").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
        x = groups.withColumnRenamed("source", "src").withColumn("words_before", F.coalesce(F.sum("words").over(w), F.lit(0)))
        x = x.withColumnRenamed("src", "s").join(send(found.select("src", "rest", "start")), F.col("s").eqNullSafe(F.col("src")))
        start = F.col("start") + F.col("words_before")
        return x.withColumn("start", start).where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("words"))).drop("s")

    found = budgets.select("src", "rest", F.lit(0).cast("long").alias("start"))
    inside = slim.withColumn("at", F.shiftright(unit, 32 - bits))
    first = narrowed(inside.groupBy("source", "at").agg(F.sum("size").alias("words")), ["at"], found)
    picked = send(first.select(F.col("src").alias("s1"), F.col("at").alias("at1")))
    inside = slim.join(picked, F.col("source").eqNullSafe(F.col("s1")) & (F.shiftright(unit, 32 - bits) == F.col("at1"))).withColumn("at", F.shiftright(unit, 32 - 2 * bits))
    second = narrowed(inside.groupBy("source", "at").agg(F.sum("size").alias("words")), ["at"], first)
    picked = send(second.select(F.col("src").alias("s1"), F.col("at").alias("at1")))
    inside = slim.join(picked, F.col("source").eqNullSafe(F.col("s1")) & (F.shiftright(unit, 32 - 2 * bits) == F.col("at1")))
    alike = inside.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    last = narrowed(alike, ["key", "doc_id", "size"], second)
    return last.select(F.col("src").alias("cut_src"), F.struct("key", "doc_id", "size").alias("cut"), "start", "n")


def _counted_off(tied: DataFrame, by: list[str]) -> DataFrame:
    """``tied`` with ``turn``: the place of a row among those of its source, in the order of ``by``.

    The rows are sorted over many tasks and written; a row's place follows from its place in its
    file and the numbers of rows in the files before.
    """
    rows = materialize(tied.withColumn("mid", F.monotonically_increasing_id()).orderBy("source", *by, "mid").drop("mid"), "tied")
    rows = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = rows.groupBy(F.col("source").alias("s"), F.col("file").alias("f")).agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    before = F.sum("rows").over(Window.partitionBy("s").orderBy("f").rowsBetween(Window.unboundedPreceding, -1))
    files = files.withColumn("offset", F.coalesce(before, F.lit(0)) - F.col("first"))
    met = rows.join(files, F.col("source").eqNullSafe(F.col("s")) & (F.col("file") == F.col("f")))
    return met.withColumn("turn", F.col("offset") + F.col("row")).drop("s", "f", "rows", "first", "offset", "file", "row")


def _planned(docs: DataFrame, p: MixParams, texts: bool = False) -> DataFrame:
    """The rows of ``docs`` with the digest columns, ``epochs`` (whole ones), and the text as ``body``."""
    slim = materialize(_sized(docs), "sizes")
    budgets, n = _budgets(slim, p)
    send = F.broadcast if n <= p.most_sent else lambda x: x
    cuts = _cuts(slim, budgets, send, p)
    plan = materialize(budgets.join(cuts, F.col("src").eqNullSafe(F.col("cut_src")), "left").drop("cut_src"), "plan")
    rows = _sized(docs, F.col("text").alias("body")) if texts else slim
    rows = rows.join(send(plan), F.col("source").eqNullSafe(F.col("src")), "left")
    own, size, rest = F.struct("key", "doc_id", "size"), F.col("size"), F.col("rest") - F.col("start")

    def taken(more: Column) -> Column:
        return (F.col("epochs") * size + F.coalesce(more, F.lit(0))).cast("long").alias("taken")

    out = ["doc_id", "size", "source_size", "target", "source", "epochs", *(["body"] if texts else [])]
    among = F.coalesce(own.eqNullSafe(F.col("cut")) & (F.col("n") > 1), F.lit(False))
    apart = plan.where("n > 1").isEmpty()  # no cut falls among rows alike
    more = F.when(own < F.col("cut"), size).when(own.eqNullSafe(F.col("cut")), F.least(rest, size))
    done = (rows if apart else rows.where(~among)).select(*out, taken(more))
    if not apart:
        tied = rows.where(among).select("source", "doc_id", "size", "source_size", "target", "epochs", "rest", "start", *(["body"] if texts else []))
        turn = _counted_off(tied, ["body"] if texts else [])
        done = done.unionByName(turn.select(*out, taken(F.greatest(F.lit(0), F.least(rest - F.col("turn") * size, size)))))
    return done


def mix(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """``docs(doc_id, source, text, ...)`` with size, source_size, target and taken (in words).

    Reading the text once, a slim table of sizes decides; the result carries the slim columns only.
    """
    return _planned(docs, p).select(*DIGEST)


def with_mixture(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The rows of ``mix`` with ``mixture``: (epoch, text) of each time that the document is taken, none if it is not.

    The texts are read twice and stay in their tasks.
    """
    x = _planned(docs, p, True).withColumn("last", F.when(F.col("size") > 0, F.col("taken") - F.col("epochs") * F.col("size")).otherwise(F.lit(0)))
    one = lambda epoch, text: F.struct(epoch.cast("int").alias("epoch"), text.alias("text"))
    text = F.col("body")
    whole = F.when((F.col("size") > 0) & (F.col("epochs") > 0), F.transform(F.sequence(F.lit(1), F.greatest("epochs", F.lit(1))), lambda e: one(e, text)))
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.when(F.col("last") == F.col("size"), text).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("last").cast("int")), ""))
    more = F.when(F.col("last") > 0, F.array(one(F.col("epochs") + 1, cut)))
    none = F.array().cast("array<struct<epoch:int,text:string>>")
    return x.select(*DIGEST, F.concat(F.coalesce(whole, none), F.coalesce(more, none)).alias("mixture"))


def mixture(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """(doc_id, source, epoch, text): what the mix consists of, a row for each time that a document is taken."""
    return with_mixture(docs, p).select("doc_id", "source", F.explode("mixture").alias("m")).select("doc_id", "source", "m.*")


ORACLE = r"""
WITH s AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
             CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s GROUP BY source),
o AS (SELECT *, sum(2 * source_size) OVER r - 2 * source_size AS capped, sum(w) OVER () - sum(w) OVER r + w AS free_w,
        sum(source_size) OVER () * 3 / 2.0 AS total FROM t
      WINDOW r AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT min(CAST(total - capped AS DOUBLE) / free_w) FILTER (WHERE (total - capped) * w <= 2 * source_size * free_w) AS level,
        arg_min(total - capped, 2.0 * source_size / w) FILTER (WHERE (total - capped) * w <= 2 * source_size * free_w) AS rest,
        arg_min(free_w, 2.0 * source_size / w) FILTER (WHERE (total - capped) * w <= 2 * source_size * free_w) AS fw FROM o),
g AS (SELECT source, source_size, CASE WHEN rest * w >= 2 * source_size * fw THEN CAST(2 * source_size AS DOUBLE)
        ELSE CAST(rest * w AS DOUBLE) / CAST(fw AS DOUBLE) END AS target FROM t, l),
p AS (SELECT s.doc_id, s.size, g.source_size, g.target, s.source, CAST(floor(g.target) AS BIGINT) AS budget,
        CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - s.size AS BIGINT) AS start
      FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, source, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
  + greatest(0, least(budget - (budget // source_size) * source_size - start, size)) END AS BIGINT) AS taken FROM p
"""

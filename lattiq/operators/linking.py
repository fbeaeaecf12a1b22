"""Dictionary matching, entity linking and pluggable model boundaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_AUTOMATON = 2_000_000  # characters of names that one automaton may hold on a task


def match_dictionary(docs: DataFrame, names: DataFrame, least: int = 4, most: int = MAX_AUTOMATON) -> DataFrame:
    """(doc_id, name, code, start) of every dictionary name in a text, any case, between characters that are no letters.

    Automata of the names go to the tasks. A dictionary of over ``most`` characters is cut into blocks by a
    hash of the name, each a pass over the documents: names are found one by one, overlapping or not, so the
    passes together give what one would. Of equal names the last code in order wins; shorter names are left
    out; rows with equal or null ids are searched each for itself."""
    rows = names.where(F.length("name") >= least).groupBy(F.lower("name").alias("name")).agg(F.max("code").alias("code"))
    blocks = -(-(rows.agg(F.sum(F.length("name")).alias("n")).first().n or 0) // most) or 1
    low = docs.select("doc_id", F.lower("text").alias("text"))
    shape = T.StructType([docs.schema["doc_id"], T.StructField("name", T.StringType()), names.schema["code"], T.StructField("start", T.LongType())])
    out = None
    for b in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b)
        part = low.mapInArrow(_matcher(docs, own.toArrow()), shape)
        out = part if out is None else out.unionByName(part)
    return out


def _matcher(docs: DataFrame, table: pa.Table):
    held = docs.sparkSession.sparkContext.broadcast(table.combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, codes = held.value.column("name").to_pylist(), held.value.column("code").combine_chunks()
        find = automaton(tuple(names))
        for batch in batches:
            doc, name, at = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for start, k in find(text) if text else ():
                    doc.append(i), name.append(k), at.append(start)
            which = pa.array(name, pa.int64())
            columns = [batch.column(0).take(pa.array(doc, pa.int64())), pa.array([names[k] for k in name], pa.string()), codes.take(which) if len(names) else codes, pa.array(at, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "name", "code", "start"])

    return run


@lru_cache(maxsize=1)
def automaton(words: tuple[str, ...]) -> Callable[[str], Iterator[tuple[int, int]]]:
    """Finder of (start, number of the word) for all whole-word occurrences."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for k, w in enumerate(words):
        machine.add_word(w, (k, len(w)))
    machine.make_automaton()

    def find(text: str) -> Iterator[tuple[int, int]]:
        last = len(text) - 1
        for i, (k, n) in machine.iter(text) if len(machine) else ():
            a = i - n + 1
            if (a == 0 or not text[a - 1].isalpha()) and (i == last or not text[i + 1].isalpha()):
                yield a, k

    return find


def link_names(mentions: DataFrame, conso: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(mention, cui): exact match on the normalised string of 3 to 80 characters; the first row of conso (str, cui, ord) wins."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\d]+", " "))
    c = conso.where(F.length("str").between(3, 80))
    c = c.join(types.select("cui").distinct(), "cui", "left_semi") if types is not None else c
    index = c.groupBy(key("str").alias("_k")).agg(F.min_by("cui", "ord").alias("cui"))
    return mentions.withColumn("_k", key("mention")).join(index, "_k", "left").drop("_k")


def call_model(rows: DataFrame, prompt: str, model: Callable[[list[str]], list[str]], out: str = "answer") -> DataFrame:
    """``rows`` with a model's answers to the prompt column, batch by batch; the model is any function of a list of texts."""
    from pyspark.sql.types import StringType, StructField, StructType

    shape = StructType([*rows.schema.fields, StructField(out, StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(**{out: model(pdf[prompt].tolist())})

    return rows.mapInPandas(run, shape)


PROMPTS = {
    "list": "List the findings in the text as a JSON array.\n{text}",
    "grounded": "Give findings with place, severity, onset and the words that say so, as JSON.\n{text}",
    "categorised": "List findings with their category as JSON.\n{text}",
    "history": "List findings of the patient's history as a JSON array.\n{text}",
    "score": "How likely is {name} given: {text}? Answer 0 to 100.",
}


def build_prompts(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` with the prompt: the template's {columns} filled in."""
    out = F.lit(PROMPTS[kind])
    for c in rows.columns:
        out = F.replace(out, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return rows.withColumn("prompt", out)


def vote(answers: DataFrame) -> DataFrame:
    """(case, pick, n, votes) from (case, pick): the commonest pick, the smallest of equals."""
    n = answers.groupBy("case", "pick").agg(F.count("*").alias("n"))
    return n.groupBy("case").agg(F.min_by("pick", F.struct((-F.col("n")).alias("n"), F.col("pick"))).alias("pick"), F.max("n").alias("n"), F.sum("n").alias("votes"))


def tournament(duels: DataFrame) -> DataFrame:
    """(case, x, wins) from pairwise results (case, a, b, winner)."""
    every = duels.select("case", F.explode(F.array("a", "b")).alias("x"), "winner")
    return every.groupBy("case", "x").agg(F.count_if(F.col("x") == F.col("winner")).alias("wins"))


def yes_probability(yes, no):
    """Softmax of the two answers' log probabilities."""
    return 1 / (1 + F.exp(no - yes))


def audit_record(ranking: DataFrame, evidence: DataFrame) -> DataFrame:
    """(case, record): JSON of the ranked diseases (case, d, rank, score) with their evidence (case, d, p, source)."""
    e = evidence.groupBy("case", "d").agg(F.array_sort(F.collect_list(F.struct("p", "source"))).alias("evidence"))
    x = ranking.join(e, ["case", "d"], "left").groupBy("case").agg(F.array_sort(F.collect_list(F.struct("rank", "d", "score", "evidence"))).alias("diagnoses"))
    return x.select("case", F.to_json(F.struct("case", "diagnoses")).alias("record"))

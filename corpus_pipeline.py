"""The corpus pipeline: toxicity, quality, near-dedup, decontamination, mixing.

Each stage takes what its predecessor kept; all but the last return the columns of ``documents``.
The last one keeps a row for each document; its ``mixture`` holds the texts that the mix takes, none where it takes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattiq.llm import decontam, mixing, quality, simhash, toxicity
from lattiq.llm.common import apart, bound_batches
from lattiq.llm.queries import table
from lattiq.shared import materialize

READ = ("doc_id", "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return apart(docs, READ, lambda x: toxicity.score(x, model).where("NOT toxic"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(quality.with_statistics(quality.labelled(docs.select(*READ), labels)), labels)
    return apart(docs, READ, lambda x: quality.score(x, model).where("predicted = 1"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return apart(docs, READ, lambda x: decontam.judge(x, table(spark, sf_dir, "benchmark")).where("NOT contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: its size, its source's size and target, the words the mix takes, and their texts by epoch."""
    return mixing.with_mixture(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", mix_sources),
]

#: Learned stages and connected components have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i}")
    return docs



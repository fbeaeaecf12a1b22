"""The pipeline's Arrow batches are bounded in bytes, so that an executor's memory does not grow with the texts."""

import os
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from lattiq.llm.common import BATCH_BYTES, append_columns

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("own", [None, 1 << 20])
def test_a_stage_takes_no_more_than_a_bound_of_bytes_at_once(spark, tmp_path, monkeypatch, own):
    seen = str(tmp_path)

    def run(column):
        with open(os.path.join(seen, uuid.uuid4().hex), "w") as f:
            f.write(f"{len(column)} {column.nbytes}")
        return [pa.array([False] * len(column))]

    monkeypatch.setattr(corpus_pipeline.toxicity, "fit", lambda docs, labels: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "score", lambda docs, model: append_columns(docs, "text", run, [T.StructField("toxic", T.BooleanType())]))
    before = spark.conf.get(KEY, None)
    if own:
        spark.conf.set(KEY, str(own))
    else:
        spark.conf.unset(KEY)
    try:
        docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 10_000).alias("text"))
        assert corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.001").count() == 3000
    finally:
        spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)
    rows, size = zip(*[map(int, p.read_text().split()) for p in tmp_path.iterdir()])
    assert sum(rows) == 3000 and sum(size) >= 30_000_000 and max(size) <= (own or BATCH_BYTES) + 20_000

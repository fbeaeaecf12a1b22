"""Sinks and stores: graph snapshots, resumable appends, annotation tasks, archives."""

from __future__ import annotations

import gzip
import io
import os
import shutil
import sqlite3
import tempfile
import urllib.parse
import zipfile
from collections.abc import Iterator
from contextlib import closing, contextmanager
from itertools import islice

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lattiq.operators.linking import match_dictionary


def write_graph(edges: DataFrame, path: str) -> dict[str, int]:
    """Node and edge tables of (d, p, ...); the counts read back verify the load."""
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    spark = edges.sparkSession
    e = spark.read.parquet(f"{path}/edges")
    nodes = e.select(F.col("d").cast("string").alias("id"), F.lit("disease").alias("kind")).union(e.select(F.col("p").cast("string"), F.lit("finding"))).distinct()
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    return {r.kind: r["count"] for r in spark.read.parquet(f"{path}/nodes").groupBy("kind").count().collect()} | {"edges": e.count()}


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def append_new(new: DataFrame, path: str, keys: list[str]) -> int:
    """Append rows whose key the table at ``path`` lacks; running it again adds nothing. Returns the number added."""
    spark = new.sparkSession
    try:
        old = spark.read.parquet(path)
        fresh = new.join(old.select(*keys).distinct(), keys, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = new
    from lattiq.shared import materialize

    fresh = materialize(fresh.dropDuplicates(keys), "fresh")
    fresh.write.mode("append").parquet(path)
    return fresh.count()


def annotation_tasks(items: DataFrame) -> DataFrame:
    """One JSON task a row of items (id, text, labels array<struct<start,stop,label>>)."""
    result = F.transform("labels", lambda x: F.struct(F.struct(x["start"].alias("start"), x["stop"].alias("end"), F.array(x["label"]).alias("labels")).alias("value"), F.lit("labels").alias("type")))
    return items.select(F.to_json(F.struct("id", F.struct(F.col("text").alias("text")).alias("data"), F.array(F.struct(result.alias("result"))).alias("predictions"))).alias("value"))


def read_tasks(tasks: DataFrame) -> DataFrame:
    """Back to (id, text, labels) from the JSON tasks."""
    shape = "id bigint, data struct<text:string>, predictions array<struct<result:array<struct<value:struct<start:bigint,end:bigint,labels:array<string>>>>>>"
    x = tasks.select(F.from_json("value", shape).alias("t")).select("t.id", F.col("t.data.text").alias("text"), F.col("t.predictions")[0]["result"].alias("r"))
    return x.select("id", "text", F.transform("r", lambda v: F.struct(v["value"]["start"].alias("start"), v["value"]["end"].alias("stop"), v["value"]["labels"][0].alias("label"))).alias("labels"))


def archive_lines(spark: SparkSession, path: str, suffix: str, sab_column: int, sabs: list[str]) -> DataFrame:
    """(file, line) of pipe-delimited members of zip archives whose name ends in ``suffix``, gzipped or not,
    with a source among ``sabs``. An archive is one task (and one value, so under 2 GB); members are read line by
    line and given out in batches."""
    keep = set(sabs)

    def lines(zf: zipfile.ZipFile, name: str) -> Iterator[str]:
        with zf.open(name) as raw:
            src = gzip.open(raw) if name.endswith(".gz") else raw
            for line in io.TextIOWrapper(src, "utf-8"):
                f = line.rstrip("\n").split("|")
                if len(f) > sab_column and f[sab_column] in keep:
                    yield line.rstrip("\n")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf.content:
                with zipfile.ZipFile(io.BytesIO(content)) as zf:
                    for name in zf.namelist():
                        if name.endswith((suffix, suffix + ".gz")):
                            rest = lines(zf, name)
                            while found := list(islice(rest, 10_000)):
                                yield pd.DataFrame({"file": [name] * len(found), "line": found})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "file string, line string")


def keyword_sample(articles: DataFrame, words: list[str], n: int, seed: int = 42) -> DataFrame:
    """At most n articles (pmid, text, mesh) that hold a word, drawn by a hash of the pmid."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower("text").contains(w.lower()) | F.array_contains("mesh", w)
    return articles.where(hit).orderBy(F.md5(F.concat_ws(":", "pmid", F.lit(str(seed)))), "pmid").limit(n)


class RowStore(DataSource):
    """``spark.read.format("row_store").schema(...)``: a table of a SQLite file by ranges of its row numbers.

    Options ``path`` (any path that Spark's file systems or pyarrow know), ``table``, ``partitions``. Columns are
    those of the schema. A file on a mounted path is opened in place, read only; another is copied by each task."""

    @classmethod
    def name(cls) -> str:
        return "row_store"

    def reader(self, schema) -> DataSourceReader:
        return RowReader(self.options, schema.fieldNames())


class RowReader(DataSourceReader):
    def __init__(self, options, columns: list[str]) -> None:
        self.path, self.table, self.parts, self.columns = options["path"], _quoted(options["table"]), int(options.get("partitions", "16")), columns

    def partitions(self) -> list[InputPartition]:
        with _opened(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        if low is None:
            return [InputPartition((0, 0))]
        cuts = sorted({low + (high + 1 - low) * i // self.parts for i in range(self.parts + 1)})
        return [InputPartition(c) for c in zip(cuts, cuts[1:])]

    def read(self, partition: InputPartition):
        with _opened(self.path) as db:
            yield from db.execute(f"SELECT {', '.join(map(_quoted, self.columns))} FROM {self.table} WHERE rowid >= ? AND rowid < ?", partition.value)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@contextmanager
def _opened(path: str):
    fs, inside = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{urllib.parse.quote(os.path.abspath(path))}")
    with tempfile.TemporaryDirectory() as own:
        if fs.type_name != "local":
            with fs.open_input_stream(inside) as source, open(f"{own}/db", "wb") as copy:
                shutil.copyfileobj(source, copy)
            inside = f"{own}/db"
        with closing(sqlite3.connect(f"file:{urllib.parse.quote(inside)}?mode=ro&immutable=1", uri=True)) as db:
            yield db


def select_abstracts(store: DataFrame, headings: DataFrame, words: DataFrame, n: int, least: int = 200, seed: int = 42) -> DataFrame:
    """(d, pmid, text, stage): at most n abstracts of over ``least`` characters for each disease, of store (pmid, title, text, mesh array).

    Those under a heading (d, mesh) come first, then those whose title or text has a word (d, word) in any case, as a
    whole word; in a stage a hash of the pmid draws. Words are found by one pass of an automaton over the store."""
    x = store.where(F.length("text") > least)
    headed = x.select("pmid", F.explode("mesh").alias("mesh")).join(headings.select("d", "mesh").distinct(), "mesh").select("d", "pmid", F.lit(0).alias("stage"))
    w = words.select("d", F.lower("word").alias("name")).distinct()
    both = x.select(F.col("pmid").alias("doc_id"), F.concat_ws("\n", "title", "text").alias("text"))
    hits = match_dictionary(both, w.select("name", F.col("name").alias("code"))).select(F.col("doc_id").alias("pmid"), "name").distinct()
    found = headed.unionByName(hits.join(w, "name").select("d", "pmid", F.lit(1).alias("stage"))).groupBy("d", "pmid").agg(F.min("stage").alias("stage"))
    draw = F.md5(F.concat_ws(":", F.col("pmid").cast("string"), F.lit(str(seed))))
    kept = found.withColumn("_r", F.row_number().over(Window.partitionBy("d").orderBy("stage", draw, "pmid"))).where(F.col("_r") <= n).drop("_r")
    return x.select("pmid", "text").join(kept, "pmid").select("d", "pmid", "text", "stage")

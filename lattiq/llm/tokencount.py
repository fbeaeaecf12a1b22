"""Token counts of documents in flat, unindexed token files.

A token file is nothing but little-endian unsigned ids, documents ended by the end-of-document id.
Blocks of a file are scanned for that id with vectorised comparisons; each block gives the places of
its separators. A prefix scan over the blocks' summaries (number of separators, place of the last one)
numbers the documents and tells where the one that is open at a block's begin began, so documents are
stitched across block boundaries. The scan has two levels, inside groups of ``group`` blocks and over
the groups, so that one very large file is no single task; the lists of places take no part in it.

Edge cases: an empty document is two separators in a row and counts 0; tokens after the last
separator are one more, unended, document; an empty file holds no document; null texts are empty; a
very long text may lie in many blocks; rows with equal or null ids are counted each for itself; an empty
table writes and gives nothing; columns other than doc_id and text are not read, so names cannot clash.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.shared import fresh_path, materialize


@dataclass(frozen=True)
class TokenFileParams:
    eod: int = 50256
    width: int = 2  # bytes of an id
    block_tokens: int = 1 << 21
    group: int = 4096  # blocks whose summaries one task scans


@lru_cache(maxsize=2)
def load_encoding(vocabulary: str):
    """The byte-pair encoding of a ``.tiktoken`` rank file."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, path: str, vocabulary: str, p: TokenFileParams = TokenFileParams()) -> DataFrame:
    """Tokenise ``docs(doc_id, text)`` into flat files below ``path``; (doc_id, file, doc_ord) of every row.

    An attempt of a task writes a file of its own, which its rows name. The rows are a written table,
    to which committed attempts alone add, so a lost executor or a second attempt leaves at most a
    file that no row names. Ids at or beyond ``eod`` raise.
    """
    at_once, inside = pafs.FileSystem.from_uri(path)
    at_once.create_dir(inside, recursive=True)
    shape = T.StructType([docs.schema["doc_id"], T.StructField("file", T.StringType()), T.StructField("doc_ord", T.LongType())])
    kind, ended = f"<u{p.width}", p.eod.to_bytes(p.width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, name, seen = load_encoding(vocabulary), uuid.uuid4().hex, 0
        fs, inner = pafs.FileSystem.from_uri(path)
        with fs.open_output_stream(f"{inner}/{name}") as out:
            for batch in batches:
                for text in batch.column(1).to_pylist():
                    ids = np.array(encoding.encode_ordinary(text or ""), np.uint32)
                    if len(ids) and ids.max() >= min(p.eod, 1 << 8 * p.width):
                        raise ValueError("a token id meets the separator or does not fit")
                    out.write(ids.astype(kind).tobytes() + ended)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * n, pa.string()), pa.array(np.arange(seen, seen + n), pa.int64())], names=["doc_id", "file", "doc_ord"])
                seen += n

    return materialize(docs.select("doc_id", "text").mapInArrow(run, shape), "written")


def _read_block(path: str, offset: int, length: int) -> bytes:
    fs, inner = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(inner) as f:
        return f.read_at(length, offset)


def token_counts(spark: SparkSession, path: str, p: TokenFileParams = TokenFileParams()) -> DataFrame:
    """(path, doc_ord, n_tokens, start) of each document, start in tokens from the file's begin."""
    size = p.block_tokens * p.width
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size)))
    blocks = files.select("path", "length", number.alias("block")).repartition(F.col("path"), F.col("block"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = _read_block(name, block * size, min(size, length - block * size))
                at = np.flatnonzero(np.frombuffer(raw[: len(raw) // p.width * p.width], f"<u{p.width}") == p.eod) + block * p.block_tokens
                row = [[name], [block], [length // p.width], [len(at)], [int(at[-1]) if len(at) else None]]
                types = [pa.string(), *[pa.int64()] * 4]
                places = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(row, types)], places], names=["path", "block", "total", "seps", "last", "at"])

    scanned = materialize(blocks.mapInArrow(scan, "path string, block long, total long, seps long, last long, at array<long>"), "blocks")
    slim = scanned.select("path", "block", "seps", "last").withColumn("group", F.floor(F.col("block") / p.group))

    def before(w) -> dict:
        """Separators before, and the place of the last one before, in the order of a window."""
        w = w.rowsBetween(Window.unboundedPreceding, -1)
        return {"ended": F.coalesce(F.sum("seps").over(w), F.lit(0)), "open": F.max("last").over(w)}

    groups = slim.groupBy("path", "group").agg(F.sum("seps").alias("seps"), F.max("last").alias("last"))
    groups = groups.select("path", "group", *[c.alias(f"g_{n}") for n, c in before(Window.partitionBy("path").orderBy("group")).items()])
    inside = slim.select("path", "group", "block", *[c.alias(n) for n, c in before(Window.partitionBy("path", "group").orderBy("block")).items()])
    placed = inside.hint("merge").join(groups, ["path", "group"])
    placed = placed.select("path", "block", (F.col("ended") + F.col("g_ended")).alias("ended"), (F.coalesce("open", "g_open", F.lit(-1)) + 1).alias("first"))
    x = scanned.hint("merge").join(placed, ["path", "block"])  # first: where the document open at the block's begin began
    starts = F.concat(F.array("first"), F.transform("at", lambda i: i + 1))
    final = (F.col("block") + 1) * p.block_tokens >= F.col("total")
    unended = F.when(final & (F.element_at(starts, -1) < F.col("total")), F.array("total")).otherwise(F.array().cast("array<long>"))
    pairs = F.arrays_zip(starts.alias("start"), F.concat("at", unended).alias("stop"))
    rows = x.select("path", "ended", F.posexplode(pairs).alias("i", "doc")).where("doc.stop IS NOT NULL")
    return rows.select("path", (F.col("ended") + F.col("i")).alias("doc_ord"), (F.col("doc.stop") - F.col("doc.start")).alias("n_tokens"), F.col("doc.start").alias("start"))


def named_counts(written: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) of the rows that ``write_token_files`` gave, from the scan of its files.

    Files that no row names do not count; a row whose document the scan has not found raises.
    """
    found = counts.select(F.element_at(F.split("path", "/"), -1).alias("file"), "doc_ord", "n_tokens")
    met = written.join(found.hint("merge"), ["file", "doc_ord"], "left")  # neither side has a bound
    wrong = F.raise_error(F.lit("a token file lacks a document"))
    return met.select("doc_id", F.when(F.col("n_tokens").isNull(), wrong.cast("long")).otherwise(F.col("n_tokens")).alias("n_tokens"))


def count_documents(docs: DataFrame, vocabulary: str, p: TokenFileParams = TokenFileParams()) -> DataFrame:
    """(doc_id, n_tokens) of every row: write token files, scan them, and name what the scan finds."""
    path = fresh_path(docs.sparkSession, "tokens")
    written = write_token_files(docs, path, vocabulary, p)
    return named_counts(written, token_counts(docs.sparkSession, path, p))

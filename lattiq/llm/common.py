"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.shared import materialize


#: Bytes of an Arrow batch in the pipeline. An executor holds several copies of a task's batch outside its heap: Spark's by
#: row count alone are 20 MB at 2 KB a text, and their vectors grow by doubling.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let the session's Arrow batches end at ``most`` bytes (and the row begun), unless it has a bound of its own.

    A plan takes the bound as it runs, so the setting stays. Results do not depend on it."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def append_columns(df: DataFrame, column: str, fn: Callable[[pa.Array], list], fields: list[T.StructField], also: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns that ``fn`` makes from Arrow batches of ``column`` (and ``also``).

    An input column whose name equals a new one, whatever the case, is replaced. No shuffle: a row
    keeps its task, so rows with equal or null ids need no join to find their result.
    """
    new = {f.name.lower() for f in fields}
    need = [column, *also]
    if any(c.lower() in new for c in need):
        raise ValueError(f"{need} cannot be replaced by an output column")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new])
    at = [df.columns.index(c) for c in need]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(*[batch.column(i) for i in at])
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *[f.name for f in fields]])

    return df.mapInArrow(run, T.StructType([*[T.StructField(f.name, f.dataType, True) for f in df.schema.fields], *fields]))


def apart(df: DataFrame, needed: tuple[str, ...], fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fn`` of ``df``, reduced to the columns of ``df`` as they were.

    While ``fn`` runs, all columns but the needed ones have names that no operator gives or uses, so
    columns of any name and type come through untouched.
    """
    inner = df.toDF(*[c if c in needed else f"c{i}" for i, c in enumerate(df.columns)])
    return fn(inner).select(*inner.columns).toDF(*df.columns)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


#: Edges up to which one task joins them; 16-byte keys of so many take about 100 MB.
ONE_TASK_EDGES = 200_000


def _find(up: dict, x):
    while (p := up.setdefault(x, x)) != x:
        up[x] = x = up[p]
    return x


def _join(up: dict, batch: pa.RecordBatch) -> None:
    for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        x, y = _find(up, a), _find(up, b)
        if x != y:
            up[max(x, y)] = min(x, y)


def _stars(up: dict, types: list[pa.DataType], names: list[str], whole: bool) -> pa.RecordBatch:
    """(node, root) of a forest; whole: of the roots too."""
    nodes = [x for x in up if whole or _find(up, x) != x]
    return pa.RecordBatch.from_arrays([pa.array(nodes, types[0]), pa.array([_find(up, x) for x in nodes], types[1])], names=names)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a batch of edges by a star forest with the same components."""
    for batch in batches:
        up: dict = {}
        _join(up, batch)
        yield _stars(up, batch.schema.types, ["a", "b"], False)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all nodes of all batches of a task."""
    up: dict = {}
    types = None
    for batch in batches:
        types = batch.schema.types
        _join(up, batch)
    if types is not None:
        yield _stars(up, types, ["node", "root"], True)


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; nodes of a component share their root.

    Random-priority contraction: each round maps every node to the member of its closed
    neighbourhood with the smallest hash (a new hash each round, so that long chains also shrink
    by a constant factor), and the edges between different images go on. The number of rounds
    grows with the logarithm of the largest component. Aggregates combine before they shuffle, so
    a node with very many edges is no hot spot; each round is a table in the shared folder. As soon
    as at most ``one_task`` edges are left, one task joins them; the components are the same.
    Earlier images are mapped on to the last round's from the back, each map a written table.
    """
    kind = edges.schema[0].dataType
    shape = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    named = T.StructType([T.StructField("node", kind), T.StructField("root", kind)])
    left = edges.toDF("a", "b").where("a <> b").mapInArrow(_forest, shape)
    rounds: list[DataFrame] = []
    while True:
        left = materialize(left.where("a <> b").distinct(), "edges")
        n = left.count()
        if n <= one_task:
            rounds.append(materialize(left.coalesce(1).mapInArrow(_finish, named), "images"))
            break
        rank = lambda c, n=len(rounds): F.struct(F.xxhash64(F.col(c), F.lit(n)).alias("h"), F.col(c).alias("x"))
        both = left.select("a", "b").union(left.select("b", "a")).toDF("node", "other")
        near = both.groupBy("node").agg(F.min(rank("other")).alias("m"))
        step = materialize(near.select("node", F.least(rank("node"), F.col("m"))["x"].alias("root")), "images")
        rounds.append(step)
        left = left.join(step.toDF("a", "ra"), "a").join(step.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    found = rounds.pop()
    while rounds:
        met = rounds.pop().join(found.toDF("root", "next"), "root", "left")
        found = met.select("node", F.coalesce("next", "root").alias("root"))
        if rounds:
            found = materialize(found, "images")
    return found

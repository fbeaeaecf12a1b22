"""Folders that the driver and all executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting (as in tests) gets a folder of its own; on a
    cluster a missing setting is an error, since executors do not see the driver's disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(spark.sparkContext, "_lattiq_shared", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="lattiq-")
        spark.sparkContext._lattiq_shared = own
    return "file://" + own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lattiq/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage, survives lost executors, and gives later joins true sizes.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Intermediate results kept in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where the session names none,
    a temporary one is used in local mode only (tests); on a cluster that is
    an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and checkpointed in the shared folder: several
    readers share it and see the same rows, and a lost executor costs
    nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder, partitioned by
    the columns ``by``, so that readers of one partition read no other."""
    path = new_folder(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

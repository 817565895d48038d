"""Cutting the lineage of results that are read more than once."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def _ensure_folder(spark: SparkSession) -> None:
    """Settle the checkpoint folder: the one the session names; a temporary one in a single-process session only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        # local-cluster[...] runs executors apart, so it needs a shared folder like any cluster.
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="bedside-checkpoint-")
    context.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there.

    A result that several branches read would otherwise be planned and computed once per branch, and
    branches of branches multiply. The written rows outlive lost executors.
    """
    _ensure_folder(df.sparkSession)
    return df.checkpoint()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder, for tables that are written and read back."""
    _ensure_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"


def written(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Like ``cut``, but as Parquet: later reads prune columns, push filters down and know the size.

    With ``partition_by``, filters on those columns choose the files that are read.
    """
    path = scratch_folder(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    columns = [c for c in df.columns if c not in partition_by] + list(partition_by)
    return df.sparkSession.read.schema(df.select(*columns).schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files behind a table that ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    top = re.sub(r"^file:/*", "file:///", spark.sparkContext.getCheckpointDir()) + "/"
    names = {f.removeprefix(top).split("/")[0] for f in df.inputFiles() if f.startswith(top)}
    for name in names:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top + name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete all that this session has cut or written to its scratch folder; results that still read from it are lost."""
    top = spark.sparkContext.getCheckpointDir()
    if top is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)

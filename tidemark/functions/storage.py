"""Shared storage for cutting lineage: always the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session that names none gets one of its own (tests); on a cluster that
    would be a machine's own folder, so it is an error there."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if named:
        if held.isEmpty():
            context.setCheckpointDir(named)
        return named
    if held.isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder and read from there: lineage ends, and lost executors lose nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _kept(df: DataFrame, *by: str) -> str:
    """Writes `df` as a compressed table, a folder for each value of `by`, and gives its path; it is deleted when the driver ends."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    context = df.sparkSession.sparkContext
    file = context._jvm.org.apache.hadoop.fs.Path(path)
    system = file.getFileSystem(context._jsc.hadoopConfiguration())
    system.deleteOnExit(file)
    return system.makeQualified(file).toString() if by else path


def stored(df: DataFrame) -> DataFrame:
    """Like `cut`, as a compressed table in the same folder: smaller, for what is large. It is deleted when the driver ends."""
    return df.sparkSession.read.schema(df.schema).parquet(_kept(df))


def stored_by(df: DataFrame, column: str) -> str:
    """The path of `df` stored like that, with a folder `column`=value for each value, so that a task can read some of them."""
    path = _kept(df, column)
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path

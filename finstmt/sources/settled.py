"""Stages that later plans start from: written once, read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where all run on this machine."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="finstmt-stages-"))
    return _own[0]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/stage-{name}-{uuid.uuid4().hex}"


#: Bytes and rows of one Arrow batch, so that a Python worker's memory follows neither the number of documents nor their length.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 500


def bounded(df: DataFrame) -> DataFrame:
    """df, in whose session Arrow batches have these bounds; a session that has bounds of its own keeps them."""
    conf = df.sparkSession.conf
    for key, ours, usual in (("maxBytesPerBatch", BATCH_BYTES, 64 << 20), ("maxRecordsPerBatch", BATCH_ROWS, 10_000)):
        if conf.get(f"spark.sql.execution.arrow.{key}", str(usual)).rstrip("b") == str(usual):
            conf.set(f"spark.sql.execution.arrow.{key}", str(ours))
    return df


def large(df: DataFrame) -> DataFrame:
    """df, one side of a join, whose rows follow the input: both sides are sorted and merged. Without this, Spark may go by the
    size of compressed files or shuffles, which tells little of keys, and send millions of rows through the driver."""
    return df.hint("merge")


def settle(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read from there: what follows is planned, and after a loss recomputed, from
    these files alone."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Lineage cuts for rounds that repeat: tables in the folder that the driver and all executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; where that is unset, a new local one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or "file://" + tempfile.mkdtemp(prefix="annulus-")


#: Rows that a table may have to be sent to every task.
FEW = 100_000


def few(df: DataFrame) -> DataFrame:
    """`df` materialised, and broadcast where it is counted to have at most `FEW` rows, so that the large side of a join need not move; else to be joined by key."""
    df = cut(df)
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


#: Rows of a part of `dealt`: a sort of them stays at some hundred MB.
DEALT = 500_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` shuffled by `keys` into as many parts as its rows need at `DEALT` each, so that what a task sorts does not grow with the input.

    Groupings, windows and joins by these keys use the parts as they are. The rows are counted, so `df` should be close to its files.
    """
    return df.repartition(max(1, math.ceil(df.count() / DEALT)), *keys)


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` with checkpoint() in the shared folder, so that plans do not grow with rounds and lost executors cost no round."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` written as compressed Parquet in the shared folder and read again, for tables that many passes read some columns of."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

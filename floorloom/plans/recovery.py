"""Cutting lineage so that lost executors cost a re-read and not a recomputation."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application, which driver and executors share.

    It lies in ``spark.checkpoint.dir``.  Only a session inside one process may name none: it gets a temporary one.  On a cluster that is an error, since
    executors do not see the driver's disk.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def settled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read from there.

    With ``rows`` the result is counted and read in partitions of about so many rows, so that what follows a few rows in many partitions does
    not start as many tasks, each with files of its own.
    """
    shared_folder(df.sparkSession)
    kept = df.checkpoint()
    return kept if rows is None else kept.coalesce(max(1, -(-kept.count() // rows)))


def small(df: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """``df`` marked for broadcast if it was counted and has at most ``rows`` rows; as it is otherwise, to be shuffled.

    For tables of a few numbers a row, which are settled or cheap to make.
    """
    return broadcast(df) if df.count() <= rows else df

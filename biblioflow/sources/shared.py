"""Intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, its lineage cut, so that it survives the loss of executors.

    The folder is spark.checkpoint.dir of the session; only a local session may go without it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="biblioflow-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def released(df: DataFrame) -> None:
    """Have Spark delete the shuffle files that led to checkpoints like `df` and that nothing refers to any more: it does so
    only after the driver collects its garbage, which may be long after the disk is full."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()

"""Cutting lineage through a folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def set_checkpoints(spark: SparkSession) -> None:
    """Use the cluster's shared folder; a folder of our own only where none is configured (local tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(shared)


def saved(df: DataFrame) -> DataFrame:
    """df, computed and written to the shared folder, without its lineage."""
    set_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)

"""Checkpoints in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or on one machine without that setting a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


#: Whether Spark removes the shuffle files of an execution at its end, not only once the driver happens to collect garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder; the shuffle files that it took are removed, as nothing reads them again."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        return df.select("*").checkpoint()  # the setting holds for frames made under it; df itself can still be run with its own shuffles
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)

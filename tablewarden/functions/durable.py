"""Cutting lineage where every executor can read the cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, `spark.checkpoint.dir`. Where the session names none, a temporary one
    is set if driver and executors are one process, as in tests; on a cluster that is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if context.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(rows: DataFrame) -> DataFrame:
    """The rows, computed once and written to the shared folder. Files go when the result is no longer referenced."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def cut_clean(rows: DataFrame) -> DataFrame:
    """The rows, cut; the shuffle files that led to them go at once, not when the driver happens to collect its garbage."""
    spark, key = rows.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return cut(rows.select("*"))  # a plan of its own, which is made under the setting
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)

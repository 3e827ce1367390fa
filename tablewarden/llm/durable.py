"""Cutting lineage where every executor can read the cut."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@contextmanager
def settled(spark: SparkSession, adaptive: bool = True) -> Iterator[None]:
    """Shuffle files of what is both built and run in this context go when it has run, not when the driver happens to
    collect its garbage. Without `adaptive` execution a cut also tells later steps how its rows are dealt."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({} if adaptive else {"spark.sql.adaptive.enabled": "false"})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(rows: DataFrame) -> DataFrame:
    """The rows, computed once and written to the session's checkpoint folder.

    The folder is `spark.checkpoint.dir`. Where the session names none, a temporary one is set if driver
    and executors are one process, as in tests; on a cluster, whose executors could not read it,
    that is an error. Files go when the result is no longer referenced.
    """
    context = rows.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return rows.checkpoint()

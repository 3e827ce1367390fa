"""Last reads from a growing query log.

The same name extraction as the batch operator, applied to new log files only. The state is one
time per distinct name and batch. There is
no watermark: a maximum needs none, and a statement that arrives late still counts.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.usage import foreign_reads, latest_by_name, last_read_by_name

LOG_DDL = "start_time timestamp_ntz, statement_type string, statement_text string"


def read_log(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(LOG_DDL).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start(log: DataFrame, asof: datetime, mentions: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Append the latest time per name of each batch to `target`; restarts resume from `checkpoint`.

    Batches are reduced before they are written. A batch written twice after a failure does
    no harm, because readers take the maximum.
    """
    def write(batch: DataFrame, _: int) -> None:
        latest_by_name(foreign_reads(batch, asof, mentions, later=True)).write.mode("append").parquet(target)

    return (
        log.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current(spark: SparkSession, target: str, tables: DataFrame) -> DataFrame:
    """Last read per table from everything ingested so far."""
    names = spark.read.schema("mentioned_name string, last_read_at timestamp_ntz").parquet(target)
    return last_read_by_name(names.withColumnRenamed("last_read_at", "start_time"), tables)

"""The audit end to end: tables and a query log in, inventory and profile out; in one go, or in batches that
can be resumed."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.durable import cut
from ..functions.moments import moment
from ..functions.text import is_filled
from ..operators import findings, profile as profiling, usage
from ..operators.profile import TABLE_KEY
from ..sources import store
from ..sources.registry import (
    TableSource, columns_frame, file_stats, is_fragmented, metadata_frame, registry_frame, tables_in_scope,
)


@dataclass(frozen=True)
class Scan:
    inventory: DataFrame
    profile: DataFrame

    def health_score(self, keys: tuple[str, ...] = ("table_catalog",)) -> DataFrame:
        return findings.health_score(self.inventory, self.profile, list(keys))

    def findings(self) -> DataFrame:
        columns = self.profile.withColumn("is_pii", F.col("is_pii_candidate"))
        return findings.findings_ranked(findings.table_overview(self.inventory, columns))


def scan(
    spark: SparkSession,
    tables: list[TableSource],
    query_log: DataFrame,
    asof: datetime,
    schema: str | None = None,
    samples: bool = False,
) -> Scan:
    """Audit `tables` as of a moment. Their profile is computed once, here, and kept in the session's shared folder;
    row counts are the profile's.

    The query log (or names already cut out of it) is read apart from the tables, and the audit's own marked
    statements do not count as reads.
    """
    scoped = tables if schema is None else [t for t in tables if t.schema == schema]
    if not scoped:
        return empty(spark)
    in_scope = tables_in_scope(registry_frame(spark, scoped), schema)
    reads = _reads(query_log, asof, scoped)
    columns = (
        columns_frame(spark, scoped)
        .withColumn("has_comment", is_filled(F.col("column_comment")))
        .select(*TABLE_KEY, "column_name", "data_type", "column_comment", "has_comment")
    )
    profiled = (
        profiling.with_pii(profiling.profile_tables(scoped))
        .join(columns, [*TABLE_KEY, "column_name"])
        .join(in_scope.select(*TABLE_KEY), TABLE_KEY, "left_semi")
    )
    with usage.as_own_reads(spark):
        profile = cut(profiled)
    if samples:
        keyed = [profiling.column_samples(t, t.data.columns[0]) for t in scoped]
        profile = profiling.with_stored_samples(profile, profiling.union_all(keyed))
    inventory = (
        usage.with_last_read(in_scope, usage.last_read_by_name(reads, in_scope), asof)
        .join(profile.groupBy(*TABLE_KEY).agg(F.max("row_count").alias("row_count")), TABLE_KEY, "left")
        .join(file_stats(spark, scoped), TABLE_KEY, "left")
        .withColumn("fragmented", is_fragmented(F.col("num_files"), F.col("size_bytes")))
        .withColumn("last_altered", F.coalesce("last_altered", "files_altered"))
        .drop("files_altered")
    )
    return Scan(inventory, profile)


def _reads(query_log: DataFrame, asof: datetime, tables: list[TableSource]) -> DataFrame:
    if "mentioned_name" in query_log.columns:
        return query_log
    return usage.foreign_reads(query_log, asof, sorted({t.catalog for t in tables}))


@dataclass(frozen=True)
class Progress:
    """Where a scan in batches stands: what is staged under `root`, and the tables still to do."""

    root: str
    finished: frozenset[tuple[str, str, str]]
    next_batch: int


BATCH_DDL = "batch int, table_catalog string, table_schema string, table_name string"


def progress(spark: SparkSession, root: str, scan_id: str) -> Progress:
    """Read from the manifest, which names the tables of each batch that was staged as a whole."""
    staged = f"{root}/staged/{scan_id}"
    rows = _manifest(spark, staged).collect() if store.exists(spark, f"{staged}/manifest") else []
    return Progress(staged, frozenset((r.table_catalog, r.table_schema, r.table_name) for r in rows), max((r.batch for r in rows), default=-1) + 1)


def _manifest(spark: SparkSession, staged: str) -> DataFrame:
    return spark.read.schema(BATCH_DDL).parquet(f"{staged}/manifest")


def scan_in_batches(
    spark: SparkSession, tables: list[TableSource], query_log: DataFrame, asof: datetime, root: str, scan_id: str,
    batch_tables: int = 50, at_once: int = 4, schema: str | None = None, samples: bool = False,
) -> Scan:
    """Audit any number of tables: batches of `batch_tables`, `at_once` of them side by side, staged under `root`.

    A plan spans one batch only, and the driver holds the plans of `at_once` batches. A batch counts as done once
    its tables are in the manifest, which is written last; what an unfinished one left is written over or
    never read. Calling it again with the same scan id skips the tables of finished batches. The query log
    is read once. `store_batches` moves a finished scan to the meta tables.
    """
    done = progress(spark, root, scan_id)
    scoped = sorted((t for t in tables if schema is None or t.schema == schema), key=lambda t: (t.catalog, t.schema, t.name))
    left = [t for t in scoped if (t.catalog, t.schema, t.name) not in done.finished]
    if left:
        named = usage.latest_by_name(_reads(query_log, asof, scoped)).withColumnRenamed("last_read_at", "start_time")
        named = cut(named)
        batches = [left[i : i + batch_tables] for i in range(0, len(left), batch_tables)]

        def run(number: int, batch: list[TableSource]) -> None:
            found = scan(spark, batch, named, asof, samples=samples)
            for name, rows in (("table_inventory", found.inventory), ("column_profile", found.profile)):
                rows.write.mode("overwrite").parquet(f"{done.root}/{name}/batch={number}")
            keys = [(number, t.catalog, t.schema, t.name) for t in batch]
            spark.createDataFrame(keys, BATCH_DDL).drop("batch").write.mode("overwrite").parquet(f"{done.root}/manifest/batch={number}")

        with ThreadPoolExecutor(at_once) as pool:
            for finished in [pool.submit(run, done.next_batch + i, batch) for i, batch in enumerate(batches)]:
                finished.result()
    return staged_scan(spark, root, scan_id)


def staged_scan(spark: SparkSession, root: str, scan_id: str) -> Scan:
    """The batches of a scan that are staged as a whole, as one scan."""
    staged = f"{root}/staged/{scan_id}"
    if not store.exists(spark, f"{staged}/manifest"):
        return empty(spark)
    finished = _manifest(spark, staged).select("batch").distinct()
    frames = []
    for table in ("table_inventory", "column_profile"):
        kinds = T.StructType([f for f in store.schema_of(table).fields if f.name not in ("scan_id", "scanned_at")])
        rows = spark.read.schema(kinds.add("batch", T.IntegerType())).parquet(f"{staged}/{table}")
        frames.append(rows.join(finished, "batch", "left_semi").drop("batch"))
    return Scan(*frames)


def empty(spark: SparkSession) -> Scan:
    """The scan of a catalog without tables."""
    frames = {}
    for table in ("table_inventory", "column_profile"):
        kept = [f for f in store.schema_of(table).fields if f.name not in ("scan_id", "scanned_at")]
        frames[table] = spark.createDataFrame([], T.StructType(kept))
    return Scan(frames["table_inventory"], frames["column_profile"])


def save(found: Scan, root: str, scan_id: str, catalog: str, started_at: datetime, finished_at: datetime) -> None:
    """Append a scan to the meta tables under `root`, which need not be in the audited lake."""
    stamp = {"scan_id": F.lit(scan_id), "scanned_at": moment(started_at)}
    store.append(found.inventory.withColumns(stamp), root, "table_inventory")
    store.append(found.profile.withColumns(stamp), root, "column_profile")
    run = metadata_frame(
        found.inventory.sparkSession, [(scan_id, started_at, finished_at, catalog)], store.SCHEMAS["scan_runs"]
    )
    store.append(run, root, "scan_runs")


def load(spark: SparkSession, root: str, scan_id: str) -> Scan:
    """A stored scan; the run key prunes to its partition."""
    return Scan(
        store.read(spark, root, "table_inventory", scan_id),
        store.read(spark, root, "column_profile", scan_id),
    )

"""Which tables exist, what columns they have, and how their files look.

Metadata rows come from table schemas and from the session catalog; both are lists of names,
so they are built on the driver. Everything about table *contents* stays in DataFrames.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import is_filled

# Names and limits of the inventory.
SYSTEM_SCHEMAS = ["information_schema", "meta"]
WRITABLE_TYPES = ["MANAGED", "EXTERNAL"]
INTERNAL_NAME_PATTERNS = [r"(?i)^__materialization_mat_", r"(?i)^event_log_[0-9a-f]{8}"]
SMALL_FILE_BYTES = 16 * 1024 * 1024

REGISTRY_DDL = (
    "table_catalog string, table_schema string, table_name string, table_type string, "
    "table_owner string, created_at timestamp_ntz, last_altered timestamp_ntz, table_comment string"
)
COLUMNS_DDL = (
    "table_catalog string, table_schema string, table_name string, column_name string, "
    "ordinal_position int, data_type string, column_comment string"
)


@dataclass(frozen=True)
class TableSource:
    """A readable table with its three-level name. `location` is needed for file statistics."""

    catalog: str
    schema: str
    name: str
    data: DataFrame
    location: str | None = None
    table_type: str = "MANAGED"
    owner: str | None = None
    comment: str | None = None
    column_comments: tuple[tuple[str, str], ...] = ()
    created_at: datetime | None = None


def parquet_tables(
    spark: SparkSession, directory: str, names: Iterable[str], catalog: str, schema: str
) -> list[TableSource]:
    """Tables stored as `<directory>/<name>.parquet`."""
    return [
        TableSource(catalog, schema, name, spark.read.parquet(path), path)
        for name in names
        for path in [f"{directory}/{name}.parquet"]
    ]


def catalog_tables(spark: SparkSession, catalog: str, schema: str | None = None) -> list[TableSource]:
    """Every table of one schema of a catalog, or of all its schemas but the system's own.

    Comments, owner, creation time and location come from the catalog, one lookup per table; data
    is not read. Views have no location.
    """
    if schema is None:
        listed = [row[0] for row in spark.sql(f"SHOW SCHEMAS IN {_name(catalog)}").collect()]
        return [t for s in listed if s not in SYSTEM_SCHEMAS for t in catalog_tables(spark, catalog, s)]
    found = []
    for table in spark.catalog.listTables(f"{_name(catalog)}.{_name(schema)}"):
        if table.isTemporary:
            continue
        full_name = ".".join(map(_name, (catalog, schema, table.name)))
        data = spark.table(full_name)
        comments = tuple(
            (field.name, field.metadata["comment"])
            for field in data.schema.fields
            if "comment" in field.metadata
        )
        facts = json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {full_name} AS JSON").first()[0])
        created = facts.get("created_time")
        found.append(
            TableSource(
                catalog, schema, table.name, data, None if table.tableType == "VIEW" else facts.get("location"),
                table.tableType, facts.get("owner"), table.description, comments,
                datetime.fromisoformat(created.replace("Z", "+00:00")).replace(tzinfo=None) if created else None,
            )
        )
    return found


def _name(part: str) -> str:
    return "`" + part.replace("`", "``") + "`"


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "timestamp_ntz": pa.timestamp("us")}


def metadata_frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Metadata rows as a local relation: its size is known to the optimizer and it needs no job."""
    fields = T.StructType.fromDDL(ddl).fields
    columns = [
        pa.array([row[i] for row in rows], _ARROW[f.dataType.simpleString()]) for i, f in enumerate(fields)
    ]
    return spark.createDataFrame(pa.table(columns, names=[f.name for f in fields]))


def registry_frame(spark: SparkSession, tables: list[TableSource]) -> DataFrame:
    rows = [
        (t.catalog, t.schema, t.name, t.table_type, t.owner, t.created_at, None, t.comment) for t in tables
    ]
    return metadata_frame(spark, rows, REGISTRY_DDL)


def columns_frame(spark: SparkSession, tables: list[TableSource]) -> DataFrame:
    """Column metadata. The schema always knows its columns, so no fallback listing is needed."""
    rows = [
        (t.catalog, t.schema, t.name, f.name, i, f.dataType.simpleString(), dict(t.column_comments).get(f.name))
        for t in tables
        for i, f in enumerate(t.data.schema.fields, start=1)
    ]
    return metadata_frame(spark, rows, COLUMNS_DDL)


def is_internal(table_name: Column) -> Column:
    """Backing tables of materialized views and pipeline logs mirror real tables."""
    flags = [table_name.rlike(p) for p in INTERNAL_NAME_PATTERNS]
    return flags[0] | flags[1]


def tables_in_scope(registry: DataFrame, schema: str | None = None) -> DataFrame:
    """Registry rows to audit, with `is_writable` and `has_comment`."""
    kept = registry.where(
        ~F.col("table_schema").isin(SYSTEM_SCHEMAS) & ~is_internal(F.col("table_name"))
    )
    if schema is not None:
        kept = kept.where(F.col("table_schema") == schema)
    return kept.withColumns(
        {
            "is_writable": F.col("table_type").isin(WRITABLE_TYPES),
            "has_comment": is_filled(F.col("table_comment")),
        }
    )


def is_fragmented(num_files: Column, size_bytes: Column) -> Column:
    files, size = F.coalesce(num_files, F.lit(0)), F.coalesce(size_bytes, F.lit(0))
    return (files > 1) & (F.try_divide(size, files) < SMALL_FILE_BYTES)


FILE_STATS_DDL = (
    "table_catalog string, table_schema string, table_name string, size_bytes bigint, num_files bigint, "
    "files_altered timestamp_ntz"
)


def qualified(spark: SparkSession, location: str) -> str:
    """A location as file listings spell it, with its file system's scheme and authority."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()


def stored_bytes(spark: SparkSession, location: str) -> int:
    """Bytes of all files at or below a location."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(path).getLength()


def file_stats(spark: SparkSession, tables: list[TableSource]) -> DataFrame:
    """Bytes, data files and their latest change per table that has a location; no file content is read.

    All roots are one listing, which Spark spreads over tasks when they are many. A file belongs to the
    table whose location is the longest of those that it lies below, so tables may lie inside each
    other's folders; tables that share a location all have its files.
    """
    located = [(t.catalog, t.schema, t.name, qualified(spark, t.location)) for t in tables if t.location]
    if not located:
        return metadata_frame(spark, [], FILE_STATS_DDL)
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(sorted({row[3] for row in located}))
        .select("path", "length", "modificationTime")
    )
    roots = metadata_frame(spark, located, "table_catalog string, table_schema string, table_name string, location string")
    # a path and all folders above it
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    homes = (
        files.select("path", "length", "modificationTime", F.explode(above).alias("location"))
        .join(roots.select("location").distinct(), "location")
        .groupBy("path")
        .agg(
            F.max_by("location", F.length("location")).alias("location"), F.first("length").alias("length"),
            F.first("modificationTime").alias("altered"),
        )
    )
    return homes.join(roots, "location").groupBy("table_catalog", "table_schema", "table_name").agg(
        F.sum("length").alias("size_bytes"), F.count(F.lit(1)).alias("num_files"),
        F.max("altered").cast("timestamp_ntz").alias("files_altered"),
    )


def row_counts(tables: list[TableSource]) -> DataFrame:
    """Rows per table (one at least); Parquet answers this from file footers without reading a column."""
    counts = [
        t.data.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(t.catalog).alias("table_catalog"),
            F.lit(t.schema).alias("table_schema"),
            F.lit(t.name).alias("table_name"),
            "row_count",
        )
        for t in tables
    ]
    result = counts[0]
    for frame in counts[1:]:
        result = result.unionByName(frame)
    return result

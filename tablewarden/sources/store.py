"""Meta tables: fixed schemas, append, additive evolution, run-scoped reads.

Tables are Parquet directories under a root the caller names, so the audited lake and the
inventory can live apart. Each is partitioned by its run key, so reading one scan prunes to
one directory.

Saving is repeatable: the rows of a run replace that run's directory, and a run's row is only added if it
is not there yet. So a save that failed halfway is done again, and one done twice leaves one copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Schemas of the meta tables.
SCHEMAS = {
    "scan_runs": "scan_id string, started_at timestamp_ntz, finished_at timestamp_ntz, catalog string",
    "table_inventory": (
        "scan_id string, scanned_at timestamp_ntz, table_catalog string, table_schema string, "
        "table_name string, table_type string, is_writable boolean, table_owner string, "
        "created_at timestamp_ntz, last_altered timestamp_ntz, table_comment string, "
        "has_comment boolean, row_count bigint, size_bytes bigint, num_files bigint, "
        "fragmented boolean, last_read_at timestamp_ntz, days_since_read int, never_read boolean"
    ),
    "column_profile": (
        "scan_id string, scanned_at timestamp_ntz, table_catalog string, table_schema string, "
        "table_name string, column_name string, ordinal_position int, data_type string, "
        "column_comment string, has_comment boolean, row_count bigint, null_count bigint, "
        "null_ratio double, distinct_count bigint, is_all_null boolean, is_constant boolean, "
        "pii_by_name string, pii_by_value string, is_pii_candidate boolean, "
        "sample_values string, sample_redacted boolean"
    ),
    "suggestions": (
        "run_id string, scan_id string, generated_at timestamp_ntz, model string, "
        "table_catalog string, table_schema string, table_name string, column_name string, "
        "suggested_comment string, pii_by_regex string, pii_by_llm string, pii_agreement string, "
        "type_looks_wrong boolean, values_withheld boolean, applied boolean, doc_system string, "
        "doc_citations array<string>, doc_matched_terms array<string>, grounded_in_docs boolean, "
        "suggested_comment_pt string"
    ),
    "table_descriptions": (
        "run_id string, scan_id string, generated_at timestamp_ntz, table_catalog string, "
        "table_schema string, table_name string, description string, description_pt string, "
        "applied boolean"
    ),
    "model_runs": (
        "run_id string, scan_id string, started_at timestamp_ntz, finished_at timestamp_ntz, "
        "model string, tables_processed int, columns_documented int, prompt_tokens bigint, "
        "completion_tokens bigint, est_cost_usd double, applied boolean, tables_grounded int, comments_staged int"
    ),
}
# The two run tables hold one row per run and stay unpartitioned.
RUN_KEYS = {
    "table_inventory": "scan_id",
    "column_profile": "scan_id",
    "suggestions": "run_id",
    "table_descriptions": "run_id",
}


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


def conform(rows: DataFrame, table: str) -> DataFrame:
    """Rows with exactly the table's columns and types; columns added since are NULL.

    A column that the table does not know is an error, as dropping it would lose it unnoticed.
    """
    unknown = sorted(set(rows.columns) - set(schema_of(table).names))
    if unknown:
        raise ValueError(f"{table} has no column {', '.join(unknown)}")
    return rows.select(
        *[
            (F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema_of(table).fields
        ]
    )


# The key of the tables that hold one row per run.
ROW_KEYS = {"scan_runs": "scan_id", "model_runs": "run_id"}


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def append(rows: DataFrame, root: str, table: str) -> None:
    """Add runs to a meta table, creating it when absent. A run that is there already is not there twice."""
    conformed, path = conform(rows, table), f"{root}/{table}"
    if table in RUN_KEYS:
        writer = conformed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(RUN_KEYS[table]).parquet(path)
        return
    if exists(rows.sparkSession, path):
        stored = read(rows.sparkSession, root, table).select(ROW_KEYS[table])
        conformed = conformed.join(stored, ROW_KEYS[table], "left_anti").select(*schema_of(table).names)
    conformed.write.mode("append").parquet(path)


def read(spark: SparkSession, root: str, table: str, run: str | None = None) -> DataFrame:
    """A meta table, or one run of it. Files written before a column existed read as NULL.

    The schema is given, not inferred or merged, so opening a table with very many files
    reads no footers; `run` is a filter on the partition column.
    """
    rows = conform(spark.read.schema(schema_of(table)).parquet(f"{root}/{table}"), table)
    return rows if run is None else rows.where(F.col(RUN_KEYS[table]) == run)


def union_evolved(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Rows of two generations of one table; columns only one of them has are NULL in the other."""
    return older.unionByName(newer, allowMissingColumns=True)

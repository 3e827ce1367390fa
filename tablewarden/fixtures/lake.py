"""The given tables as an audited lake: registry, derived query log, planted columns."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.pii import cpf_with_check_digits
from ..functions.moments import moment
from ..operators.usage import MARKER
from ..sources.registry import REGISTRY_DDL, TableSource, metadata_frame, parquet_tables

CATALOG = "lake"
SCHEMAS = {
    "raw": ["orders", "lineitem", "events"],
    "ref": ["region", "nation"],
    "crm": ["customer", "supplier", "part"],
    "docs": ["documents", "pages", "labels", "benchmark", "embeddings", "conversations"],
}
TABLES = [name for names in SCHEMAS.values() for name in names]
ASOF = datetime(2024, 4, 15)

# Names an event's statement may read, by position.
LOGGED = [
    "lineitem", "orders", "customer", "supplier", "nation", "region",
    "events", "documents", "embeddings", "pages", "orders_v2", "part_v2",
]
REDIRECTED_FROM = datetime(2024, 1, 10)


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def tables(spark: SparkSession, directory: str) -> list[TableSource]:
    found = [
        table
        for schema, names in SCHEMAS.items()
        for table in parquet_tables(spark, directory, names, CATALOG, schema)
    ]
    comments = {"orders": "Customer orders", "lineitem": "", "events": " "}
    owners = {"region": "data@example.com", "nation": "0f8fad5b-d9cb-469f-a165-70867728950e"}
    return [replace(t, comment=comments.get(t.name), owner=owners.get(t.name)) for t in found]


def raw_registry(spark: SparkSession) -> DataFrame:
    """All tables as `lake.raw.*`, with two later versions and two internal backing tables."""
    names = [*TABLES, "orders_v2", "part_v2", "__MATERIALIZATION_mat_orders", "event_log_0a1b2c3d"]
    rows = [(CATALOG, "raw", name, "MANAGED", None, None, None, None) for name in names]
    return metadata_frame(spark, rows, REGISTRY_DDL)


def query_log(spark: SparkSession, directory: str, layered: bool = False) -> DataFrame:
    """One statement per event; error events are the audit's own, signups are no SELECT.

    Statements name `lake.raw.<table>`, or with `layered` the schema the table really has.
    """
    slot = (F.col("event_id") % len(LOGGED)).cast("int")
    picked = F.element_at(F.array(*[F.lit(n) for n in LOGGED]), slot + 1)
    late = picked.isin("embeddings", "pages") & (F.col("ts") >= moment(REDIRECTED_FROM))
    table = F.when(late, "lineitem").otherwise(picked)
    cased = F.when(F.col("event_id") % 5 == 0, F.initcap(table)).otherwise(table)
    schema = F.lit("raw")
    if layered:
        schema = F.coalesce(
            *[F.when(table.isin(names), F.lit(schema)) for schema, names in SCHEMAS.items()], F.lit("raw")
        )
    name = F.when(
        F.col("event_id") % 2 == 0, F.concat(F.lit("`lake`.`"), schema, F.lit("`.`"), cased, F.lit("`"))
    ).otherwise(F.concat(F.lit("lake."), schema, F.lit("."), cased))
    marker = F.when(F.col("event_type") == "error", f"/* {MARKER} */ ").otherwise("")
    return read(spark, directory, "events").select(
        F.col("ts").alias("start_time"),
        F.when(F.col("event_type") == "signup", "INSERT").otherwise("SELECT").alias("statement_type"),
        F.concat(marker, F.lit("SELECT * FROM "), name).alias("statement_text"),
    )


def contacts(spark: SparkSession, directory: str) -> TableSource:
    """Customers with columns that hold personal data, half-clean data, nothing, or one value."""
    cpf = cpf_with_check_digits("lpad(c_custkey + 1, 9, '0')")
    data = (
        read(spark, directory, "customer")
        .selectExpr("c_custkey", "c_nationkey", "c_mktsegment", f"{cpf} AS cpf")
        .selectExpr(
            "c_custkey",
            "concat('c', c_custkey, '@example.com') AS contact",
            "CASE WHEN c_nationkey > 5 THEN concat('+55 (11) 9', lpad(c_custkey, 8, '0')) END AS line_no",
            "cpf AS document_no",
            "CASE WHEN c_mktsegment = 'BUILDING' THEN concat(left(cpf, 10), 'x') ELSE cpf END AS old_document_no",
            "CASE WHEN c_mktsegment = 'BUILDING' THEN 'not an email' ELSE concat(c_custkey, '@example.org') END AS mixed",
            "CAST(NULL AS STRING) AS nickname",
            "'BR' AS country",
        )
    )
    return TableSource(CATALOG, "crm", "contacts", data)


def legacy_orders(spark: SparkSession, directory: str) -> TableSource:
    """Orders with one column that is always null and one that never changes."""
    data = read(spark, directory, "orders").select(
        "*",
        F.lit(None).cast("string").alias("o_legacy"),
        F.when(F.col("o_orderstatus") != "P", F.lit("BR")).alias("o_country"),
    )
    return TableSource(CATALOG, "raw", "legacy_orders", data)


def planted_markdown(spark: SparkSession, directory: str) -> DataFrame:
    """Documents as Markdown: every line that starts with A to E becomes a heading."""
    return read(spark, directory, "documents").select(
        "doc_id",
        F.col("source").alias("system"),
        F.regexp_replace("text", "(^|\n)([A-E])", "$1## $2").alias("text"),
    )


def document_chunks(spark: SparkSession, directory: str) -> DataFrame:
    """Whole documents as retrieval chunks of the system they came from."""
    return read(spark, directory, "documents").select(
        F.col("source").alias("system"),
        F.col("doc_id").alias("chunk_id"),
        F.concat_ws(" ", "lang", F.col("doc_id").cast("string")).alias("heading"),
        F.col("text").alias("body"),
    )

"""Who reads what: last read per table from a query log, orphans, recent activity.

The log is (start_time, statement_type, statement_text). It may hold billions of statements
and the registry many tables, so neither side is ever paired with the other: names are cut
out of each statement, reduced to one latest time per distinct name inside each task, and
only those distinct names are joined to the registry.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.generate import explode_once
from ..functions.moments import moment, whole_days_between
from .profile import TABLE_KEY

# A comment that travels with the engine's own statements; reads that carry it are nobody's use of a table.
MARKER = "tablewarden-scan"
# Look-back of the log and age after which a table counts as abandoned.
LOOK_BACK_DAYS = 365
ORPHAN_DAYS = 90

# A dotted name of two or three parts, each optionally back-quoted. A bare part holds a letter
# or an underscore, so decimal numbers are no names.
_PART = r"(?:`[^`]+`|[A-Za-z0-9_]*[A-Za-z_][A-Za-z0-9_]*)"
_DOTTED_NAME = rf"{_PART}(?:\s*\.\s*{_PART}){{1,2}}"


def marked(statement: str) -> str:
    """SQL text the audit may run against user data."""
    return f"/* {MARKER} */ {statement}"


LOG_DDL = "start_time timestamp_ntz, statement_type string, statement_text string"


def own_statements(spark: SparkSession, names: list[tuple[str, str, str]], at: datetime) -> DataFrame:
    """The log rows of an audit's own reads of tables, marked as such."""
    rows = [(at, "SELECT", marked(f"SELECT * FROM {'.'.join(f'`{part}`' for part in name)}")) for name in names]
    return spark.createDataFrame(rows, LOG_DDL)


@contextmanager
def as_own_reads(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside carry the marker as a tag and in their description, where job listings show it."""
    context = spark.sparkContext
    context.addJobTag(MARKER)
    context.setJobDescription(marked("audit"))
    try:
        yield
    finally:
        context.removeJobTag(MARKER)
        context.setJobDescription(None)


def foreign_reads(log: DataFrame, asof: datetime, mentions: list[str], later: bool = False) -> DataFrame:
    """SELECTs of the look-back window, up to `asof`, that mention a catalog and are not the audit's own.

    Time and type filters reach the scan. Mentions are literal and ignore case. With `later`, as for
    a log that goes on, statements after `asof` count too.
    """
    text = F.lower(F.col("statement_text"))
    since = moment(asof) - F.expr(f"INTERVAL {LOOK_BACK_DAYS} DAYS")
    about = F.lit(False)
    for catalog in mentions:
        about = about | text.contains(catalog.lower())
    return log.where(
        (F.col("start_time") >= since)
        & (F.lit(later) | (F.col("start_time") <= moment(asof)))
        & (F.col("statement_type") == "SELECT")
        & about
        & ~text.contains(MARKER)
    ).select("start_time", text.alias("statement_text"))


def _latest(named_reads: DataFrame, keys: list[str]) -> DataFrame:
    return named_reads.groupBy(*keys).agg(F.max("start_time").alias("last_read_at"))


def latest_by_name(reads: DataFrame) -> DataFrame:
    """Latest time per distinct dotted name found in the statements.

    A name of three parts may be a table's in a catalog or a column's of a table, so its first two
    parts count as well. They are added to the distinct names, not to each statement's.
    """
    found = F.transform(
        F.array_distinct(F.regexp_extract_all("statement_text", F.lit(_DOTTED_NAME), F.lit(0))),
        lambda n: F.replace(F.regexp_replace(n, r"\s*\.\s*", "."), F.lit("`"), F.lit("")),
    )
    named = _latest(explode_once(reads, found, "mentioned_name", "start_time"), ["mentioned_name"])
    shorter = named.select(F.substring_index("mentioned_name", ".", 2).alias("mentioned_name"), "last_read_at")
    return _latest(
        named.unionByName(shorter.where("mentioned_name IS NOT NULL")).withColumnRenamed("last_read_at", "start_time"), ["mentioned_name"]
    )


def last_read_by_name(reads: DataFrame, tables: DataFrame) -> DataFrame:
    """Latest read per table, matching whole `schema.table` or `catalog.schema.table` names.

    `reads` are statements, or names already cut out of them (mentioned_name, start_time).
    """
    if "mentioned_name" in reads.columns:
        mentioned = _latest(reads, ["mentioned_name"])
    else:
        mentioned = latest_by_name(reads)
    full = F.lower(F.concat_ws(".", *TABLE_KEY))
    bare = F.lower(F.concat_ws(".", "table_schema", "table_name"))
    return _latest(
        tables.select(*TABLE_KEY, F.explode(F.array(full, bare)).alias("mentioned_name"))
        .join(mentioned, "mentioned_name")
        .withColumnRenamed("last_read_at", "start_time"),
        TABLE_KEY,
    )


def last_read_by_substring(reads: DataFrame, tables: DataFrame) -> DataFrame:
    """Latest read per table, where a statement counts if it merely contains `schema.table`.

    So a read of `orders_v2` also counts for `orders`. A name of this form contains exactly
    one dot (catalogs allow neither dots nor blanks inside a name). It occurs in a text iff
    at some dot the text to the left ends with the schema and the text to the right starts
    with the table name. Each dot therefore yields its two neighbouring runs, reduced to the
    latest time of each distinct pair. Right runs expand to their prefixes of the lengths that
    table names have, and those that are a table's name to the suffixes of left runs of the lengths
    that schemas have; containment is then an equi-join on (schema, table).
    """
    registered = tables.select(F.lower("table_name").alias("wanted_name"), F.lower("table_schema").alias("wanted_schema"))
    name_lengths, schema_lengths = (
        registered.agg(F.array_sort(F.collect_set(F.length(c)))).scalar() for c in ("wanted_name", "wanted_schema")
    )
    parts = F.split(F.replace(F.col("statement_text"), F.lit("`"), F.lit("")), r"\.")
    around_dots = F.transform(
        F.sequence(F.lit(1), F.size("parts") - 1),
        lambda i: F.struct(
            F.regexp_extract(F.element_at("parts", i), r"(\S*)\z", 1).alias("left_run"),
            F.regexp_extract(F.element_at("parts", i + 1), r"^(\S*)", 1).alias("right_run"),
        ),
    )
    dots = _latest(
        reads.select("start_time", parts.alias("parts"))
        .where(F.size("parts") > 1)
        .select("start_time", F.inline_outer(F.array_distinct(around_dots))),
        ["left_run", "right_run"],
    )
    dots = dots.withColumns({"name_lengths": name_lengths, "schema_lengths": schema_lengths})
    starts = F.transform(
        F.filter("name_lengths", lambda n: n <= F.length("right_run")), lambda n: F.left(F.col("right_run"), n)
    )
    ends = F.transform(
        F.filter("schema_lengths", lambda n: n <= F.length("left_run")), lambda n: F.right(F.col("left_run"), n)
    )
    named = explode_once(
        dots, starts, "wanted_name", "left_run", "schema_lengths", F.col("last_read_at").alias("start_time")
    ).join(registered.select("wanted_name").distinct(), "wanted_name", "left_semi")
    named = _latest(explode_once(named, ends, "wanted_schema", "wanted_name", "start_time"), ["wanted_schema", "wanted_name"])
    return _latest(
        tables.withColumns({"wanted_name": F.lower("table_name"), "wanted_schema": F.lower("table_schema")})
        .join(named.withColumnRenamed("last_read_at", "start_time"), ["wanted_schema", "wanted_name"]),
        TABLE_KEY,
    )


def with_last_read(tables: DataFrame, last_read: DataFrame, asof: datetime) -> DataFrame:
    read_at = F.col("last_read_at")
    return (
        tables.join(last_read.select(*TABLE_KEY, "last_read_at"), TABLE_KEY, "left")
        .withColumn("days_since_read", whole_days_between(read_at, moment(asof)))
        .withColumn("never_read", read_at.isNull())
    )


def is_orphan() -> Column:
    """Never read, or not for more than 90 days."""
    return F.coalesce(F.col("never_read"), F.lit(False)) | F.coalesce(
        F.col("days_since_read") > ORPHAN_DAYS, F.lit(False)
    )


def last_read_label() -> Column:
    return F.when(F.col("never_read"), F.lit("never")).otherwise(
        F.concat(F.col("days_since_read").cast("string"), F.lit(" days ago"))
    )


def recent_activity(rows: DataFrame, time_column: str, asof: datetime, days: int = 7) -> DataFrame:
    """Rows of the days up to `asof`; both bounds are pushed to the scan."""
    return rows.where(
        (F.col(time_column) >= moment(asof) - F.expr(f"INTERVAL {days} DAYS"))
        & (F.col(time_column) <= moment(asof))
    )

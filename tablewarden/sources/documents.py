"""Documentation corpus (`<root>/sources/<system>.md`) and the ordered table-to-system mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

MAPPING_SCHEMA = T.StructType(
    [
        T.StructField(
            "mappings",
            T.ArrayType(
                T.StructType(
                    [T.StructField("match", T.StringType()), T.StructField("system", T.StringType())]
                )
            ),
        )
    ]
)


def read_mapping(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Ordered (match, system) rules of a mapping file.

    The rules are configuration written by hand, not data; they become one CASE expression.
    """
    rules = (
        spark.read.schema(MAPPING_SCHEMA)
        .json(path, multiLine=True)
        .select(F.posexplode("mappings"))
        .select("pos", "col.match", "col.system")
        .orderBy("pos")
    )
    return [(row["match"], row["system"]) for row in rules.toLocalIterator()]


def system_for(qualified_name: Column, rules: list[tuple[str, str]]) -> Column:
    """System of the first rule whose pattern covers the whole `schema.table` name.

    `*` is the only wildcard; any other character keeps its regex meaning, as the mapping
    format prescribes. Literal patterns are compiled once per task, and no join is planned
    however many tables there are.
    """
    if not rules:
        return F.lit(None).cast("string")
    return F.coalesce(
        *[
            F.when(qualified_name.rlike("^(?:" + match.replace("*", ".*") + r")\z"), F.lit(system))
            for match, system in rules
        ]
    )


def read_documents(spark: SparkSession, root: str, rules: list[tuple[str, str]]) -> DataFrame:
    """One row per documented system that a rule names: (system, text)."""
    named = F.regexp_replace("file_name", r"\.md$", "")
    return (
        spark.read.text(f"{root}/sources", wholetext=True, pathGlobFilter="*.md")
        .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
        .select(named.alias("system"), "text")
        .where(F.col("system").isin(sorted({system for _, system in rules})))
    )


def document_title(text: Column, fallback: Column) -> Column:
    """First heading of a document, else its file stem."""
    from ..functions.text import heading_title, unix_lines

    first = F.regexp_extract(unix_lines(text), r"(?m)^(#[^\n]*)$", 1)
    return F.when(first != "", heading_title(first)).otherwise(fallback)

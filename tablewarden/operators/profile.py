"""Column profiles.

`profile_table` is one aggregate over one scan: every column's counts, sketch, bounds and
value classification come from the same pass, with partial aggregation before the only
exchange (one row per task). Exact distincts would plan an Expand with one copy of each row
per column, so they are a separate, per-column aggregate (`exact_distinct`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.pii import SAMPLE_ROWS, classify_by_name, classify_values, is_textual, sample_text, value_rules
from ..sources.registry import TableSource

TABLE_KEY = ["table_catalog", "table_schema", "table_name"]
# Wide rows leave whole-stage code generation (spark.sql.codegen.maxFields), so very wide
# tables are aggregated a group of columns at a time.
COLUMNS_PER_AGGREGATE = 50
# log2 of the sketch's buckets, about 1.6% error. One binary buffer per column keeps the
# aggregation row narrow, and sketches of partitions or scans could be merged.
SKETCH_SIZE = 12



def _is_orderable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return _is_orderable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(_is_orderable(f.dataType) for f in data_type.fields)
    return not isinstance(data_type, (T.MapType, T.VariantType))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _column_stats(field: T.StructField, position: int, values: bool) -> str:
    column = quoted(field.name)
    distinct, single, label = "CAST(NULL AS BIGINT)", "false", "CAST(NULL AS STRING)"
    if _is_orderable(field.dataType):
        distinct = f"hll_sketch_estimate(hll_sketch_agg(if({column} IS NULL, NULL, xxhash64({column})), {SKETCH_SIZE}))"
        # min = max proves a single value exactly, where a sketch may be off by one.
        single = f"min({column}) <=> max({column})"
    if values and is_textual(field.dataType):
        label = classify_values(column)
    return (
        f"named_struct('column_name', {literal(field.name)}, 'ordinal_position', {position}, "
        f"'non_null', count({column}), 'distinct_count', {distinct}, 'is_single_valued', {single}, "
        f"'pii_by_value', {label})"
    )


def _key(table: TableSource) -> list[str]:
    return [
        f"{literal(value)} AS {name}"
        for name, value in zip(TABLE_KEY, (table.catalog, table.schema, table.name))
    ]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def profile_table(table: TableSource, values: bool = True) -> DataFrame:
    """Long-form profile of one table: one row per column.

    `values=False` leaves out the value rules, which are the only part that costs more than
    reading the column.
    """
    fields = list(enumerate(table.data.schema.fields, start=1))
    groups = [
        fields[i : i + COLUMNS_PER_AGGREGATE] for i in range(0, len(fields), COLUMNS_PER_AGGREGATE)
    ]
    parts = [
        table.data.selectExpr(
            "count(1) AS row_count",
            f"array({', '.join(_column_stats(field, position, values) for position, field in group)}) AS stats",
        ).selectExpr(*_key(table), "row_count", "inline(stats)")
        for group in groups
    ]
    return union_all(parts).selectExpr(
        *TABLE_KEY,
        "column_name",
        "ordinal_position",
        "row_count",
        "row_count - non_null AS null_count",
        "try_divide(row_count - non_null, row_count) AS null_ratio",
        "distinct_count",
        "row_count > 0 AND non_null = 0 AS is_all_null",
        "non_null > 0 AND is_single_valued AS is_constant",
        "pii_by_value",
    )


def profile_tables(tables: list[TableSource], values: bool = True) -> DataFrame:
    """Profiles of several tables. For thousands of tables, call it on batches and append."""
    return union_all([profile_table(t, values) for t in tables])


def distinct_sketches(tables: list[TableSource], part: str | None = None) -> DataFrame:
    """Mergeable distinct counts: (table key, part, column_name, sketch), one scan a table.

    `part` is an expression that splits the rows, as days or partitions do; sketches of new parts are added
    to stored ones, so that old rows need not be read again (`merged_distinct`).
    """
    frames = []
    for table in tables:
        fields = [f for f in table.data.schema.fields if _is_orderable(f.dataType)]
        sketches = ", ".join(
            f"named_struct('column_name', {literal(f.name)}, 'sketch', "
            f"hll_sketch_agg(if({quoted(f.name)} IS NULL, NULL, xxhash64({quoted(f.name)})), {SKETCH_SIZE}))"
            for f in fields
        )
        split = table.data.withColumn("_part", F.expr(f"CAST({part} AS STRING)" if part else "CAST(NULL AS STRING)"))
        found = split.groupBy("_part").agg(F.expr(f"array({sketches})").alias("stats"))
        frames.append(found.selectExpr(*_key(table), "_part AS part", "inline(stats)"))
    return union_all(frames)


def merged_distinct(sketches: DataFrame) -> DataFrame:
    """Distinct count per column over all parts: (table key, column_name, distinct_count)."""
    return sketches.groupBy(*TABLE_KEY, "column_name").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_count")
    )


def value_matches(tables: list[TableSource]) -> DataFrame:
    """How many values of each text column obey each value rule: (table key, column_name, rule, matches, non_null).

    Counts of parts or scans add up, and one odd value among very many shows as a share instead of taking the
    column's label away.
    """
    frames = []
    for table in tables:
        names = [f.name for f in table.data.schema.fields if is_textual(f.dataType)]
        if not names:
            continue
        counts = ", ".join(
            f"named_struct('column_name', {literal(n)}, 'rule', {literal(rule)}, 'matches', count_if({test}), 'non_null', count({quoted(n)}))"
            for n in names
            for rule, test in value_rules(quoted(n)).items()
        )
        frames.append(table.data.selectExpr(f"array({counts}) AS stats").selectExpr(*_key(table), "inline(stats)"))
    return union_all(frames)


def match_shares(matches: DataFrame) -> DataFrame:
    """Counts of `value_matches` added up, with `share`; NULL where a column has no value."""
    return (
        matches.groupBy(*TABLE_KEY, "column_name", "rule")
        .agg(F.sum("matches").alias("matches"), F.sum("non_null").alias("non_null"))
        .withColumn("share", F.try_divide("matches", "non_null"))
    )


def with_pii(profile: DataFrame) -> DataFrame:
    """Add the name verdict and the combined candidate flag."""
    return profile.withColumn("pii_by_name", classify_by_name(F.col("column_name"))).withColumn(
        "is_pii_candidate", F.col("pii_by_name").isNotNull() | F.col("pii_by_value").isNotNull()
    )


def exact_distinct(tables: list[TableSource]) -> DataFrame:
    """Exact distinct count per column, each from a scan of that column alone.

    Values are deduplicated before the shuffle, so a value held by a third of the rows
    travels once per task.
    """
    return union_all(
        [
            table.data.selectExpr(
                *_key(table),
                f"{literal(field.name)} AS column_name",
                f"count(DISTINCT {quoted(field.name)}) AS exact_distinct",
            )
            for table in tables
            for field in table.data.schema.fields
            if _is_orderable(field.dataType)
        ]
    )


def column_samples(table: TableSource, key: str, columns: list[str] | None = None) -> DataFrame:
    """First five values of each column, by `key`, then by a hash of the row: (column_name, samples array).

    Repeatable, also where keys repeat or have no order; then the hash alone decides. A top-k per task and a merge of five rows; only the asked columns are read.
    """
    names = columns if columns is not None else [f.name for f in table.data.schema.fields]
    row_values = ", ".join(f"CAST({quoted(n)} AS STRING)" for n in names)
    head = (
        table.data.selectExpr(
            f"{quoted(key) if _is_orderable(table.data.schema[key].dataType) else '0'} AS key", f"array({row_values}) AS row_values"
        )
        .selectExpr("struct(key, xxhash64(row_values) AS tie) AS sample_key", "row_values")
        .orderBy("sample_key")
        .limit(SAMPLE_ROWS)
    )
    return (
        head.selectExpr("sample_key", "posexplode(row_values) AS (position, value)")
        .groupBy("position")
        .agg(F.expr("array_sort(collect_list(struct(sample_key, value)))").alias("picked"))
        .selectExpr(
            *_key(table),
            f"element_at(array({', '.join(literal(n) for n in names)}), position + 1) AS column_name",
            "picked.value AS samples",
        )
    )


def with_stored_samples(profile: DataFrame, samples: DataFrame) -> DataFrame:
    """Attach the stored sample text; a flagged column never carries a raw value."""
    return (
        profile.join(samples, [*TABLE_KEY, "column_name"], "left")
        .withColumn("sample_values", sample_text(F.col("samples"), F.col("is_pii_candidate")))
        .withColumn("sample_redacted", F.col("is_pii_candidate"))
        .drop("samples")
    )


def castable_share(table: TableSource, columns: list[str]) -> DataFrame:
    """How much of each text column reads as a number, a date or a timestamp, in one pass.

    A column is mistyped when every non-null value reads as one of them; numbers are tried
    first, then dates (texts that are a date and nothing more), then timestamps.
    """
    stats = ", ".join(
        f"named_struct('column_name', {literal(c)}, 'non_null', count({quoted(c)}), "
        f"'as_double', count(try_cast({quoted(c)} AS DOUBLE)), "
        f"'as_date', count_if(CAST(try_cast({quoted(c)} AS DATE) AS STRING) = trim({quoted(c)})), "
        f"'as_timestamp', count(try_cast({quoted(c)} AS TIMESTAMP_NTZ)))"
        for c in columns
    )
    return (
        table.data.selectExpr(f"array({stats}) AS stats")
        .selectExpr("inline(stats)")
        .selectExpr(
            *_key(table),
            "*",
            "CASE WHEN non_null = 0 THEN 'string' WHEN as_double = non_null THEN 'double' "
            "WHEN as_date = non_null THEN 'date' "
            "WHEN as_timestamp = non_null THEN 'timestamp' ELSE 'string' END AS inferred_type",
        )
        .selectExpr("*", "inferred_type != 'string' AS type_looks_wrong")
    )

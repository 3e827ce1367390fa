"""Prompts out, model responses in: suggestions, agreement, provenance, comment statements.

The model itself is not called here. `prompts` yields one row per table to send anywhere;
responses come back as a table of JSON strings, one per audited table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.lookup import looked_up
from ..functions.text import DESCRIPTION_CHARS, is_filled, quoted_name, sql_text, strip
from .profile import TABLE_KEY

# Layout of prompts and responses.
PROMPT_SAMPLE_CHARS = 200
RESPONSE_DDL = (
    "table_description string, table_description_pt string, columns array<struct<name: string, "
    "description: string, description_pt: string, pii: string, type_looks_wrong: boolean, "
    "grounded_in_docs: boolean>>"
)


def load_scan(profile: DataFrame, inventory: DataFrame) -> DataFrame:
    """Columns of a scan with what is known of their table. The catalog is part of the key."""
    tables = inventory.select(
        "scan_id", *TABLE_KEY, "table_type", "is_writable", F.col("has_comment").alias("table_has_comment")
    ).hint("merge")  # as many as a catalog has, also where few of their columns are read
    return profile.join(tables, ["scan_id", *TABLE_KEY])


def pattern_label() -> Column:
    return F.coalesce("pii_by_name", "pii_by_value")


def prompt_line() -> Column:
    """One column's line. A flagged column shows counts only; its values are withheld."""
    stats = F.format_string(
        "- %s (%s), %d rows, %d nulls, %d distinct",
        "column_name", "data_type", "row_count", "null_count", "distinct_count",
    )
    samples = F.left(F.coalesce("sample_values", F.lit("")), F.lit(PROMPT_SAMPLE_CHARS))
    return F.when(
        F.col("is_pii_candidate"), F.concat(stats, F.lit(" [SENSITIVE: values withheld]"))
    ).otherwise(F.concat(stats, F.lit(", samples: "), samples))


def prompts(scan: DataFrame, grounding: DataFrame | None = None) -> DataFrame:
    """One prompt per table: documentation if any was found, header, one line per column.

    `grounding` is (table key, system, context). Rows of one table meet in one group; that
    is as wide as a table, not as long.
    """
    lines = (
        scan.select(*TABLE_KEY, "table_type", F.struct("ordinal_position", prompt_line().alias("line")).alias("entry"))
        .groupBy(*TABLE_KEY, "table_type")
        .agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    )
    body = F.concat(
        F.lit("Table: "), F.col("table_schema"), F.lit("."), F.col("table_name"),
        F.lit(" ("), F.col("table_type"), F.lit(")\nColumns:\n"),
        F.array_join("entries.line", "\n"),
    )
    if grounding is None:
        return lines.select(*TABLE_KEY, body.alias("prompt"))
    documentation = F.concat(
        F.lit("SOURCE DOCUMENTATION ("), F.col("system"), F.lit("):\n"), F.col("context"),
        F.lit("\n\nEND OF DOCUMENTATION.\n\n"),
    )
    return lines.join(grounding.select(*TABLE_KEY, "system", "context").hint("merge"), TABLE_KEY, "left").select(
        *TABLE_KEY, F.concat(F.coalesce(documentation, F.lit("")), body).alias("prompt")
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """(table key, response string) with the response parsed; bad JSON parses to NULLs."""
    return responses.select(*TABLE_KEY, F.from_json("response", RESPONSE_DDL, {"mode": "PERMISSIVE"}).alias("r"))


# What a response says about a column.
SAID = ["description", "description_pt", "pii", "type_looks_wrong", "grounded_in_docs"]


def with_responses(scan: DataFrame, responses: DataFrame) -> DataFrame:
    """`scan` with `SAID` of the response's entry of that column's name, nulls if there is none; of repeated names the
    last one counts."""
    entries = (
        parse_responses(responses)
        .select(*TABLE_KEY, F.posexplode("r.columns").alias("position", "suggestion"))
        .select(*TABLE_KEY, F.col("suggestion.name").alias("column_name"), "position", *[F.col(f"suggestion.{n}").alias(f"said_{n}") for n in SAID])
    )
    last = {n: F.max_by(f"said_{n}", "position") for n in SAID}
    return looked_up(scan, entries, [*TABLE_KEY, "column_name"], **last)


def agreement(by_pattern: Column, by_model: Column) -> Column:
    pattern_hit = is_filled(by_pattern)
    model_hit = is_filled(by_model) & (by_model != "none")
    return (
        F.when(pattern_hit & model_hit, "both")
        .when(pattern_hit, "regex_only")
        .when(model_hit, "llm_only")
        .otherwise("neither")
    )


# The labels a model may give.
MODEL_LABELS = [
    "none", "person_name", "national_id", "email", "phone", "birth_date", "address", "network_id", "other_pii",
]


def known_label(said: Column) -> Column:
    """A model's label if it is one of the closed set, whatever its case and the blanks around it, else NULL: a
    misspelt label is no verdict."""
    label = F.lower(F.trim(said))
    return F.when(label.isin(MODEL_LABELS), label)


def wrong_types(suggestions: DataFrame) -> DataFrame:
    """Columns whose type the model calls wrong, with their description: (table key, column_name, suggested_comment)."""
    return suggestions.where("type_looks_wrong").select(*TABLE_KEY, "column_name", "suggested_comment")


def _cut(text: Column) -> Column:
    return F.left(F.coalesce(text, F.lit("")), F.lit(DESCRIPTION_CHARS))


def _filled_or_null(text: Column) -> Column:
    return F.nullif(_cut(text), F.lit(""))


def ingest(
    scan: DataFrame, responses: DataFrame, grounding: DataFrame | None = None, apply: bool = False
) -> DataFrame:
    """Suggestions for every scanned column; columns the model skipped stay, invented ones go.

    `grounding` is (table key, system, citations, matched_terms).
    """
    # grounding first: what only reads the documentation needs no response, and the optimizer drops that join
    if grounding is not None:
        joined = scan.join(
            grounding.select(*TABLE_KEY, "system", "citations", "matched_terms").hint("merge"), TABLE_KEY, "left"
        )
    else:
        joined = scan.withColumns(
            {
                "system": F.lit(None).cast("string"),
                "citations": F.lit(None).cast("array<string>"),
                "matched_terms": F.lit(None).cast("array<string>"),
            }
        )
    said = {n: F.col(n) for n in SAID}
    return with_responses(joined, responses).select(
        *TABLE_KEY,
        "column_name",
        _cut(said["description"]).alias("suggested_comment"),
        pattern_label().alias("pii_by_regex"),
        known_label(said["pii"]).alias("pii_by_llm"),
        agreement(pattern_label(), said["pii"]).alias("pii_agreement"),
        F.coalesce(said["type_looks_wrong"], F.lit(False)).alias("type_looks_wrong"),
        F.col("is_pii_candidate").alias("values_withheld"),
        # Applied means that there was a text to apply.
        (F.lit(apply) & F.col("is_writable") & ~F.col("has_comment") & is_filled(said["description"])).alias("applied"),
        F.col("system").alias("doc_system"),
        F.col("citations").alias("doc_citations"),
        F.col("matched_terms").alias("doc_matched_terms"),
        (F.col("system").isNotNull() & F.coalesce(said["grounded_in_docs"], F.lit(False))).alias("grounded_in_docs"),
        _filled_or_null(said["description_pt"]).alias("suggested_comment_pt"),
    )


def table_descriptions(tables: DataFrame, responses: DataFrame, apply: bool = False) -> DataFrame:
    return tables.hint("merge").join(parse_responses(responses), TABLE_KEY, "left").select(
        *TABLE_KEY,
        _filled_or_null(F.col("r.table_description")).alias("description"),
        _filled_or_null(F.col("r.table_description_pt")).alias("description_pt"),
        (F.lit(apply) & F.col("is_writable")).alias("applied"),
    )


def comment_statements(scan: DataFrame, tables: DataFrame, responses: DataFrame) -> DataFrame:
    """DDL for everything that has a text and no comment yet: (table key, column_name, statement)."""
    name = quoted_name(*[F.col(k) for k in TABLE_KEY])
    table_text = strip(F.col("r.table_description"))
    for_tables = (
        tables.where(~F.col("has_comment"))
        .hint("merge")
        .join(parse_responses(responses), TABLE_KEY)
        .where(is_filled(table_text))
        .select(
            *TABLE_KEY, "is_writable", F.lit(None).cast("string").alias("column_name"),
            F.concat(F.lit("COMMENT ON TABLE "), name, F.lit(" IS "), sql_text(table_text)).alias("statement"),
        )
    )
    column_text = strip(F.col("description"))
    open_columns = scan.where(~F.col("has_comment")).select(*TABLE_KEY, "is_writable", "column_name")
    for_columns = (
        with_responses(open_columns, responses)
        .where(is_filled(column_text))
        .select(
            *TABLE_KEY, "is_writable", "column_name",
            F.concat(
                F.lit("ALTER TABLE "), name, F.lit(" ALTER COLUMN "), quoted_name(F.col("column_name")),
                F.lit(" COMMENT "), sql_text(column_text),
            ).alias("statement"),
        )
    )
    return for_tables.unionByName(for_columns)


def apply_comments(spark: SparkSession, statements: DataFrame) -> int:
    """Execute the statements of writable tables one by one; catalog DDL has no bulk form."""
    done = 0
    for row in statements.where("is_writable").select("statement").toLocalIterator():
        spark.sql(row["statement"])
        done += 1
    return done


def pii_agreement(suggestions: DataFrame, keys: list[str]) -> DataFrame:
    """Columns per outcome, and how many of them the model had to judge without values."""
    return suggestions.groupBy(*keys, "pii_agreement").agg(
        F.count(F.lit(1)).alias("columns"), F.count_if("values_withheld").alias("withheld")
    )


def pii_comparison(profile: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Every column either layer flags, with both verdicts and which layer knew it."""
    key = [*TABLE_KEY, "column_name"]
    by_pattern = profile.where("is_pii_candidate").select(*key, "pii_by_name", "pii_by_value", F.lit(True).alias("flagged"))
    by_model = suggestions.where(is_filled(F.col("pii_by_llm")) & (F.col("pii_by_llm") != "none")).select(*key, "pii_by_llm")
    return by_pattern.join(by_model, key, "full_outer").select(
        *key,
        *[F.coalesce(c, F.lit("-")).alias(c) for c in ("pii_by_name", "pii_by_value", "pii_by_llm")],
        F.when(F.col("flagged"), "pattern").otherwise("model only").alias("origin"),
    )


def provenance(suggestions: DataFrame) -> DataFrame:
    """Documentation each table was grounded in, one row per table, from stored suggestions.

    The passages are those of the table's first column that cites any; none if no column does.
    """
    # a least struct and not min_by, since repeated rows do not change it: what only repeats rows need not be joined
    citing = F.when((F.size("doc_citations") > 0) & F.col("column_name").isNotNull(), F.struct("column_name", "doc_citations"))
    return (
        suggestions.where(F.col("doc_system").isNotNull())
        .groupBy(*TABLE_KEY)
        .agg(F.min("doc_system").alias("doc_system"), F.min(citing).alias("passages"))
        .withColumn("passages", F.coalesce("passages.doc_citations", F.array().cast("array<string>")))
    )


def portal_columns(profile: DataFrame, written: DataFrame, texts: DataFrame, grounded: DataFrame) -> DataFrame:
    """Columns as a reader sees them.

    `written` are the suggestions of the run that wrote comments (model labels), `texts`
    those of the newest run (Portuguese), `grounded` is the provenance per table.
    """
    key = [*TABLE_KEY, "column_name"]
    model_label = F.when(is_filled(F.col("pii_by_llm")) & (F.col("pii_by_llm") != "none"), F.col("pii_by_llm"))
    if written is texts:
        said = written.select(*key, model_label.alias("label"), F.col("suggested_comment_pt").alias("portuguese"))
    else:
        said = written.select(*key, model_label.alias("label")).unionByName(
            texts.select(*key, F.col("suggested_comment_pt").alias("portuguese")), allowMissingColumns=True
        )
    known = F.filter(F.array("pii_by_name", "pii_by_value"), lambda label: label.isNotNull())
    model = F.col("model_label")
    all_labels = F.when(
        model.isNotNull() & ~F.array_contains(known, model),
        F.array_append(known, F.concat(model, F.lit(" (model)"))),
    ).otherwise(known)
    # one row for each pair of a label and a text, as two joins would give
    found = looked_up(profile, said, key, model_label=F.collect_list("label"), comment_pt=F.collect_list("portuguese"))
    for name in ("model_label", "comment_pt"):
        found = found.withColumn(name, F.explode_outer(name))
    return (
        found.join(grounded.select(*TABLE_KEY, "doc_system").hint("merge"), TABLE_KEY, "left")
        .withColumn("pii_labels", all_labels)
        .withColumn("is_pii", F.col("is_pii_candidate") | model.isNotNull())
        .drop("model_label")
    )


def portal_tables(inventory: DataFrame, columns: DataFrame, descriptions: DataFrame, grounded: DataFrame) -> DataFrame:
    """Tables as a reader sees them: Portuguese text of the newest run, documentation they are grounded
    in, and how many of their columns hold personal data or nothing. `columns` are those of
    `portal_columns`; a table without columns has zeros."""
    counts = columns.groupBy(*TABLE_KEY).agg(
        F.count_if("is_pii").alias("pii_count"),
        F.count_if(F.col("is_all_null") | F.col("is_constant")).alias("dead_count"),
    )
    return (
        inventory.join(descriptions.select(*TABLE_KEY, F.col("description_pt").alias("comment_pt")).hint("merge"), TABLE_KEY, "left")
        .join(grounded.select(*TABLE_KEY, "doc_system", "passages").hint("merge"), TABLE_KEY, "left")
        .join(counts, TABLE_KEY, "left")
        .fillna(0, ["pii_count", "dead_count"])
    )


def doc_usage(documents: DataFrame, grounded: DataFrame) -> DataFrame:
    """Tables grounded in each document (doc_id, title); documents nobody used are kept."""
    used = grounded.groupBy(F.col("doc_system").alias("doc_id")).agg(F.count(F.lit(1)).alias("tables"))
    return documents.join(used, "doc_id", "left").select(
        "doc_id", "title", F.coalesce("tables", F.lit(0)).alias("tables")
    )

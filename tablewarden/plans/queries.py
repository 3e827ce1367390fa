"""Registered queries: one callable (spark, directory) -> DataFrame per operator.

Every query reads whole given tables. `lake` is the given tables themselves under audit,
`estate` a large catalog derived from them.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import pii, text
from ..functions.durable import cut
from ..functions.generate import explode_once
from ..functions.moments import moment
from ..operators import findings, profile as profiling, retrieval, rollups, runs, search, suggest, usage
from ..operators.profile import TABLE_KEY
from ..sources import registry, store
from ..sources.documents import document_title, system_for
from ..fixtures import estate, lake
from ..fixtures.lake import read
from . import audit

CATALOG_KEY = ["table_catalog"]


# Inventory and profile

def table_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Rows and columns of every table in scope of the lake."""
    tables = lake.tables(spark, d)
    widths = registry.columns_frame(spark, tables).groupBy(*TABLE_KEY).agg(F.count(F.lit(1)).alias("columns"))
    return (
        registry.tables_in_scope(registry.registry_frame(spark, tables))
        .join(registry.row_counts(tables), TABLE_KEY)
        .join(widths, TABLE_KEY)
        .select(*TABLE_KEY, "table_type", "is_writable", "has_comment", "row_count", "columns")
        .orderBy(*TABLE_KEY)
    )


def estate_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Tables in scope of the estate: system schemas and internal backing tables left out."""
    return estate.inventory(spark, d).select(
        *TABLE_KEY, "table_type", "is_writable", "has_comment", "row_count", "size_bytes", "num_files",
        "fragmented", "last_read_at", "days_since_read", "never_read",
    )


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    """One-pass profile of all tables; `approx_distinct` checks its distinct counts against exact ones."""
    return profiling.profile_tables(lake.tables(spark, d), values=False).select(
        "table_schema", "table_name", "column_name", "ordinal_position", "row_count", "null_count",
        "null_ratio", "is_all_null", "is_constant",
    )


def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The sketch against the exact count, per column."""
    tables = lake.tables(spark, d)
    error = F.abs(F.col("distinct_count") - F.col("exact_distinct"))
    return (
        profiling.profile_tables(tables, values=False)
        .join(profiling.exact_distinct(tables), [*TABLE_KEY, "column_name"])
        .select(
            "table_schema", "table_name", "column_name",
            (error <= F.greatest(F.col("exact_distinct") * 0.2, F.lit(1))).alias("within_tolerance"),
        )
    )


def file_hygiene(spark: SparkSession, d: str) -> DataFrame:
    return registry.file_stats(spark, lake.tables(spark, d)).select(
        "table_schema", "table_name", "size_bytes", "num_files",
        registry.is_fragmented(F.col("num_files"), F.col("size_bytes")).alias("fragmented"),
    )


def file_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Which tables are fragmented, whatever the exact sizes of their files."""
    return file_hygiene(spark, d).select("table_schema", "table_name", "fragmented")


def lake_severities(spark: SparkSession, d: str) -> DataFrame:
    """What the audit of the lake finds: table, severity, finding."""
    return lake_findings(spark, d).select("table_key", "severity", "finding")


def merged_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct counts merged from stored sketches of four parts of each table, against exact ones."""
    tables = lake.tables(spark, d)
    sketches = profiling.union_all(
        [profiling.distinct_sketches([t], f"pmod(xxhash64({t.data.columns[0]}), 4)") for t in tables]
    )
    error = F.abs(F.col("distinct_count") - F.col("exact_distinct"))
    return (
        profiling.merged_distinct(cut(sketches))
        .join(profiling.exact_distinct(tables), [*TABLE_KEY, "column_name"])
        .select(
            "table_schema", "table_name", "column_name",
            (error <= F.greatest(F.col("exact_distinct") * 0.2, F.lit(1))).alias("within_tolerance"),
        )
    )


def lake_findings(spark: SparkSession, d: str) -> DataFrame:
    """The whole audit of the lake: scan, last reads, file hygiene, ranked findings."""
    tables = [*lake.tables(spark, d), lake.contacts(spark, d), lake.legacy_orders(spark, d)]
    log = lake.query_log(spark, d, layered=True)
    return audit.scan(spark, tables, log, lake.ASOF).findings()


def lake_health(spark: SparkSession, d: str) -> DataFrame:
    """Health score of the lake, from a full scan."""
    tables = [*lake.tables(spark, d), lake.contacts(spark, d), lake.legacy_orders(spark, d)]
    log = lake.query_log(spark, d, layered=True)
    scored = audit.scan(spark, tables, log, lake.ASOF).health_score()
    return _rounded(scored, *findings.WEIGHTS, "overall")


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(n, 6) for n in names})


def undocumented(spark: SparkSession, d: str) -> DataFrame:
    return findings.undocumented(estate.inventory(spark, d), estate.columns(spark, d), CATALOG_KEY)


def ownership(spark: SparkSession, d: str) -> DataFrame:
    return findings.ownership(registry.tables_in_scope(estate.registry(spark, d)))


# Personal data

def pii_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Name verdict of every estate column."""
    return estate.columns(spark, d).select("table_key", "column_name", "pii_by_name")


def pii_by_value(spark: SparkSession, d: str) -> DataFrame:
    """Value verdict of every text column, over all its values, in the profile's own pass."""
    tables = [*lake.tables(spark, d), lake.contacts(spark, d)]
    textual = registry.columns_frame(spark, tables).where(F.col("data_type") == "string")
    return (
        profiling.profile_tables(tables)
        .join(textual.select(*TABLE_KEY, "column_name"), [*TABLE_KEY, "column_name"], "left_semi")
        .select("table_name", "column_name", "pii_by_value")
    )


def pii_value_shares(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each text column obey each value rule."""
    tables = [*lake.tables(spark, d), lake.contacts(spark, d)]
    shares = profiling.match_shares(profiling.value_matches(tables))
    return shares.select("table_name", "column_name", "rule", "matches", "non_null", F.round("share", 9).alias("share"))


def pii_token_scan(spark: SparkSession, d: str) -> DataFrame:
    """Value rules on every word of every document."""
    words = explode_once(read(spark, d, "documents"), F.split("text", r"\s+"), "word", "lang")
    # Every rule needs an @ or a digit; the check is cheap and most words have neither.
    return (
        words.where(F.col("word").rlike("[@0-9]"))
        .withColumn("label", F.expr(pii.classify_value("word")))
        .where(F.col("label").isNotNull())
        .groupBy("lang", "label")
        .agg(F.count(F.lit(1)).alias("words"))
    )


def pii_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Effective label per flagged column, the name verdict first."""
    return (
        estate.columns(spark, d)
        .where("is_pii_candidate")
        .select("table_key", "column_name", suggest.pattern_label().alias("label"))
    )


def cpf_check(spark: SparkSession, d: str) -> DataFrame:
    """Check digits appended to order keys; final orders get a wrong last digit."""
    made = pii.cpf_with_check_digits("lpad(o_orderkey, 9, '0')")
    return (
        read(spark, d, "orders")
        .selectExpr("o_orderstatus", f"{made} AS made")
        .selectExpr(
            "o_orderstatus",
            "CASE WHEN o_orderstatus = 'F' THEN concat(left(made, 10), (int(right(made, 1)) + 1) % 10) ELSE made END AS cpf",
        )
        .groupBy("o_orderstatus", F.expr(pii.cpf_is_valid("cpf")).alias("is_valid"))
        .agg(F.count(F.lit(1)).alias("numbers"), F.min("cpf").alias("smallest"))
    )


def redacted_samples(spark: SparkSession, d: str) -> DataFrame:
    """Stored samples of the columns flagged by name or value, first five rows by key."""
    tables = {t.name: t for t in [*lake.tables(spark, d), lake.contacts(spark, d)]}
    picked = [
        ("customer", "c_custkey", ["c_name", "c_mktsegment"]),
        ("supplier", "s_suppkey", ["s_name"]),
        ("part", "p_partkey", ["p_name", "p_brand"]),
        ("nation", "n_nationkey", ["n_name"]),
        ("region", "r_regionkey", ["r_name"]),
        ("contacts", "c_custkey", ["contact", "line_no", "document_no", "nickname"]),
    ]
    samples = profiling.union_all(
        [profiling.column_samples(tables[name], key, columns) for name, key, columns in picked]
    )
    profile = profiling.with_pii(profiling.profile_tables([tables[name] for name, _, _ in picked]))
    return profiling.with_stored_samples(profile.join(samples.select(*TABLE_KEY, "column_name"), [*TABLE_KEY, "column_name"], "left_semi"), samples).select(
        "table_name", "column_name", "sample_values", "sample_redacted"
    )


def type_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """What the values of every text column of the lake read as, and of text copies of a price, a
    date, and a time."""
    texts = [
        ("price_text", "lineitem", F.col("l_extendedprice").cast("string")),
        ("date_text", "orders", F.col("o_orderdate").cast("date").cast("string")),
        ("time_text", "events", F.col("ts").cast("string")),
    ]
    tables = lake.tables(spark, d)
    tables += [registry.TableSource(lake.CATALOG, "raw", c, read(spark, d, t).select(v.alias(c))) for c, t, v in texts]
    checks = [
        profiling.castable_share(t, names)
        for t in tables
        if (names := [f.name for f in t.data.schema.fields if f.dataType.typeName() == "string"])
    ]
    return profiling.union_all(checks).drop(*TABLE_KEY[:2])


def dead_columns(spark: SparkSession, d: str) -> DataFrame:
    tables = [*lake.tables(spark, d), lake.contacts(spark, d), lake.legacy_orders(spark, d)]
    return findings.dead_columns(profiling.profile_tables(tables, values=False)).drop("table_catalog")


# Usage

def _raw_tables(spark: SparkSession) -> DataFrame:
    return registry.tables_in_scope(lake.raw_registry(spark))


def _lake_reads(spark: SparkSession, d: str) -> DataFrame:
    return usage.foreign_reads(lake.query_log(spark, d), lake.ASOF, [lake.CATALOG])


def last_read(spark: SparkSession, d: str) -> DataFrame:
    return usage.last_read_by_name(_lake_reads(spark, d), _raw_tables(spark)).select("table_name", "last_read_at")


def last_read_substring(spark: SparkSession, d: str) -> DataFrame:
    return usage.last_read_by_substring(_lake_reads(spark, d), _raw_tables(spark)).select("table_name", "last_read_at")


def orphan_tables(spark: SparkSession, d: str) -> DataFrame:
    tables = _raw_tables(spark)
    found = usage.last_read_by_name(_lake_reads(spark, d), tables)
    return (
        usage.with_last_read(tables, found, lake.ASOF)
        .where(usage.is_orphan())
        .select("table_name", "days_since_read", "never_read", usage.last_read_label().alias("last_read"))
    )


def _estate_reads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tables = registry.tables_in_scope(estate.registry(spark, d))
    reads = usage.foreign_reads(
        estate.query_log(spark, d), estate.ASOF, ["standard", "large", "small", "economy", "medium", "promo"]
    )
    return reads, tables


def estate_last_read(spark: SparkSession, d: str) -> DataFrame:
    """Last read of every estate table, from one statement per lineitem row."""
    return usage.last_read_by_name(*_estate_reads(spark, d)).select(*TABLE_KEY, "last_read_at")


def estate_last_read_substring(spark: SparkSession, d: str) -> DataFrame:
    return usage.last_read_by_substring(*_estate_reads(spark, d)).select(*TABLE_KEY, "last_read_at")


def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    return (
        usage.recent_activity(read(spark, d, "events"), "ts", datetime(2024, 1, 30))
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("events"))
    )


# Findings

def _overview(spark: SparkSession, d: str) -> DataFrame:
    columns = _portal(spark, d)
    return findings.table_overview(estate.inventory(spark, d), columns)


def _portal(spark: SparkSession, d: str) -> DataFrame:
    said = estate.suggestions(spark, d, by_table=True)
    return suggest.portal_columns(estate.columns(spark, d, by_table=True), said, said, suggest.provenance(said))


def findings_summary(spark: SparkSession, d: str) -> DataFrame:
    return findings.findings_summary(estate.inventory(spark, d), estate.columns(spark, d), CATALOG_KEY)


def findings_ranked(spark: SparkSession, d: str) -> DataFrame:
    return findings.findings_ranked(_overview(spark, d))


def audit_totals(spark: SparkSession, d: str) -> DataFrame:
    return findings.audit_totals(_overview(spark, d), CATALOG_KEY)


def health_score(spark: SparkSession, d: str) -> DataFrame:
    scored = findings.health_score(estate.inventory(spark, d), estate.columns(spark, d), CATALOG_KEY)
    return _rounded(scored, *findings.WEIGHTS, "overall")


def schema_coverage(spark: SparkSession, d: str) -> DataFrame:
    return findings.schema_coverage(
        findings.table_overview(estate.inventory(spark, d), estate.columns(spark, d).withColumn("is_pii", F.col("is_pii_candidate")))
    )


def storage_cost(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(
        findings.storage_cost(estate.inventory(spark, d), ["table_catalog", "table_schema"]),
        "monthly_usd", "usd_per_tb_month",
    )


def storage_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Readable size of every estate table, in both display forms."""
    size = F.col("size_bytes")
    return estate.inventory(spark, d).select(
        "table_key", text.human_bytes(size).alias("size"),
        text.human_bytes(F.col("num_files") * 7, whole_bytes=True).alias("small_size"),
    )


# Documentation

def tokenize(spark: SparkSession, d: str) -> DataFrame:
    """Words of all conversation turns and benchmark items, counted per kind."""
    kinds = read(spark, d, "conversations").select(F.col("role").alias("kind"), "text").unionByName(
        read(spark, d, "benchmark").select(F.lit("benchmark").alias("kind"), "text")
    )
    return (
        explode_once(kinds, text.tokenize(F.col("text")), "term", "kind")
        .groupBy("kind", "term")
        .agg(F.count(F.lit(1)).alias("uses"))
    )


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """Markdown sections of all documents, whole bodies."""
    return retrieval.chunk_documents(lake.planted_markdown(spark, d), ["doc_id", "system"])


def document_titles(spark: SparkSession, d: str) -> DataFrame:
    return lake.planted_markdown(spark, d).select(
        "doc_id",
        document_title(F.col("text"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))).alias("title"),
    )


def chunk_terms(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words, total words and the most used one per document.

    All words are counted, so documents are dealt once by id; their counts are summed in place."""
    return (
        retrieval.chunk_terms(lake.document_chunks(spark, d).repartition("chunk_id"))
        .groupBy("chunk_id", "length")
        .agg(
            F.count(F.lit(1)).alias("terms"),
            F.max(F.struct("tf", "term")).alias("top"),
        )
        .select("chunk_id", "length", "terms", F.col("top.tf").alias("top_tf"), F.col("top.term").alias("top_term"))
    )


def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    chunks = lake.document_chunks(spark, d)
    return _rounded(retrieval.document_frequency(retrieval.chunk_terms(chunks), chunks), "idf")


def source_mapping(spark: SparkSession, d: str) -> DataFrame:
    """First matching rule per estate table; unmapped tables are left out."""
    return (
        registry.tables_in_scope(estate.registry(spark, d))
        .select(*TABLE_KEY, system_for(F.concat_ws(".", "table_schema", "table_name"), estate.MAPPING).alias("system"))
        .where(F.col("system").isNotNull())
    )


def _benchmark_queries(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("system"),
        F.array_distinct(text.tokenize(F.col("text"))).alias("terms"),
    )


def tfidf_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Six best documents per benchmark item within its system."""
    ranked = retrieval.rank_chunks(_benchmark_queries(spark, d), lake.document_chunks(spark, d))
    return ranked.withColumn("score", F.round("score", 4))


def context_packing(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved context per benchmark item, packed to the budget."""
    packed = retrieval.retrieve(_benchmark_queries(spark, d), lake.document_chunks(spark, d))
    return packed.select(
        "query_id", "system", F.md5(F.col("context").cast("binary")).alias("context_md5"),
        F.length("context").alias("context_chars"),
        F.array_join("citations", "; ").alias("citations"),
        F.array_join("matched_terms", ", ").alias("matched_terms"),
    )


def table_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Vocabulary of every mapped estate table: its query against the documentation."""
    return retrieval.table_queries(
        registry.tables_in_scope(estate.registry(spark, d)), estate.columns(spark, d), estate.MAPPING
    ).select("query_id", "system", F.array_join(F.array_sort("terms"), " ").alias("terms"))


# Suggestions

def _scan(spark: SparkSession, d: str) -> DataFrame:
    scan_id = F.lit("s1").alias("scan_id")
    return suggest.load_scan(
        estate.columns(spark, d, by_table=True).drop("table_type", "is_writable").withColumn("scan_id", scan_id),
        registry.tables_in_scope(estate.registry(spark, d)).withColumn("scan_id", scan_id),
    )


def _grounding(spark: SparkSession, d: str) -> DataFrame:
    return estate.grounding(registry.tables_in_scope(estate.registry(spark, d)))


def scan_load(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d).select(
        *TABLE_KEY, "column_name", "data_type", "row_count", "null_count", "distinct_count",
        suggest.pattern_label().alias("regex_label"), "has_comment", "table_type", "is_writable", "table_has_comment",
    )


def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    """One prompt per estate table, flagged values withheld, documentation where mapped."""
    prompts = suggest.prompts(estate.with_samples(_scan(spark, d)), _grounding(spark, d))
    return prompts.select(
        *TABLE_KEY, F.length("prompt").alias("chars"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5")
    )


def suggestion_ingest(spark: SparkSession, d: str) -> DataFrame:
    said = suggest.ingest(_scan(spark, d), estate.responses(spark, d), _grounding(spark, d), apply=True)
    return said.withColumns(
        {
            "doc_citations": F.array_join("doc_citations", "; "),
            "doc_matched_terms": F.array_join("doc_matched_terms", ", "),
        }
    )


def wrong_type_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns whose type the model calls wrong."""
    return suggest.wrong_types(suggest.ingest(_scan(spark, d), estate.responses(spark, d)))


def table_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return suggest.table_descriptions(
        registry.tables_in_scope(estate.registry(spark, d)), estate.responses(spark, d), apply=True
    )


def pii_agreement(spark: SparkSession, d: str) -> DataFrame:
    said = suggest.ingest(_scan(spark, d), estate.responses(spark, d))
    return suggest.pii_agreement(said, CATALOG_KEY)


def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Two verdicts on documents: value rules on the text against the given toxic label."""
    has_contact = F.expr(f"exists(split(text, r'\\s+'), w -> {pii.is_email('w')} OR {pii.is_phone('w')})")
    return (
        read(spark, d, "documents")
        .join(read(spark, d, "labels"), "doc_id")
        .select(
            "lang",
            suggest.agreement(F.when(has_contact, "contact"), F.when(F.col("toxic") == 1, "toxic").otherwise("none")).alias("agreement"),
        )
        .groupBy("lang", "agreement")
        .agg(F.count(F.lit(1)).alias("documents"))
    )


def pii_comparison(spark: SparkSession, d: str) -> DataFrame:
    return suggest.pii_comparison(estate.columns(spark, d), estate.suggestions(spark, d))


def portal_columns(spark: SparkSession, d: str) -> DataFrame:
    return _portal(spark, d).select(
        "table_key", "column_name", "comment_pt", "doc_system", "is_pii", F.array_join("pii_labels", ", ").alias("pii_labels")
    )


def portal_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables as a reader sees them, from what a run stores."""
    tables = registry.tables_in_scope(estate.registry(spark, d))
    said = suggest.ingest(_scan(spark, d), estate.responses(spark, d), _grounding(spark, d))
    grounded = suggest.provenance(said)
    columns = suggest.portal_columns(estate.columns(spark, d, by_table=True), said, said, grounded)
    return suggest.portal_tables(tables, columns, suggest.table_descriptions(tables, estate.responses(spark, d)), grounded).select(
        *TABLE_KEY, "comment_pt", "doc_system", F.array_join("passages", " | ").alias("passages"), "pii_count", "dead_count"
    )


def comment_statements(spark: SparkSession, d: str) -> DataFrame:
    return suggest.comment_statements(
        _scan(spark, d), registry.tables_in_scope(estate.registry(spark, d)), estate.responses(spark, d)
    ).select(*TABLE_KEY, "statement", "is_writable")


def provenance(spark: SparkSession, d: str) -> DataFrame:
    return suggest.provenance(estate.suggestions(spark, d, by_table=True)).select(
        *TABLE_KEY, "doc_system", F.array_join("passages", " | ").alias("passages")
    )


def doc_usage(spark: SparkSession, d: str) -> DataFrame:
    """Sources with the title of their first document and the tables grounded in them."""
    titled = lake.planted_markdown(spark, d).select(
        F.col("system").alias("doc_id"), F.col("doc_id").alias("number"), document_title(F.col("text"), F.col("system")).alias("title")
    )
    documents = titled.groupBy("doc_id").agg(F.min_by("title", "number").alias("title"))
    return suggest.doc_usage(documents, _grounding(spark, d).withColumnRenamed("system", "doc_system"))


# Runs

def _event_runs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(
        F.col("event_type").alias("store"), F.col("ts").alias("started_at"), F.col("event_id").alias("run_id")
    )


def latest_run(spark: SparkSession, d: str) -> DataFrame:
    """Newest and second newest run per store."""
    ranked = [
        runs.nth_latest(_event_runs(spark, d), ["store"], "run_id", n).withColumn("back", F.lit(n)) for n in (0, 1)
    ]
    return reduce(DataFrame.unionByName, ranked)


def run_diff(spark: SparkSession, d: str) -> DataFrame:
    grounded = estate.suggestions(spark, d, by_table=True)
    plain = grounded.where(F.col("line_hi") < 6).withColumn(
        "suggested_comment",
        F.when(F.col("line_lo") == 1, "plain | text").otherwise(F.concat(F.lit(" "), "suggested_comment")),
    )
    return runs.diff(grounded, plain)


def run_counters(spark: SparkSession, d: str) -> DataFrame:
    """Tables processed and grounded, columns documented, and comments staged per catalog."""
    said = suggest.ingest(_scan(spark, d), estate.responses(spark, d), _grounding(spark, d))
    statements = suggest.comment_statements(
        _scan(spark, d), registry.tables_in_scope(estate.registry(spark, d)), estate.responses(spark, d)
    )
    return runs.counters(said, statements, CATALOG_KEY)


def before_after_score(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the scan before and after comments were written, per catalog."""
    catalog = F.col("table_catalog")
    scans = registry.tables_in_scope(estate.registry(spark, d)).select(catalog.alias("catalog")).distinct()

    def stamped(rows: DataFrame, when: str) -> DataFrame:
        return rows.withColumn("scan_id", F.concat(F.lit(when + "_"), catalog))

    tables, columns = estate.inventory(spark, d), estate.columns(spark, d)
    written = F.col("has_comment") | F.col("is_writable")
    inventory = stamped(tables, "before").unionByName(stamped(tables.withColumn("has_comment", written), "after"))
    profile = stamped(columns, "before").unionByName(stamped(columns.withColumn("has_comment", written), "after"))
    history = scans.select("catalog", F.explode(F.array(F.lit("before"), F.lit("after"))).alias("when")).select(
        "catalog", F.concat_ws("_", "when", "catalog").alias("scan_id"),
        F.when(F.col("when") == "before", moment(datetime(2001, 11, 1))).otherwise(moment(datetime(2001, 11, 10)))
        .alias("started_at"),
    )
    # Three runs per catalog: the one that wrote, a rerun that had nothing to write, and for
    # one catalog a later writing run on the newest scan.
    late = F.col("catalog") == "promo"
    made = scans.select(
        "catalog",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(run).alias("run_id"),
                        F.concat(F.lit(scan + "_"), F.col("catalog")).alias("scan_id"),
                        F.lit(day).alias("day"),
                        documented.alias("columns_documented"),
                    )
                    for run, scan, day, documented in (
                        ("r1", "before", 1, F.lit(5)),
                        ("r2", "after", 2, F.lit(0)),
                        ("r3", "after", 3, F.when(late, 4).otherwise(0)),
                    )
                ]
            )
        ),
    ).select(
        "catalog", "run_id", "scan_id", "columns_documented", F.lit(True).alias("applied"),
        F.make_timestamp_ntz(F.lit(2001), F.lit(11), F.col("day"), F.lit(0), F.lit(0), F.lit(0)).alias("started_at"),
    )
    return runs.before_after(made, history, findings.health_score(inventory, profile, ["scan_id"]))


def run_cost(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation as a model run: user words in, assistant words out."""
    words = F.size(F.split("text", r"\s+")).cast("long")
    turns = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("run_id")).agg(
        F.coalesce(F.sum(F.when(F.col("role") == "user", words)), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(F.when(F.col("role") == "assistant", words)), F.lit(0)).alias("completion_tokens"),
        F.count_if(F.col("role") == "assistant").alias("columns_documented"),
        F.max("turn").alias("last_turn"),
    )
    started = F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    run = turns.select(
        "*",
        started.alias("started_at"),
        (started + F.make_dt_interval(secs=F.col("prompt_tokens"))).alias("finished_at"),
        F.when(F.col("last_turn") == 1, "").when(F.col("last_turn") == 2, "n/a").otherwise("0.15").alias("price_in"),
        F.lit("0.60").alias("price_out"),
    )
    return runs.run_cost(run).select(
        "run_id", "prompt_tokens", "completion_tokens", "columns_documented", "seconds",
        F.round("est_cost_usd", 12).alias("est_cost_usd"), F.round("usd_per_comment", 12).alias("usd_per_comment"),
    )


# Search

def _searches(spark: SparkSession, d: str) -> DataFrame:
    """What people look for: every kind of part, and the personal data its tables hold."""
    return read(spark, d, "part").select(F.col("p_name").alias("query_id")).distinct().withColumn(
        "query", F.concat_ws(" ", F.lit("which email columns hold the"), "query_id")
    )


def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    found = search.search_columns(_searches(spark, d), estate.search_fields(spark, d))
    return found.withColumn("score", F.round("score", 4))


def document_search(spark: SparkSession, d: str) -> DataFrame:
    """Two best web pages per benchmark item, tags stripped."""
    queries = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    pages = read(spark, d, "pages").select(F.col("page_id").alias("doc_id"), text.strip_tags(F.col("html")).alias("text"))
    found = search.search_documents(queries, pages, estate.search_fields(spark, d))
    return found.withColumn("score", F.round("score", 4))


def facets(spark: SparkSession, d: str) -> DataFrame:
    return search.facets(_portal(spark, d), estate.inventory(spark, d))


def name_filter(spark: SparkSession, d: str) -> DataFrame:
    return search.filter_by_name(
        estate.inventory(spark, d).select("table_key", "row_count"), estate.columns(spark, d), "Email_1"
    )


def localized_text(spark: SparkSession, d: str) -> DataFrame:
    """Column text as a Portuguese and as an English reader gets it."""
    portal = _portal(spark, d)
    return portal.select(
        "table_key", "column_name",
        text.localized(F.col("column_comment"), F.col("comment_pt"), F.lit("pt")).alias("text_pt"),
        text.localized(F.col("column_comment"), F.col("comment_pt"), F.lit("en")).alias("text_en"),
    )


# Meta tables and rollups

def meta_evolution(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions stored before and after provenance columns were added."""
    said = estate.suggestions(spark, d).select("table_key", "column_name", "suggested_comment", "doc_system", "table_type")
    older = said.where(F.col("table_type") == "MANAGED").select("table_key", "column_name", "suggested_comment")
    newer = said.where(F.col("table_type") != "MANAGED").select("table_key", "column_name", "suggested_comment", "doc_system")
    return store.union_evolved(older, newer)


def curated_filter(spark: SparkSession, d: str) -> DataFrame:
    return rollups.curated(
        read(spark, d, "orders"), F.col("o_orderstatus") == "F",
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"],
    )


def _order_months(spark: SparkSession, d: str) -> DataFrame:
    return rollups.monthly_rollup(
        read(spark, d, "orders"), F.col("o_orderdate"), F.col("o_totalprice").cast("string")
    )


def monthly_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _order_months(spark, d)


def top_months(spark: SparkSession, d: str) -> DataFrame:
    return rollups.top_months(_order_months(spark, d))


def avg_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rollups.average_by(read(spark, d, "customer"), "c_mktsegment", F.col("c_acctbal"))


def join_agg(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return rollups.joined_amounts(
        read(spark, d, "lineitem").select("l_orderkey", "l_extendedprice"), orders,
        F.col("l_orderkey") == F.col("o_orderkey"), "o_orderpriority", F.col("l_extendedprice").cast("string"),
    )


def top_groups(spark: SparkSession, d: str) -> DataFrame:
    return rollups.top_groups(read(spark, d, "orders"), "o_custkey")


QUERIES = {
    f.__name__: f
    for f in [
        table_inventory, estate_inventory, column_profile, approx_distinct, file_hygiene, lake_findings,
        lake_health, undocumented, ownership, pii_by_name, pii_by_value, pii_token_scan, pii_candidates,
        cpf_check, redacted_samples, type_mismatch, dead_columns, last_read, last_read_substring,
        orphan_tables, estate_last_read, estate_last_read_substring, recent_activity, findings_summary,
        findings_ranked, audit_totals, health_score, schema_coverage, storage_cost, storage_sizes,
        tokenize, chunk_documents, document_titles, chunk_terms, doc_frequency, source_mapping,
        tfidf_retrieval, context_packing, table_grounding, scan_load, prompt_build, suggestion_ingest,
        table_descriptions, pii_agreement, label_agreement, pii_comparison, portal_columns, portal_tables,
        comment_statements, provenance, doc_usage, latest_run, run_diff, run_counters,
        before_after_score, run_cost, catalog_search, document_search, facets, name_filter,
        localized_text, meta_evolution, curated_filter, monthly_rollup, top_months, avg_by_group,
        join_agg, top_groups, file_fragments, lake_severities, merged_distinct, pii_value_shares, wrong_type_columns,
    ]
}

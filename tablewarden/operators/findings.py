"""Health score, findings, coverage and costs over inventory and profile frames.

Both frames come in long form and are only ever aggregated: conditional counts with
partial aggregation, one exchange on the (few) group keys. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import human_bytes, plural
from .profile import TABLE_KEY
from .usage import ORPHAN_DAYS, is_orphan

# Weights of the score and the modelled storage price.
WEIGHTS = {
    "documentation": 0.30,
    "pii_governance": 0.25,
    "freshness": 0.20,
    "column_quality": 0.15,
    "delta_hygiene": 0.10,
}
STORAGE_PRICE_PER_GB_MONTH = 0.023
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2}
# The texts of findings.
SUMMARY_TEXTS = {
    "pii": ("High", "Personal data columns with no documentation or tag"),
    "orphans": ("Medium", f"Tables never read in {ORPHAN_DAYS} days"),
    "tables": ("Medium", "Undocumented tables"),
    "columns": ("Low", "Undocumented columns"),
    "dead": ("Low", "Dead columns (all null or single-valued)"),
    "fragmented": ("Low", "Fragmented tables (never optimised)"),
}
PII_COLUMN, PII_WHY = "personal-data column", "needs a masking policy and a retention decision"
NEVER_READ, NEVER_READ_WHY = "never read", " nobody has queried"
DEAD_COLUMN, DEAD_WHY = "dead column", "always null or a single repeated value"
FRAGMENTED, FRAGMENTED_WHY = "fragmented", " files for "
SERVICE_PRINCIPAL = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def is_dead() -> Column:
    return F.col("is_all_null") | F.col("is_constant")


def dead_columns(profile: DataFrame) -> DataFrame:
    return profile.where(is_dead()).select(
        *TABLE_KEY,
        "column_name",
        F.when(F.col("is_all_null"), "100% null").otherwise("single value across all rows").alias("problem"),
    )


def measures(inventory: DataFrame, profile: DataFrame, keys: list[str]) -> DataFrame:
    """Counts behind score and summary, one row per key, from one pass over each frame."""
    table_counts = {
        "n_tables": F.count(F.lit(1)),
        "documented_tables": F.count_if("has_comment"),
        "orphans": F.count_if(is_orphan()),
        "fragmented_tables": F.count_if("fragmented"),
    }
    column_counts = {
        "n_columns": F.count(F.lit(1)),
        "documented_columns": F.count_if("has_comment"),
        "pii_columns": F.count_if("is_pii_candidate"),
        "pii_documented": F.count_if(F.col("is_pii_candidate") & F.col("has_comment")),
        "dead": F.count_if(is_dead()),
    }
    of_tables = inventory.groupBy(*keys).agg(*[c.alias(n) for n, c in table_counts.items()])
    of_columns = profile.groupBy(*keys).agg(*[c.alias(n) for n, c in column_counts.items()])
    return (
        of_tables.unionByName(of_columns, allowMissingColumns=True)
        .groupBy(*keys)
        .agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in [*table_counts, *column_counts]])
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 1.0).otherwise(F.try_divide(part, whole))


def health_score(inventory: DataFrame, profile: DataFrame, keys: list[str]) -> DataFrame:
    """Five pass rates and their weighted sum per key. Nothing to check counts as passed."""
    counts = measures(inventory, profile, keys)
    c = F.col
    parts = {
        "documentation": _share(
            c("documented_columns") + c("documented_tables"), c("n_columns") + c("n_tables")
        ),
        "pii_governance": _share(c("pii_documented"), c("pii_columns")),
        "freshness": _share(c("n_tables") - c("orphans"), c("n_tables")),
        "column_quality": _share(c("n_columns") - c("dead"), c("n_columns")),
        "delta_hygiene": _share(c("n_tables") - c("fragmented_tables"), c("n_tables")),
    }
    overall = sum((F.col(name) * weight for name, weight in WEIGHTS.items()), F.lit(0.0))
    return (
        counts.select(*keys, *[rate.alias(name) for name, rate in parts.items()])
        .withColumn("overall", overall)
        .withColumn("score", F.bround(F.col("overall") * 100).cast("int"))
    )


def findings_summary(inventory: DataFrame, profile: DataFrame, keys: list[str]) -> DataFrame:
    """Number of findings of each kind: (keys, position, severity, finding, findings)."""
    c = F.col
    kinds = [
        (*SUMMARY_TEXTS["pii"], c("pii_columns") - c("pii_documented")),
        (*SUMMARY_TEXTS["orphans"], c("orphans")),
        (*SUMMARY_TEXTS["tables"], c("n_tables") - c("documented_tables")),
        (*SUMMARY_TEXTS["columns"], c("n_columns") - c("documented_columns")),
        (*SUMMARY_TEXTS["dead"], c("dead")),
        (*SUMMARY_TEXTS["fragmented"], c("fragmented_tables")),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"), F.lit(severity).alias("severity"),
                F.lit(finding).alias("finding"), count.alias("findings"),
            )
            for i, (severity, finding, count) in enumerate(kinds, start=1)
        ]
    )
    return measures(inventory, profile, keys).select(*keys, F.inline(rows))


def table_overview(inventory: DataFrame, columns: DataFrame) -> DataFrame:
    """Inventory with per-table column counts; tables without columns are kept with zeros."""
    counts = columns.groupBy(*TABLE_KEY).agg(
        F.count(F.lit(1)).alias("column_count"),
        F.count_if("has_comment").alias("documented_count"),
        F.count_if("is_pii").alias("pii_count"),
        F.count_if(is_dead()).alias("dead_count"),
    )
    return inventory.join(counts, TABLE_KEY, "left").na.fill(
        0, ["column_count", "documented_count", "pii_count", "dead_count"]
    )


def findings_ranked(overview: DataFrame) -> DataFrame:
    """What each table obliges someone to do, most serious first."""
    c = F.col

    def finding(applies: Column, severity: str, what: Column, why: Column) -> Column:
        return F.when(
            applies,
            F.struct(
                F.lit(SEVERITY_RANK[severity]).alias("severity_rank"),
                F.lit(severity).alias("severity"),
                what.alias("finding"),
                why.alias("why"),
            ),
        )

    size = human_bytes(c("size_bytes"), whole_bytes=True)
    found = F.array(
        finding(c("pii_count") > 0, "high", plural(c("pii_count"), PII_COLUMN), F.lit(PII_WHY)),
        finding(is_orphan(), "medium", F.lit(NEVER_READ), F.concat(size, F.lit(NEVER_READ_WHY))),
        finding(c("dead_count") > 0, "low", plural(c("dead_count"), DEAD_COLUMN), F.lit(DEAD_WHY)),
        finding(c("fragmented"), "low", F.lit(FRAGMENTED), F.concat(c("num_files").cast("string"), F.lit(FRAGMENTED_WHY), size)),
    )
    return (
        overview.select(
            F.concat_ws(".", *TABLE_KEY).alias("table_key"),
            F.inline(F.filter(found, lambda item: item.isNotNull())),
        )
        .orderBy("severity_rank", "table_key", "finding")
    )


def schema_coverage(overview: DataFrame) -> DataFrame:
    """Documented share per schema, widest schema first."""
    return (
        overview.groupBy("table_catalog", "table_schema")
        .agg(
            F.count(F.lit(1)).alias("tables"),
            F.sum("column_count").alias("columns"),
            F.sum("documented_count").alias("documented"),
        )
        .withColumn(
            "percent",
            F.when(F.col("columns") == 0, 0)
            .otherwise(F.floor(F.try_divide(F.col("documented") * 100, F.col("columns")) + 0.5))
            .cast("int"),
        )
        .orderBy(F.col("columns").desc(), "table_catalog", "table_schema")
    )


def audit_totals(overview: DataFrame, keys: list[str]) -> DataFrame:
    return overview.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tables"),
        F.sum("column_count").alias("columns"),
        F.sum("documented_count").alias("documented"),
        F.sum("pii_count").alias("pii_columns"),
        F.count_if(is_orphan()).alias("orphans"),
        F.sum("dead_count").alias("dead"),
        F.count_if("fragmented").alias("fragmented"),
    )


def storage_cost(inventory: DataFrame, keys: list[str], price: float = STORAGE_PRICE_PER_GB_MONTH) -> DataFrame:
    """Bytes held by orphan tables and what they cost a month at list price."""
    return (
        inventory.where(is_orphan())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("orphans"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))
        .withColumn("total_size", human_bytes(F.col("total_bytes")))
        .withColumn("monthly_usd", F.col("total_bytes") / F.lit(float(1 << 30)) * price)
        .withColumn("usd_per_tb_month", F.lit(1024 * price))
    )


def undocumented(inventory: DataFrame, profile: DataFrame, keys: list[str]) -> DataFrame:
    return measures(inventory, profile, keys).select(
        *keys,
        (F.col("n_tables") - F.col("documented_tables")).alias("undocumented_tables"),
        (F.col("n_columns") - F.col("documented_columns")).alias("undocumented_columns"),
        (F.col("pii_columns") - F.col("pii_documented")).alias("undocumented_pii"),
    )


def ownership(tables: DataFrame) -> DataFrame:
    """Tables nobody can be asked about: no owner, or a service principal."""
    owner = F.col("table_owner")
    return tables.select(
        *TABLE_KEY,
        F.when(owner.isNull(), "no owner")
        .when(owner.rlike(SERVICE_PRINCIPAL), "service principal")
        .alias("problem"),
    ).where(F.col("problem").isNotNull())

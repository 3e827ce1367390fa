"""A derived estate: a large catalog whose metadata grows with the given tables.

Every part is one table, every (part, supplier) pair of lineitem is one of its columns, and
returned lines are reads. This gives the metadata operators (scores, findings, coverage,
prompts, search, diffs) inputs of realistic shape whose size follows the data.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.moments import moment, whole_days_between
from ..functions.pii import classify_by_name, sample_text
from ..functions.text import is_filled, split_packed
from ..operators.profile import TABLE_KEY
from ..operators.usage import MARKER
from ..sources.documents import system_for
from ..sources.registry import is_fragmented, stored_bytes, tables_in_scope
from .lake import read

ASOF = datetime(2001, 11, 10)
# Stored bytes of lineitem whose columns one task holds, so that its memory does not grow with the estate.
TASK_BYTES = 4 << 20
# Column name stem, type, label the model gives.
COLUMN_KINDS = [
    ("name_", "string", "person_name"),
    ("email_", "string", "email"),
    ("cpf-", "string", "national_id"),
    ("dt_nascimento_", "date", "birth_date"),
    ("ip_address_", "string", "network_id"),
    ("valor_", "double", "none"),
    ("status_", "string", "none"),
    ("phone_", "string", "phone"),
    ("queueId", "string", "none"),
    ("endereco_", "string", "address"),
    ("tAcw", "bigint", "none"),
    ("nota_", "string", "none"),
]
MAPPING = [
    ("brand_1.small*", "src0"),
    ("brand_1.*", "src1"),
    ("brand_1*.*", "src2"),
    ("brand_2*", "src3"),
    ("*bolt*", "src4"),
]


def registry(spark: SparkSession, directory: str) -> DataFrame:
    size, price, name = F.col("p_size"), F.col("p_retailprice"), F.col("p_name")
    key = F.col("p_partkey").cast("string")
    digest = F.md5(key.cast("binary"))
    principal = F.concat_ws(
        "-", *[F.substring(digest, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )
    return read(spark, directory, "part").select(
        F.lower("p_type").alias("table_catalog"),
        F.when(size == 1, "meta").otherwise(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))).alias("table_schema"),
        F.when(size == 2, F.concat(F.lit("__materialization_mat_"), key))
        .when(size == 3, F.concat(F.lit("event_log_"), F.left(digest, F.lit(8))))
        .otherwise(F.concat(F.replace(name, F.lit(" "), F.lit("_")), F.lit("_"), key)).alias("table_name"),
        F.when(size <= 20, "MANAGED").when(size <= 30, "EXTERNAL").when(size <= 40, "VIEW")
        .otherwise("STREAMING_TABLE").alias("table_type"),
        F.when(size.between(10, 14), principal)
        .when(~size.between(5, 9), F.concat(F.lower("p_type"), F.lit("@example.com"))).alias("table_owner"),
        F.when(price >= 950, F.concat(F.lit("Stock of "), name, F.lit("s")))
        .when(price >= 940, " ").when(price >= 925, "").alias("table_comment"),
        "p_partkey", "p_name", "p_brand", "p_size",
    )


def _scoped(spark: SparkSession, directory: str) -> DataFrame:
    return tables_in_scope(registry(spark, directory))


def inventory(spark: SparkSession, directory: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    read_at = F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))
    lines = (
        read(spark, directory, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            (F.sum(cents) * 10).alias("size_bytes"),
            F.max(read_at).alias("latest"),
        )
    )
    return (
        _scoped(spark, directory)
        .join(lines, "p_partkey", "left")
        .withColumn("num_files", F.col("p_size").cast("long") * 4)
        .withColumn("fragmented", is_fragmented(F.col("num_files"), F.col("size_bytes")))
        .withColumn("last_read_at", F.when(F.col("p_size") < 46, F.col("latest")))
        .withColumn("days_since_read", whole_days_between(F.col("last_read_at"), moment(ASOF)))
        .withColumn("never_read", F.col("last_read_at").isNull())
        .withColumn("table_key", F.concat_ws(".", *TABLE_KEY))
        .drop("latest")
    )


def _kind(part: int) -> Column:
    return F.element_at(
        F.array(*[F.lit(kind[part]) for kind in COLUMN_KINDS]),
        (F.col("l_suppkey") % len(COLUMN_KINDS)).cast("int") + 1,
    )


def _dealt(rows: DataFrame, directory: str, *key: str) -> DataFrame:
    """Rows of equal keys side by side, in more tasks than usual where lineitem is large.

    The number is always given, so that frames dealt alike stay so."""
    spark = rows.sparkSession
    tasks = stored_bytes(spark, f"{directory}/lineitem.parquet") // TASK_BYTES
    return rows.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *key)


def columns(spark: SparkSession, directory: str, by_table: bool = False, described: DataFrame | None = None) -> DataFrame:
    """Profile rows, with the line bounds that texts and labels are derived from.

    Lines are dealt by part, so that they are shuffled once for the pairs and for the join. The registry is as
    long as the estate and is not broadcast. `by_table` deals what texts are derived from, which is narrower than
    the texts, by table: what groups or joins columns by table, or by table and name, finds them in place.
    `described` tables add what they say to the columns of each of them, by a join of tables.
    """
    quantity = F.col("l_quantity").cast("long")
    lines = read(spark, directory, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    pairs = (
        _dealt(lines, directory, "l_partkey")
        .groupBy(F.col("l_partkey").alias("p_partkey"), "l_suppkey")
        .agg(
            F.sum(quantity).alias("row_count"),
            F.coalesce(F.sum(F.when(F.col("l_discount") >= 0.09, quantity)), F.lit(0)).alias("null_count"),
            F.min("l_linenumber").alias("line_lo"),
            F.max("l_linenumber").alias("line_hi"),
            F.max("l_tax").alias("tax_hi"),
        )
    )
    all_null = F.col("null_count") == F.col("row_count")
    tables = _scoped(spark, directory).select("p_partkey", "p_name", "p_brand", "p_size", "table_type", "is_writable", *TABLE_KEY)
    if described is not None:
        tables = tables.join(described, TABLE_KEY)
    found = tables.hint("merge").join(pairs, "p_partkey")
    return (
        (_dealt(found, directory, *TABLE_KEY) if by_table else found)
        .withColumn("column_name", F.concat(_kind(0), F.col("l_suppkey").cast("string")))
        .withColumn("ordinal_position", (F.col("l_suppkey") + 1).cast("int"))
        .withColumn("data_type", _kind(1))
        .withColumn(
            "column_comment",
            F.when(F.col("line_lo") > 5, F.concat_ws(" ", F.lit("Column"), "column_name", F.lit("of"), "p_name"))
            .when(F.col("line_lo") == 5, " ").when(F.col("line_lo") == 4, ""),
        )
        .withColumn("has_comment", is_filled(F.col("column_comment")))
        .withColumn("null_ratio", F.try_divide("null_count", "row_count"))
        .withColumn("distinct_count", F.when(all_null, 0).otherwise(F.col("line_hi")).cast("long"))
        .withColumn("is_all_null", all_null)
        .withColumn("is_constant", F.col("distinct_count") == 1)
        .withColumn("pii_by_name", classify_by_name(F.col("column_name")))
        .withColumn("pii_by_value", F.when((F.col("data_type") == "string") & (F.col("tax_hi") >= 0.08), "email"))
        .withColumn("is_pii_candidate", F.col("pii_by_name").isNotNull() | F.col("pii_by_value").isNotNull())
        .withColumn("table_key", F.concat_ws(".", *TABLE_KEY))
    )


def with_samples(profile: DataFrame) -> DataFrame:
    samples = F.array(
        F.concat(F.lit("v"), F.col("row_count").cast("string")),
        F.lit(None).cast("string"),
        F.concat(F.lit("x"), F.col("line_hi").cast("string")),
    )
    return profile.withColumn("sample_values", sample_text(samples, F.col("is_pii_candidate")))


def model_label() -> Column:
    return F.when(F.col("line_hi") == 2, "none").when(F.col("line_hi") == 3, "other_pii").otherwise(_kind(2))


def described() -> Column:
    return F.when(F.col("line_hi") == 4, "").otherwise(
        F.concat(F.lit("It's the "), F.col("column_name"), F.lit(" of "), F.col("p_name"))
    )


def responses(spark: SparkSession, directory: str) -> DataFrame:
    """One model response per table, as JSON text.

    Each column is answered twice, the second answer being the right one, and every table
    gets one column that it does not have.
    """
    def answer(name: Column, description: Column, pt: Column, pii: Column, wrong: Column, cited: Column) -> Column:
        return F.struct(
            name.alias("name"), description.alias("description"), pt.alias("description_pt"),
            pii.alias("pii"), wrong.alias("type_looks_wrong"), cited.alias("grounded_in_docs"),
        )

    no, nothing = F.lit(False), F.lit(None).cast("string")
    stale = answer(F.col("column_name"), F.lit("stale"), nothing, F.lit("other_pii"), no, no)
    right = answer(
        F.col("column_name"), described(),
        F.when(F.col("line_lo") >= 3, F.concat(F.lit("Coluna "), F.col("column_name"))),
        model_label(), F.col("line_hi") == 7, F.col("line_lo") <= 2,
    )
    ghost = answer(F.lit("ghost"), F.lit("Not in this table"), nothing, F.lit("email"), no, no)
    text = F.when(F.col("p_size") <= 30, F.concat(F.lit(" All "), F.col("p_name"), F.lit("s \\ 'x' "))).otherwise("")
    return (
        columns(spark, directory, by_table=True)
        .groupBy(*TABLE_KEY, text.alias("table_description"))
        .agg(F.flatten(F.collect_list(F.array(stale, right))).alias("answers"))
        .select(
            *TABLE_KEY,
            F.to_json(
                F.struct("table_description", F.array_append("answers", ghost).alias("columns"))
            ).alias("response"),
        )
    )


def grounding(tables: DataFrame) -> DataFrame:
    """Documentation system of each mapped table, with citations and matched terms."""
    system = system_for(F.concat_ws(".", "table_schema", "table_name"), MAPPING)
    return (
        tables.select(*TABLE_KEY, "p_brand", "p_name", system.alias("system"))
        .where(F.col("system").isNotNull())
        .select(
            *TABLE_KEY,
            "system",
            F.concat(F.lit("## "), F.col("p_name"), F.lit("\nMade by "), F.col("p_brand")).alias("context"),
            F.array(
                F.concat_ws(": ", "system", "p_brand"), F.concat_ws(": ", "system", "p_name")
            ).alias("citations"),
            F.split("p_name", " ").alias("matched_terms"),
        )
    )


def suggestions(spark: SparkSession, directory: str, by_table: bool = False) -> DataFrame:
    """Suggestions as they are stored; the packed citations of display rows are split here."""
    system = system_for(F.concat_ws(".", "table_schema", "table_name"), MAPPING)
    cited = F.concat(
        F.col("doc_system"), F.lit(": "), F.col("p_brand"), F.lit(";  ; "), F.col("doc_system"), F.lit(": "), F.col("p_name")
    )
    return (
        columns(spark, directory, by_table)
        .withColumn("doc_system", system)
        .withColumn("doc_citations", F.when(F.col("line_lo") <= 2, split_packed(cited)))
        .withColumn("suggested_comment", described())
        .withColumn("suggested_comment_pt", F.when(F.col("line_lo") >= 3, F.concat(F.lit("Coluna "), F.col("column_name"))))
        .withColumn("pii_by_llm", model_label())
        .withColumn("values_withheld", F.col("is_pii_candidate"))
    )


def query_log(spark: SparkSession, directory: str) -> DataFrame:
    """Every line is a statement on the table of its part."""
    tables = registry(spark, directory).select(
        F.col("p_partkey").alias("l_partkey"), "p_size", F.concat_ws("`.`", *TABLE_KEY).alias("quoted"),
        F.concat_ws(".", "table_schema", "table_name").alias("plain"),
    )
    name = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("`"), F.col("quoted"), F.lit("`"))).otherwise(F.upper("plain"))
    marker = F.when(F.col("p_size") >= 46, f"/* {MARKER} */ ").otherwise("")
    return (
        read(spark, directory, "lineitem")
        .join(tables, "l_partkey")
        .select(
            F.col("l_shipdate").alias("start_time"),
            F.when(F.col("l_returnflag") == "N", "UPDATE").otherwise("SELECT").alias("statement_type"),
            F.concat(
                marker, F.lit("SELECT count(*) FROM "), name, F.lit(" x WHERE x.used > "),
                F.col("l_linenumber").cast("string"), F.lit(" -- "), F.lower("l_returnflag"),
                F.lit(" standard large small economy medium promo"),
            ).alias("statement_text"),
        )
    )


def search_fields(spark: SparkSession, directory: str) -> DataFrame:
    """Columns with everything search reads about them."""
    from ..operators.search import search_text

    labels = F.filter(F.array("pii_by_name", "pii_by_value"), lambda label: label.isNotNull())
    described_tables = _scoped(spark, directory).select(*TABLE_KEY, "table_comment")
    return (
        columns(spark, directory, described=described_tables)
        .select(
            "table_key",
            F.col("ordinal_position").alias("ordinal"),
            "column_name",
            search_text(F.col("table_key"), F.col("column_name"), F.col("column_comment"), labels).alias("text"),
            F.lower(F.coalesce("table_comment", F.lit(""))).alias("table_text"),
        )
    )

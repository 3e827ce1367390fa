"""Runs: which one is current, what changed between two, what one cost, before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lookup import looked_up
from ..functions.moments import seconds_between
from ..functions.text import is_filled, markdown_cell, strip
from .profile import TABLE_KEY


def nth_latest(runs: DataFrame, keys: list[str], id_column: str, offset: int = 0) -> DataFrame:
    """The newest run per store, or the one `offset` before it.

    The rank bound keeps offset+1 rows per store on each task before the exchange, so a
    store with a third of all runs does not gather in one task.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("started_at").desc(), id_column)
    return (
        runs.withColumn("recency", F.row_number().over(order))
        .where(F.col("recency") <= offset + 1)
        .where(F.col("recency") == offset + 1)
        .drop("recency")
    )


def writing_run(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Newest run that wrote comments. A rerun writes nothing and must not replace it."""
    return nth_latest(runs.where(F.col("applied") & (F.col("columns_documented") > 0)), keys, "run_id")


def diff(grounded: DataFrame, plain: DataFrame, schema: str | None = None) -> DataFrame:
    """Descriptions with and without documentation, for every column of the grounded run.

    Both sides are suggestions as `suggest.ingest` stores them. `changed` needs both.
    `grounded_in` joins the citations of the table's first column that has any.
    """
    key = [*TABLE_KEY, "column_name"]
    if schema is not None:
        grounded, plain = (side.where(F.col("table_schema") == schema) for side in (grounded, plain))
    cited = (
        grounded.where(F.size("doc_citations") > 0)
        .groupBy(*TABLE_KEY)
        .agg(F.min_by("doc_citations", "column_name").alias("grounded_in"))
    )
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    said = plain.select(*key, F.struct(F.col("suggested_comment").alias("text")).alias("plain"))
    found = looked_up(grounded.select(*key, F.col("suggested_comment").alias("with_docs")), said, key, plain=F.collect_list("plain"))
    return (
        found.withColumn("plain", F.explode_outer("plain"))
        .withColumns({"without_docs": F.col("plain.text"), "in_plain": F.col("plain").isNotNull()})
        .join(cited, TABLE_KEY, "left")
        .select(
            *key,
            markdown_cell(F.col("without_docs")).alias("without_docs"),
            markdown_cell(F.col("with_docs")).alias("with_docs"),
            (F.col("in_plain") & (text("with_docs") != text("without_docs"))).alias("changed"),
            F.array_join("grounded_in", "; ").alias("grounded_in"),
        )
    )


def counters(suggestions: DataFrame, statements: DataFrame, keys: list[str]) -> DataFrame:
    """What a run did: tables processed and grounded, columns documented, comments staged.

    `statements` are those of `suggest.comment_statements`; staged are the ones of writable tables.
    """
    # per table first: a table's rows meet once, where a count of distinct tables copies every row for each count
    tables = suggestions.groupBy(*dict.fromkeys([*keys, *TABLE_KEY])).agg(
        F.bool_or(F.col("doc_system").isNotNull()).alias("grounded"), F.count_if(is_filled(F.col("suggested_comment"))).alias("documented")
    )
    done = tables.select(
        *keys, F.lit(1).cast("long").alias("tables"), F.col("grounded").cast("long").alias("grounded"), "documented", F.lit(0).cast("long").alias("staged")
    )
    nothing = [F.lit(0).cast("long").alias(n) for n in ("tables", "grounded", "documented")]
    staged = statements.where("is_writable").select(*keys, *nothing, F.lit(1).cast("long").alias("staged"))
    total = lambda n: F.coalesce(F.sum(n), F.lit(0))
    return done.unionByName(staged).groupBy(*keys).agg(
        total("tables").alias("tables_processed"),
        total("grounded").alias("tables_grounded"),
        total("documented").alias("columns_documented"),
        total("staged").alias("comments_staged"),
    )


def price(text: Column) -> Column:
    """Price per million tokens from configuration text; blank or bad text is no price."""
    return text.try_cast("double")


def run_cost(runs: DataFrame) -> DataFrame:
    """Modelled cost of runs (…, prompt_tokens, completion_tokens, price_in, price_out).

    Without both prices there is no cost.
    """
    cost = (F.col("prompt_tokens") / 1e6) * price(F.col("price_in")) + (
        F.col("completion_tokens") / 1e6
    ) * price(F.col("price_out"))
    return runs.withColumn("est_cost_usd", cost).withColumn(
        "usd_per_comment", F.try_divide("est_cost_usd", "columns_documented")
    ).withColumn("seconds", seconds_between(F.col("started_at"), F.col("finished_at")))


def before_after(runs: DataFrame, scans: DataFrame, scores: DataFrame) -> DataFrame:
    """Score of the scan a writing run started from, and of the newest scan, per catalog.

    No before score when that scan is the newest one, since then nothing was compared.
    """
    newest = nth_latest(scans, ["catalog"], "scan_id").select("catalog", F.col("scan_id").alias("after_scan"))
    wrote = writing_run(runs, ["catalog"]).select("catalog", F.col("scan_id").alias("before_scan"))
    score = scores.select("scan_id", "score")
    return (
        newest.join(wrote, "catalog", "left")
        .withColumn("before_scan", F.when(F.col("before_scan") != F.col("after_scan"), F.col("before_scan")))
        .join(score.select(F.col("scan_id").alias("after_scan"), F.col("score").alias("after_score")), "after_scan", "left")
        .join(score.select(F.col("scan_id").alias("before_scan"), F.col("score").alias("before_score")), "before_scan", "left")
        .select("catalog", "before_score", "after_score")
    )

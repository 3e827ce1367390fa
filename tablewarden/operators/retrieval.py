"""Documentation retrieval: Markdown chunks, TF-IDF scores, context packing.

Chunks are (system, chunk_id, heading, body), with ids that are unique within a system; queries
are (query_id, system, terms), where terms is the distinct vocabulary of a table. A chunk is one
row, so it is cut into terms where it was read: text is never shuffled for scoring, only counts
are, and words that no query asks for are dropped before they are counted. Scores join postings
to query terms on (system, term), a plain equi-join that adaptive execution splits when one pair
is hot, and are summed before the ranking. Ranks keep six rows per query on each task before the
window's exchange (WindowGroupLimit), so no query's candidates gather in one task. Nothing is
hinted: sides are broadcast where their size is known to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.generate import explode_once
from ..functions.text import citation, markdown_sections, passage, tokenize
from ..sources.documents import system_for
from .profile import TABLE_KEY

# Limits of the retrieval.
TOP_CHUNKS = 6
MAX_CONTEXT_CHARS = 6000
MIN_SCORE = 0.5


def chunk_documents(documents: DataFrame, key: list[str]) -> DataFrame:
    """One row per Markdown section: key columns, position (from 0), heading, body."""
    return (
        documents.select(*key, F.posexplode_outer(markdown_sections(F.col("text"))).alias("position", "section"))
        .where(F.col("section").isNotNull())
        .select(*key, "position", "section.heading", "section.body")
    )


def corpus_chunks(documents: DataFrame) -> DataFrame:
    """Chunks of a documentation corpus, numbered so that ties keep document order."""
    return chunk_documents(documents, ["system"]).select(
        "system",
        F.concat_ws("#", "system", F.lpad(F.col("position").cast("string"), 8, "0")).alias("chunk_id"),
        "heading",
        "body",
    )


def chunk_tokens() -> Column:
    return tokenize(F.concat_ws(" ", "heading", "body"))


def chunk_terms(chunks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Term counts: (system, chunk_id, length, term, tf), of all terms or of the `wanted` ones."""
    tokens = chunks.select("system", "chunk_id", chunk_tokens().alias("tokens"))
    length = F.greatest(F.size("tokens"), F.lit(1)).alias("length")
    rows = explode_once(tokens, F.col("tokens"), "term", "system", "chunk_id", length)
    if wanted is not None:
        rows = rows.join(wanted.select("term").distinct(), "term", "left_semi")
    return (
        rows.groupBy("system", "chunk_id", "length", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def idf(total: Column, seen: Column) -> Column:
    return F.log((total + 1) / (seen + 1)) + 1


def document_frequency(terms: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks per term over all systems, with the smoothed inverse frequency.

    Chunks are counted apart from their terms, since one without any word still counts.
    """
    total = chunks.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        terms.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .withColumn("idf", idf(total, F.col("df")))
    )


def table_queries(tables: DataFrame, columns: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Vocabulary of each mapped table: words of its name and column names, not its schema."""
    names = columns.groupBy(*TABLE_KEY).agg(
        F.array_distinct(F.flatten(F.collect_set(tokenize(F.col("column_name"))))).alias("column_terms")
    )
    system = system_for(F.concat_ws(".", "table_schema", "table_name"), rules)
    return (
        tables.select(*TABLE_KEY, system.alias("system"))
        .where(F.col("system").isNotNull())
        .join(names, TABLE_KEY, "left")
        .select(
            F.concat_ws(".", *TABLE_KEY).alias("query_id"),
            "system",
            F.array_distinct(
                F.concat(
                    tokenize(F.col("table_name")),
                    F.coalesce("column_terms", F.array().cast("array<string>")),
                )
            ).alias("terms"),
        )
    )


def rank_chunks(queries: DataFrame, chunks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Best six chunks per query within its system: (query_id, system, chunk_id, score, rank).

    Pass stored `terms` to skip tokenizing. Scores are compared at six decimals, so that
    equal chunks tie however their sums were ordered, and ties keep chunk order.
    """
    wanted = explode_once(queries, F.array_distinct("terms"), "term", "query_id", "system")
    if terms is None:
        postings = chunk_terms(chunks, wanted)
    else:
        postings = terms.join(wanted.select("term").distinct(), "term", "left_semi")
    weights = document_frequency(postings, chunks).select("term", "idf")
    order = Window.partitionBy("query_id").orderBy(F.col("sort_score").desc(), "chunk_id")
    return (
        postings.join(wanted.join(weights, "term"), ["system", "term"])
        .groupBy("query_id", "system", "chunk_id", "length")
        .agg(F.sum(F.col("idf") * F.col("tf")).alias("weight"))
        .withColumn("score", F.col("weight") / F.sqrt("length"))
        .withColumn("sort_score", F.round("score", 6))
        .where(F.col("sort_score") >= MIN_SCORE)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= TOP_CHUNKS)
        .select("query_id", "system", "chunk_id", "score", "rank")
    )


def pack_context(ranked: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Passages in rank order until the next one would overflow 6,000 characters.

    Lengths only grow, so "stop at the first overflow" is a bound on the running sum. The
    two characters between passages are not counted. At most six rows per query get here,
    and only their chunks are read again.
    """
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    blocks = (
        ranked.join(chunks, ["system", "chunk_id"])
        .join(queries.select("query_id", "terms"), "query_id")
        .withColumn("block", passage(F.col("heading"), F.col("body")))
        .withColumn("used", F.sum(F.length("block")).over(running))
        .where(F.col("used") <= MAX_CONTEXT_CHARS)
        .select(
            "query_id",
            "system",
            F.struct(
                "rank",
                "block",
                citation(F.col("system"), F.col("heading")).alias("citation"),
                F.array_intersect("terms", chunk_tokens()).alias("overlap"),
            ).alias("hit"),
        )
    )
    return (
        blocks.groupBy("query_id", "system")
        .agg(F.array_sort(F.collect_list("hit")).alias("hits"))
        .select(
            "query_id",
            "system",
            F.array_join("hits.block", "\n\n").alias("context"),
            F.col("hits.citation").alias("citations"),
            F.array_sort(F.array_distinct(F.flatten("hits.overlap"))).alias("matched_terms"),
        )
    )


def retrieve(queries: DataFrame, chunks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    return pack_context(rank_chunks(queries, chunks, terms), chunks, queries)

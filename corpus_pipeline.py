"""The corpus pipeline: STAGES in order, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the caller may write
and reread it. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewarden.llm import decontaminate, language_id, mixing, near_dedup, sharding
from tablewarden.llm.durable import cut
from tablewarden.llm.rows import column

SHARDS = 24

# Language prototypes, set hashes, block permutations and the curve are not expressible in SQL.
ORACLE_SQL = None


# A text of so many letters that resembles no language is none; chance alone gives a cosine of about 0.03.
LETTERS, RESEMBLANCE = 50, 0.1


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: without text or letter, or of `LETTERS` letters and more whose
    cosine with every learned language is below `RESEMBLANCE`.

    Short texts with a letter stay, whatever they resemble. Where no document outside the fold has
    a language, only those without a letter go. Null ids stay, repeated rows fare alike, an empty
    table gives no rows, and further columns of any name are carried along.
    """
    prototypes = language_id.learn(docs.where(~language_id.held_out("doc_id")).select("text", "lang"))
    if not prototypes:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    letters = F.length(F.regexp_replace("row.text", r"\P{L}+", ""))
    alike = (F.col("lang_pred") != language_id.UNKNOWN) & ((F.col("score") >= RESEMBLANCE) | (letters < LETTERS))
    return language_id.identify(docs, prototypes).where(alike).select("row.*")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near duplicates.

    Texts without words are like no other and stay, as do rows without an id. Rows that repeat an
    id are one document, all of whose rows stay or go. An empty table gives no rows.
    """
    dropped = near_dedup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*[column(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.

    Null, empty and wordless texts hold none and stay; so does everything while the benchmark has no
    words. Null ids stay, repeated rows fare alike, an empty table gives no rows.
    """
    return decontaminate.without_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes words of each source by its weight; a row per run of words taken in one pass.

    Null, empty and wordless texts have no words to take and go. A null source is one of its own,
    the last; rows that repeat, and rows without an id, are laid out each. An empty table gives no rows.
    """
    return mixing.mixture(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot, along a Hilbert curve through source, language and size.

    Columns of these two names that `docs` may have give way. Nulls are lowest in every dimension,
    equal rows are interchangeable, an empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    return sharding.sharded(docs, own, SHARDS).select("row.*", "shard", "slot")


STAGES = [
    ("language ID", identified),
    ("MinHash near-dedup", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Each stage reads its input several times, so it is cut before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

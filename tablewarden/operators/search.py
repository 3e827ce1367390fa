"""Catalog search: an inverted index, ranked columns and documents for many queries at once, facets, name filter.

Fields are (table_key, ordinal, column_name, text, table_text), where `text` is everything said about the
column itself. Queries are (query_id, query). A term matches wherever it occurs inside a longer word.

The index holds each distinct word once, with its three-character pieces: a term (three characters at
least) can only occur in words that hold its first piece, so finding the words is an equi-join plus a
check. Postings are kept where a word is said: words that all columns of a table have in common (its
name), and those of its description, belong to the table, the rest to columns. An index can be stored;
its parts are dealt into folders by word, so a search reads the folders of its words.

A search does not spread a table's hits over its columns, nor a frequent term's list over the queries that
ask for it. Columns that a single term hits equally score the same, so of each list only the first `TOP_COLUMNS`
can be among the best; and of the tables that nothing but themselves is hit in, only the `TOP_COLUMNS` best,
and of each the first columns. Beyond these, only columns that two hits meet in are scored.

Columns are written once, with the words that are their own; postings are read off them. What is scored by table is dealt
by table before queries multiply it, and rows of queries that were counted to be few are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.durable import cut_clean as cut
from ..functions.generate import explode_once
from ..functions.lookup import looked_up
from ..functions.text import is_filled, search_runs, search_terms
from .usage import is_orphan

# Weights and limits of the search.
NAME_WEIGHT, TEXT_WEIGHT, TABLE_WEIGHT = 2.0, 1.0, 0.25
MIN_COLUMN_SCORE = 0.9
TOP_COLUMNS, TOP_DOCUMENTS = 6, 2
PIECE = 3
# folders of a stored index
BUCKETS = 64
# rows that are broadcast, if they were counted to be no more, and pieces that words are sifted by before they are shuffled
FEW, FEW_PIECES = 100_000, 64

_COLUMN = ["table_key", "ordinal"]


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times, n_terms), one row per distinct term of a query."""
    return (
        explode_once(
            queries.select("query_id", search_terms(F.col("query")).alias("terms")),
            F.col("terms"), "term", "query_id", F.size("terms").alias("n_terms"),
        )
        .groupBy("query_id", "n_terms", "term")
        .agg(F.count(F.lit(1)).alias("times"))
    )


def _postings(rows: DataFrame, key: list[str], text: Column) -> DataFrame:
    """Distinct words of each row's text: key columns and word."""
    return explode_once(rows, F.array_distinct(search_runs(text)), "word", *key)


def word_pieces(words: DataFrame) -> DataFrame:
    """(word, piece) for the distinct pieces of each distinct word."""
    cuts = F.transform(
        F.sequence(F.lit(1), F.length("word") - (PIECE - 1)),
        lambda i: F.substr("word", i, F.lit(PIECE)),
    )
    long_enough = words.select("word").where(F.length("word") >= PIECE).distinct()
    return explode_once(long_enough, F.array_distinct(cuts), "piece", "word")


def matching_words(terms: DataFrame, pieces: DataFrame) -> DataFrame:
    """(term, word) for every word that contains the term."""
    return (
        terms.select("term", F.left("term", F.lit(PIECE)).alias("piece"))
        .join(pieces, "piece")
        .where(F.col("word").contains(F.col("term")))
        .select("term", "word")
    )


# -- the index ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """`columns` (table_key, ordinal, column_name), `tables` (table_key, n_columns), `postings` (word, table_key, ordinal,
    weight), `table_postings` (word, table_key, weight), `pieces` (word, piece)."""

    columns: DataFrame
    tables: DataFrame
    postings: DataFrame
    table_postings: DataFrame
    pieces: DataFrame

    PARTS = ("columns", "tables", "postings", "table_postings", "pieces")

    def parts(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.PARTS}


def build_index(fields: DataFrame) -> Index:
    """The index of a catalog's fields, computed once and written to the session's shared folder.

    Words of a table's key that all its columns' texts have are the table's, but for columns that have them in
    their name. A null text says nothing.
    """
    named = F.coalesce("name", F.array().cast("array<string>"))
    has_key = F.size(F.array_except("key", "words")) == 0
    # the words of a key that a text has are left out until it is known whether all texts of the table have them
    left = F.when(F.col("has_key") & F.col("name").isNotNull(), F.array_except("words", F.array_except("key", "name"))).otherwise(F.col("words"))
    said = cut(
        fields.select(
            *_COLUMN, "column_name", "table_text",
            F.array_distinct(search_runs(F.coalesce("text", F.lit("")))).alias("words"),
            F.array_distinct(search_runs(F.col("table_key"))).alias("key"),
            F.array_distinct(search_runs(F.col("column_name"))).alias("name"),
        )
        .withColumn("has_key", has_key)
        .withColumn("own", left)
        .withColumn("named", F.array_intersect("own", named))
        # a word holds no blank; words of the name are not written if they are all of them, as in a text that includes it
        .select(
            *_COLUMN, "column_name", "table_text", "has_key",
            F.when(F.size("named") < F.size(named), F.array_join("named", " ")).alias("named"),
            F.array_join(F.array_except("own", "named"), " ").alias("other"),
        )
    )
    columns = said.select(*_COLUMN, "column_name")
    tables = cut(
        said.groupBy("table_key").agg(
            F.count(F.lit(1)).alias("n_columns"),
            F.first("table_text", ignorenulls=True).alias("table_text"),
            F.bool_and("has_key").alias("in_all"),
        )
    )
    common = explode_once(
        tables.where("in_all"), F.array_distinct(search_runs(F.col("table_key"))), "word", "table_key", F.lit(TEXT_WEIGHT).alias("weight")
    )
    described = _postings(tables, ["table_key"], F.coalesce("table_text", F.lit(""))).withColumn("weight", F.lit(TABLE_WEIGHT))
    table_postings = common.unionByName(described).select("word", "table_key", "weight")
    # a term in the name is also in the text, since the text includes the name
    weighed = lambda words, weight: F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(weight).alias("weight")))
    listed = lambda packed: F.filter(F.split(packed, " "), lambda w: w != "")
    in_name = F.array_distinct(search_runs(F.coalesce("column_name", F.lit(""))))
    hits = F.concat(weighed(F.coalesce(listed(F.col("named")), in_name), NAME_WEIGHT), weighed(listed(F.col("other")), TEXT_WEIGHT))
    spread = lambda rows, items: explode_once(rows, items, "hit", *_COLUMN).select("hit.word", *_COLUMN, "hit.weight")
    nameless = F.coalesce("has_key", F.lit(False)) & F.col("column_name").isNull()
    postings = spread(said.where(F.col("table_key").isNotNull() & ~nameless), hits)
    apart = tables.where(~F.col("in_all")).select("table_key")
    if not apart.isEmpty():
        # where a text of the table lacks words of its key, they are those columns' that have them
        key = F.array_except(F.array_distinct(search_runs(F.col("table_key"))), in_name)
        rest = F.when(nameless, hits).otherwise(weighed(key, TEXT_WEIGHT))
        postings = postings.unionByName(spread(said.where("has_key").join(apart, "table_key"), rest))
    pieces = cut(word_pieces(postings.select("word").unionByName(table_postings.select("word"))))
    return Index(columns, tables.select("table_key", "n_columns"), postings, table_postings, pieces)


def save_index(index: Index, path: str) -> None:
    """Writes an index; parts that are searched by word lie in a folder for each bucket of words."""
    for name, part in index.parts().items():
        key = "piece" if name == "pieces" else "word"
        if key in part.columns:
            bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
            part.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
        else:
            part.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}").drop("bucket") for name in Index.PARTS])


# -- columns ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class _Hits:
    """`tables` (term, table_key, weight), and `own` (term, table_key, ordinal, weight, said) where a column's weight is
    more than `said`, what the table has (0 if nothing)."""

    own: DataFrame
    tables: DataFrame


def _by_table(rows: DataFrame) -> DataFrame:
    """Dealt by table, by a number that is always given, so that frames dealt alike stay so."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "table_key")


def _small(rows: DataFrame, count: int) -> DataFrame:
    """Broadcast if `count`, the most rows there can be, is few."""
    return F.broadcast(rows) if count <= FEW else rows


def _hits(terms: DataFrame, index: Index) -> _Hits:
    words = cut(matching_words(terms.select("term").distinct(), index.pieces))
    best = F.max("weight").alias("weight")
    postings = index.postings
    wanted = terms.select(F.left("term", F.lit(PIECE)).alias("piece")).distinct().limit(FEW_PIECES + 1).collect()
    if len(wanted) <= FEW_PIECES:
        # words that hold the first piece of no term need not meet the terms
        postings = postings.where(reduce(or_, [F.col("word").contains(r.piece) for r in wanted], F.lit(False)))
    tables = cut(index.table_postings.join(words, "word").groupBy("term", "table_key").agg(best))
    own = _by_table(postings.join(words, "word").select("term", *_COLUMN, "weight")).groupBy("term", *_COLUMN).agg(best)
    # what the table says as loudly is no hit of the column's own
    said = _by_table(tables.select("term", "table_key", F.col("weight").alias("said")))
    own = looked_up(own, said, ["term", "table_key"], said=F.max("said")).withColumn("said", F.coalesce("said", F.lit(0.0)))
    return _Hits(cut(own.where("weight > said").select("term", *_COLUMN, "weight", "said")), tables)


def term_weights(terms: DataFrame, hits: _Hits, index: Index) -> DataFrame:
    """Rarity of every query term over the column texts: (term, idf). Unseen terms included."""
    total = index.tables.agg(F.coalesce(F.sum("n_columns"), F.lit(0)).alias("n")).scalar()
    whole = hits.tables.where(F.col("weight") >= TEXT_WEIGHT).select("term", "table_key")
    by_table = whole.join(index.tables, "table_key").select("term", F.col("n_columns").alias("n"))
    by_column = hits.own.where(F.col("said") < TEXT_WEIGHT).select("term", F.lit(1).cast("long").alias("n"))
    seen = by_table.unionByName(by_column).groupBy("term").agg(F.sum("n").alias("seen"))
    return (
        terms.select("term").distinct().join(seen, "term", "left").select(
            "term", (F.log((total + 1) / (F.coalesce("seen", F.lit(0)) + 1)) + 1).alias("idf")
        )
    )


def _top(scored: DataFrame, limit: int, *tie: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), *tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _score() -> Column:
    """Of the sums of a query's matched terms."""
    return F.col("raw") * F.col("matched") / F.col("n_terms")


def _meetings(asked: DataFrame, hits: _Hits) -> DataFrame:
    """(query_id, table_key, ordinal) of columns in which two terms of a query meet, or that are first in a term's list."""
    pair = ["query_id", *_COLUMN]
    place = F.row_number().over(Window.partitionBy("term", "weight").orderBy(*_COLUMN))
    first = hits.own.withColumn("place", place).where(F.col("place") <= TOP_COLUMNS).select("term", *_COLUMN)
    alone = first.join(asked.select("query_id", "term"), "term").select(*pair)
    side = lambda n: hits.own.select(F.col("term").alias(n), *_COLUMN)
    wanted = cut(asked.select("query_id", F.col("term").alias("one")).join(asked.select("query_id", F.col("term").alias("two")), "query_id").where("one < two"))
    both = side("one").join(side("two"), _COLUMN).join(_small(wanted, wanted.count()), ["one", "two"]).select(*pair)
    return alone.unionByName(both).distinct()


def _scored(asked: DataFrame, hits: _Hits, index: Index, n_queries: int) -> DataFrame:
    """(query_id, table_key, ordinal, score) of all columns that can be among a query's best.

    A column has its table's sums, to which each term adds by what the column has more of it. Columns that are
    scored in two ways count by the better, which is the one that saw all hits."""
    raw, matched = F.col("weight") * F.col("idf") * F.col("times"), F.col("times")
    tables = _by_table(hits.tables).join(asked, "term").groupBy("query_id", "n_terms", "table_key").agg(F.sum(raw).alias("raw"), F.sum(matched).alias("matched"))
    tables = tables.withColumn("score", _score())
    # tables by themselves: the best, and of each the first columns
    best = _top(tables.where(F.col("score") > MIN_COLUMN_SCORE), TOP_COLUMNS, "table_key").select("query_id", "table_key", "score")
    place = F.row_number().over(Window.partitionBy("query_id", "table_key").orderBy("ordinal"))
    head = _small(best, TOP_COLUMNS * n_queries).join(index.columns.select(*_COLUMN), "table_key").withColumn("place", place).where(F.col("place") <= TOP_COLUMNS)
    # hits of a column, in tables that are hit as well and where hits meet
    in_tables = tables.select("query_id", "table_key", F.col("raw").alias("table_raw"), F.col("matched").alias("table_matched")).join(_by_table(hits.own), "table_key")
    alone = _meetings(asked, hits).join(hits.own, _COLUMN).withColumns({"table_raw": F.lit(0.0), "table_matched": F.lit(0).cast("long")})
    more = (F.col("weight") - F.col("said")) * F.col("idf") * F.col("times")

    def summed(rows: DataFrame) -> DataFrame:
        return (
            rows.join(asked, ["query_id", "term"])
            .groupBy("query_id", "n_terms", *_COLUMN, "table_raw", "table_matched")
            .agg(F.sum(more).alias("more"), F.sum(F.when(F.col("said") == 0, F.col("times")).otherwise(0)).alias("new"))
            .select("query_id", "n_terms", *_COLUMN, (F.col("table_raw") + F.col("more")).alias("raw"), (F.col("table_matched") + F.col("new")).alias("matched"))
            .select("query_id", "n_terms", *_COLUMN, _score().alias("score"))
            .where(F.col("score") > MIN_COLUMN_SCORE)
        )

    # apart, so that what is dealt by table is summed where it lies
    columns = summed(in_tables).unionByName(summed(alone))
    # a column is here twice at most, so that its query's best columns are among twice as many rows
    order = Window.partitionBy("query_id", "n_terms").orderBy(F.round("score", 6).desc(), *_COLUMN)
    columns = columns.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 2 * TOP_COLUMNS).select("query_id", *_COLUMN, "score")
    found = head.select("query_id", *_COLUMN, "score").unionByName(columns)
    return found.groupBy("query_id", *_COLUMN).agg(F.max("score").alias("score"))


def search_columns(queries: DataFrame, index: Index | DataFrame) -> DataFrame:
    """Six best columns per query: (query_id, rank, table_key, column_name, score). Takes an index, or fields."""
    index = index if isinstance(index, Index) else build_index(index)
    terms = cut(query_terms(queries))
    hits = _hits(terms, index)
    asked = cut(terms.join(term_weights(terms, hits, index), "term"))
    n_queries = terms.select("query_id").distinct().count()
    found = _top(_scored(_small(asked, asked.count()), hits, index, n_queries), TOP_COLUMNS, *_COLUMN)
    return (
        _small(found, TOP_COLUMNS * n_queries)
        .join(index.columns, _COLUMN)
        .select("query_id", "rank", "table_key", "column_name", "score")
    )


# -- documents ----------------------------------------------------------------------------------------


def search_documents(queries: DataFrame, documents: DataFrame, index: Index | DataFrame) -> DataFrame:
    """Two best documents (doc_id, text) per query, by the summed rarity of contained terms, which a catalog's
    index (or fields) tells."""
    index = index if isinstance(index, Index) else build_index(index)
    terms = cut(query_terms(queries))
    asked = cut(terms.join(term_weights(terms, _hits(terms, index), index), "term"))
    # words of all texts are cut out once
    said = cut(_postings(documents, ["doc_id"], F.col("text")))
    words = matching_words(terms.select("term").distinct(), word_pieces(said))
    hits = said.join(words, "word").select("term", "doc_id").distinct()
    scored = hits.join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * F.col("times")).alias("score"))
    return _top(scored, TOP_DOCUMENTS, "doc_id").select("query_id", "rank", "doc_id", "score")


def facets(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Columns holding personal data, dead columns, orphan tables: (facet, table_key, column_name, text)."""
    picked = columns.select(
        "table_key",
        "column_name",
        F.explode(
            F.filter(
                F.array(
                    F.when(
                        F.col("is_pii"),
                        F.struct(F.lit("pii").alias("facet"), F.coalesce("column_comment", F.lit("")).alias("text")),
                    ),
                    F.when(
                        F.col("is_all_null") | F.col("is_constant"),
                        F.struct(
                            F.lit("dead").alias("facet"),
                            F.when(F.col("is_all_null"), "100% null").otherwise("single repeated value").alias("text"),
                        ),
                    ),
                ),
                lambda item: item.isNotNull(),
            )
        ).alias("hit"),
    ).select("hit.facet", "table_key", "column_name", "hit.text")
    orphans = tables.where(is_orphan()).select(
        F.lit("orphan").alias("facet"),
        "table_key",
        F.lit("").alias("column_name"),
        F.coalesce("table_comment", F.lit("")).alias("text"),
    )
    return picked.unionByName(orphans)


def filter_by_name(tables: DataFrame, columns: DataFrame, typed: str) -> DataFrame:
    """Tables whose key or any column name contains what was typed; nothing typed keeps all."""
    if not typed:
        return tables
    wanted = typed.lower()
    by_column = (
        columns.where(F.lower("column_name").contains(wanted))
        .select("table_key", F.lit(True).alias("column_matches"))
        .distinct()
    )
    return (
        tables.join(by_column, "table_key", "left")
        .where(F.lower("table_key").contains(wanted) | F.col("column_matches"))
        .drop("column_matches")
    )


def search_text(table_key: Column, column_name: Column, comment: Column, labels: Column) -> Column:
    """What search reads about a column: its table, name, description and labels."""
    return F.lower(
        F.concat_ws(
            " ", table_key, column_name, F.when(is_filled(comment), comment).otherwise(F.lit("")), F.array_join(labels, " ")
        )
    )

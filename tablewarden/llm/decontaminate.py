"""Removal of benchmark passages, by native expressions only.

A word is a longest run of ASCII letters, digits and characters beyond ASCII, lower-cased in A-Z. A
benchmark item's windows are all runs of `n` words; an item of fewer words is one window. The set of
windows goes to all tasks as a hash set inside the expression: a position passes if the hash of the
window's first and last word is in it, and then if the whole window is, word for word. No text is
shuffled, and documents' windows are never rows.

The hash set is only used while it holds at most MAX_WINDOWS windows and MAX_CHARS characters.
Beyond that positions of documents become rows, of a hash only and for the lengths that windows have, which are
joined with those of the benchmark; what meets is compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewarden.llm.rows import column, packed as packed_row

from tablewarden.functions.generate import explode_once

WINDOW = 10
MAX_WINDOWS = 50_000
MAX_CHARS = 16_000_000
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The normalised words of a text; none for a null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _NO_WORD), "")


def windows(benchmark: DataFrame, n: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, length, items): each distinct window and the sorted distinct ids, as strings, of its items.

    Items without words have none. A null id counts for the window and not among the items.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    items = items.select("item", "words", F.least(F.size("words"), F.lit(n)).alias("length"))
    begins = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    texts = F.transform(begins, lambda i: F.concat_ws(" ", F.slice("words", i, F.col("length"))))
    rows = explode_once(items, texts, "window", "item", "length")
    return rows.groupBy("window", "length").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _packed(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(packed_row(docs.columns), words(column(text_col)).alias("words"))


def _by_hash_set(packed: DataFrame, known: list) -> DataFrame:
    found = ["array()"]
    for length in sorted({k.length for k in known}):
        ends = ", ".join(sorted({f"{k.ends}L" for k in known if k.length == length}))
        whole = ", ".join(f"'{k.window}'" for k in known if k.length == length)
        found.append(
            f"""IF(size(w) >= {length}, transform(filter(sequence(0, size(w) - {length}), i ->
              xxhash64(w[i], w[i + {length - 1}]) IN ({ends}) AND concat_ws(' ', slice(w, i + 1, {length})) IN ({whole})),
              i -> struct(i AS begin, {length} AS length)), array())"""
        )
    # the words are a variable of the expression: wherever a filter on it is pushed, they are cut once per row
    spans = f"get(transform(array(words), w -> CAST(concat({', '.join(found)}) AS array<struct<begin: int, length: int>>)), 0)"
    return packed.select("row", "words", F.expr(spans).alias("spans"))


def _by_join(packed: DataFrame, known: DataFrame) -> DataFrame:
    """Positions become narrow rows, of a hash only, for the lengths that windows have; hits are then read again."""
    rows = packed.select(F.monotonically_increasing_id().alias("at"), "row", "words")
    lengths = sorted(r.length for r in known.select("length").distinct().collect())
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.size("words"))
    spans = F.flatten(
        F.transform(
            fitting,
            lambda length: F.transform(
                F.sequence(F.lit(0), F.size("words") - length),
                lambda i: F.struct(i.alias("begin"), length.alias("length"), F.xxhash64(F.concat_ws(" ", F.slice("words", i + 1, length))).alias("hash")),
            ),
        )
    )
    hashed = known.select(F.xxhash64("window").alias("hash"), "length", "window")
    hits = explode_once(rows, spans, "span", "at").select("at", "span.*").join(hashed, ["hash", "length"])
    hits = hits.groupBy("at").agg(F.collect_set(F.struct("begin", "length", "window")).alias("spans"))
    found = F.filter("spans", lambda s: F.concat_ws(" ", F.slice("words", s.begin + 1, s.length)) == s.window)
    found = F.array_distinct(F.transform(found, lambda s: F.struct(s.begin.alias("begin"), s.length.alias("length"))))
    empty = F.array().cast("array<struct<begin: int, length: int>>")
    return rows.join(hits, "at", "left").select("row", "words", F.coalesce(found, empty).alias("spans"))


def marked(docs: DataFrame, known: DataFrame, text_col: str = "text", n: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Columns `row` (all of `docs` as a struct), `words`, and `spans`: verified occurrences of windows.

    The benchmark is measured first; its windows are only sent along while they fit the bounds.
    """
    size = known.agg(F.count("*"), F.coalesce(F.sum(F.length("window")), F.lit(0))).first()
    packed = _packed(docs, text_col)
    if size[0] > max_windows or size[1] > MAX_CHARS:
        return _by_join(packed, known)
    part = F.split("window", " ")
    return _by_hash_set(packed, known.select("window", "length", F.xxhash64(F.element_at(part, 1), F.element_at(part, -1)).alias("ends")).collect())


def n_hit(spans: Column) -> Column:
    """Words inside any span."""
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))

    def add(state: Column, span: Column) -> Column:
        end = F.greatest(state.end, span.begin + span.length)
        return F.struct((state.hit + end - F.greatest(state.end, F.least(span.begin, end))).alias("hit"), end.alias("end"))

    return F.aggregate(F.array_sort(spans), start, add, lambda state: state.hit).cast("long")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids as strings), contaminated for each row of `docs`.

    Null, empty and wordless texts have no words and are clean; so is everything while the benchmark
    is empty or has no words. Rows that repeat are reported each. Null ids stay null.
    """
    known = windows(benchmark, n)
    rows = marked(docs, known, text_col, n, max_windows)
    texts = F.array_distinct(F.transform("spans", lambda s: F.concat_ws(" ", F.slice("words", s.begin + 1, s.length))))
    rows = rows.select(
        F.monotonically_increasing_id().alias("at"),
        F.col(f"row.{id_col}").alias("doc_id"),
        F.size("words").cast("long").alias("n_words"),
        F.when(F.size("spans") > 0, n_hit(F.col("spans"))).otherwise(F.lit(0).cast("long")).alias("n_hit"),
        F.when(F.size("spans") > 0, texts).alias("windows"),
    )
    rows = rows.select("at", "doc_id", "n_words", "n_hit", F.explode_outer("windows").alias("window"))
    found = rows.join(known.select("window", "items"), "window", "left")
    # a document has few different item lists, so they are made distinct before they meet
    lists = found.groupBy("at", "doc_id", "n_words", "n_hit").agg(F.collect_set("items").alias("lists"))
    items = F.array_sort(F.array_distinct(F.flatten("lists")))
    return lists.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), items.alias("items"), (F.col("n_hit") > 0).alias("contaminated"))


def without_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", n: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows of `docs`, whole and unchanged, that hold no window of the benchmark."""
    rows = marked(docs, windows(benchmark, n), text_col, n, max_windows)
    return rows.where(F.size("spans") == 0).select("row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", n: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """All rows of `docs`; hit words, with what stands between each and the word before it, are cut out."""
    rows = marked(docs, windows(benchmark, n), text_col, n, max_windows)
    text = F.col(f"row.{text_col}")
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    hit = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s.begin, s.begin + s.length - 1))))
    rows = rows.select("row", "spans", pieces.alias("pieces"), hit.alias("hit"))
    tail = F.substring(text, F.length(F.array_join("pieces", "")) + 1, F.length(text))
    # the hits are a variable of the expression: else they may be worked out again for each piece
    kept = F.get(F.transform(F.array("hit"), lambda h: F.filter("pieces", lambda p, i: ~F.array_contains(h, i))), F.lit(0))
    clean = F.concat(F.array_join(kept, ""), tail)
    return rows.select(F.col("row").withField(text_col, F.when(F.size("spans") == 0, text).otherwise(clean)).alias("row")).select("row.*")

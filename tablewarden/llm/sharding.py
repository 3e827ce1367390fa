"""Sharding along a Hilbert curve, by native expressions only.

Several metadata dimensions are quantised to `bits` bits each; a row's cell is numbered along the
Hilbert curve through all of them, rows are ordered by that number, and the order is cut into runs
of equal counts (at most one apart). Neighbours on the curve are neighbours in every dimension, so
each shard spans little of any of them and readers can skip shards by minima and maxima.

Rows of equal text take the metadata of the one with the smallest id and stand side by side, so at most
the cuts between shards part them. Ranks do not need one sorted task: approximate quantiles of the
sort key bound `BUCKETS` ranges, whose counts give each range's first rank. The key ends in a hash
of the id, so very many rows of one text or of equal metadata are spread over ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewarden.llm.durable import cut
from tablewarden.llm.rows import column, packed as packed_row

BITS = 6
BUCKETS = 256
KEY_BITS, ID_BITS = 63, 15


def hilbert_index(values: list[Column], bits: int) -> Column:
    """The number along the curve of a cell given by `bits`-bit coordinates."""
    n = len(values)
    ones = F.array(*[v.cast("long") for v in values])
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    # from the coarsest bit down: reflect or exchange the finer bits of a coordinate with the first one
    def turn(x: Column, s: Column) -> Column:
        own, first = F.get(x, s.i), F.get(x, F.lit(0))
        swap = F.when(own.bitwiseAND(s.q) == 0, first.bitwiseXOR(own).bitwiseAND(s.q - 1)).otherwise(F.lit(0).cast("long"))
        flip = F.when(own.bitwiseAND(s.q) == 0, F.lit(0).cast("long")).otherwise(s.q - 1)
        return F.transform(
            x,
            lambda v, j: F.when((j == 0) & (s.i == 0), v.bitwiseXOR(flip))
            .when(j == 0, v.bitwiseXOR(flip).bitwiseXOR(swap))
            .when(j == s.i, v.bitwiseXOR(swap))
            .otherwise(v),
        )

    turned = F.aggregate(steps, ones, turn)
    # Gray code over coordinates, from the most significant bit on: a running parity of all bits so far
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).cast("long").alias("parity"))

    def append(x: Column):
        def step(state: Column, place: Column) -> Column:
            bit = F.call_function("shiftright", F.get(x, place.i), place.b).bitwiseAND(F.lit(1).cast("long")).bitwiseXOR(state.parity)
            return F.struct((state["index"] * 2 + bit).alias("index"), bit.alias("parity"))

        return step

    one = F.transform(F.array(turned), lambda x: F.aggregate(places, start, append(x), lambda state: state["index"]))
    return F.get(one, F.lit(0))


def _category(docs: DataFrame, name: str, bits: int) -> Column:
    """The level of a text column: values in order, levels by the share of rows before them, a null lowest.

    Distinct values are laid out in ranges, so that their number does not matter; levels change at 2^bits - 1
    values at most, which are all that an expression needs."""
    counts = docs.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    laid = cut(counts.repartitionByRange(F.col("value").asc_nulls_first()).withColumn("part", F.spark_partition_id()))
    firsts, total = [], 0
    for row in sorted(laid.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        firsts.append((row.part, total))
        total += row.n
    if not total:
        return F.lit(0)
    starts = docs.sparkSession.createDataFrame(firsts, "part int, first long")
    before = Window.partitionBy("part").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    level = F.floor((F.col("first") + F.coalesce(F.sum("n").over(before), F.lit(0))) * (1 << bits) / total)
    levels = laid.join(starts, "part").select("value", level.cast("int").alias("level")).where("value IS NOT NULL AND level > 0")
    bounds = sorted((r.level, r.value) for r in levels.groupBy("level").agg(F.min("value").alias("value")).collect())
    found = None
    for at, value in reversed(bounds):
        found = F.when(F.col(name) >= value, at) if found is None else found.when(F.col(name) >= value, at)
    return F.lit(0) if found is None else F.coalesce(found, F.lit(0))


def _number(docs: DataFrame, column: str, bits: int) -> Column:
    """The level of a number between the column's minimum and maximum; a null is lowest."""
    low, high = docs.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if low is None or low == high:
        return F.lit(0)
    scaled = F.floor((F.col(column).cast("double") - low) / (high - low) * (1 << bits))
    return F.coalesce(F.least(scaled, F.lit((1 << bits) - 1)), F.lit(0)).cast("int")


def sharded(
    docs: DataFrame, columns: list[str], shards: int, id_col: str = "doc_id", text_col: str = "text", categories=("source", "lang"), bits: int = BITS, buckets: int = BUCKETS
) -> DataFrame:
    """`row` (the given columns as a struct, so names cannot clash), size, text_crc32, shard, slot.

    Dimensions: the category columns, the logarithm of the size, the document id. `shard` counts are at most one apart, `slot`
    counts from 0 within a shard. A null text has no bytes (size 8, checksum 0), and is a text like any
    other; nulls are lowest in every dimension. Equal rows are interchangeable. An empty table
    gives no rows; with fewer rows than shards some shards are empty.
    """
    text = F.coalesce(column(text_col), F.lit(""))
    names = [f"c{i}" for i in range(len(categories))]
    facts = docs.select(
        packed_row(columns),
        column(id_col).alias("id"),
        *[column(c).cast("string").alias(name) for c, name in zip(categories, names, strict=True)],
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    ).withColumn("log_size", F.log2("size"))
    narrow = facts.drop("row")
    levels = [_category(narrow, name, bits) for name in names] + [_number(narrow, "log_size", bits), _number(narrow, "id", bits)]
    cell_bits = bits * len(levels)
    cell = hilbert_index(levels, bits)
    # texts that stand in several cells take that of their first row
    cells = narrow.select("text_hash", "size", "id", cell.alias("cell")).groupBy("text_hash", "size")
    moved = cells.agg(F.min("cell").alias("low"), F.max("cell").alias("high"), F.min_by("cell", F.struct(F.col("id").isNull(), "id", "cell")).alias("home"))
    moved = cut(moved.where("low < high").select("text_hash", "size", "home"))
    own = KEY_BITS - cell_bits - ID_BITS
    same = F.col("text_hash").bitwiseAND(F.lit((1 << own) - 1))
    spread = F.xxhash64("id").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    placed = facts.withColumn("cell", cell).join(moved, ["text_hash", "size"], "left").withColumn("cell", F.coalesce("home", "cell"))
    key = (F.col("cell") * (1 << own) + same) * (1 << ID_BITS) + spread
    keyed = placed.select("row", "id", "size", "text_crc32", key.alias("key"))

    ends = [i / buckets for i in range(1, buckets)]
    bounds = keyed.select(F.percentile_approx("key", ends, 20 * buckets).alias("b")).first().b or []
    table = F.array(*[F.lit(b).cast("long") for b in sorted(set(bounds))]).cast("array<bigint>")
    # the key is a variable of the expression: else it may be worked out again for each bound
    bucket = F.get(F.transform(F.array("key"), lambda k: F.size(F.filter(table, lambda b: b <= k))), F.lit(0))
    keyed = keyed.withColumn("bucket", bucket)
    counts = sorted(map(tuple, keyed.groupBy("bucket").count().collect()))
    total, firsts = 0, []
    for number, count in counts:
        firsts.append((number, total))
        total += count
    starts = docs.sparkSession.createDataFrame(firsts, "bucket int, first long")
    within = Window.partitionBy("bucket").orderBy("key", "id", "text_crc32", "size")
    ranked = keyed.withColumn("place", F.row_number().over(within) - 1).join(starts, "bucket").withColumn("rank", F.col("first") + F.col("place"))
    shard = F.expr(f"CAST(rank * {shards} DIV {max(total, 1)} AS INT)")
    first = F.expr(f"(CAST(shard AS BIGINT) * {total} + {shards - 1}) DIV {shards}")
    return ranked.withColumn("shard", shard).select("row", "size", "text_crc32", "shard", (F.col("rank") - first).alias("slot"))


def report(docs: DataFrame, shards: int = 24, **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of `docs`."""
    id_col = options.get("id_col", "doc_id")
    return sharded(docs, [id_col], shards, **options).select(
        F.col(f"row.{id_col}").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, **options) -> None:
    """Writes all columns of `docs` as Parquet, a folder per shard, rows in curve order. Columns `shard` and
    `slot` that `docs` may have give way to the new ones."""
    rows = sharded(docs, [c for c in docs.columns if c not in ("shard", "slot")], shards, **options).select("row.*", "shard", "slot")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)

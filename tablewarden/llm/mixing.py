"""Mixing sources to target weights, in fixed-length blocks.

The words of a source are laid end to end and packed into blocks of `BLOCK` words. Each source has a
quota of slots that fills its target; each output shard draws its slots' sources from a multinomial
over what is left of the quotas, so shards vary and totals are met. A source's t-th slot takes block
perm(t mod blocks), where perm is a pseudorandom permutation of the source's block numbers, keyed by
source and pass; slots and blocks are joined by number. Nothing is shuffled at random: every number
follows from the seed, so reruns agree.

Positions within a source are prefix sums over `BUCKETS` buckets of document ids, then within a
bucket, so that a source with most of the rows is not one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablewarden.llm.rows import column, packed as packed_row
from tablewarden.llm.words import mix as scramble

BLOCK = 256
BUCKETS = 1024
SHARDS = 64
RUN = 1 << 16
# One row per source comes to the driver, which works out the targets; more are an error.
MAX_SOURCES = 100_000
ROUNDS = 32
_SPACE = r"\x20\x09-\x0D"
_U = np.uint64


def targets(sizes: list[int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words wanted of each source: `share` of all sizes by weight (repeating), none above `most` times
    its own size; the excess is shared again by weight until none is above."""
    weigh = [weights[i % len(weights)] for i in range(len(sizes))]
    found, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        total = sum(weigh[i] for i in free)
        over = {i for i in free if left * weigh[i] / total > most * sizes[i]}
        if not over:
            for i in free:
                found[i] = left * weigh[i] / total
            break
        for i in over:
            found[i] = most * sizes[i]
            left -= found[i]
        free -= over
    return found


def permuted(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1 (swap or not): each round pairs x with K - x and
    swaps the pair or not by a hash of its larger member, so any n works without retries."""
    rounds = scramble(np.arange(1, 2 * ROUNDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(key & (1 << 64) - 1))
    x = np.asarray(index, dtype=np.int64)
    for r in range(ROUNDS)[:: -1 if inverse else 1]:
        partner = (int(rounds[2 * r]) % n - x) % n
        swap = scramble(np.maximum(x, partner).astype(_U) ^ rounds[2 * r + 1]) >> _U(63) == 1
        x = np.where(swap, partner, x)
    return x


@dataclass(frozen=True)
class Source:
    """A source's place in the mix: `slots` slots fill `words` words; the last takes `last` of its block."""

    index: int
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int
    last: int


def _key(seed: int, index: int, epoch: int) -> int:
    return (seed * 1_000_003 + index) * 1_000_003 + epoch


def _quota(index: int, name: str | None, size: int, target: float, block: int, seed: int) -> Source:
    words = int(target + 0.5)
    if not words or not size:
        return Source(index, name, size, target, 0, 0, 0)
    blocks = -(-size // block)
    epochs, rest = divmod(words, size)
    short = size - (blocks - 1) * block
    if not rest:
        end = int(permuted(np.array([blocks - 1]), blocks, _key(seed, index, epochs - 1))[0])
        return Source(index, name, size, target, blocks, epochs * blocks, short if end == blocks - 1 else block)
    at = int(permuted(np.array([blocks - 1]), blocks, _key(seed, index, epochs), inverse=True)[0])
    if rest <= at * block:
        full, last = divmod(rest - 1, block)
    elif rest <= at * block + short:
        full, last = at, rest - at * block - 1
    else:
        full, last = divmod(rest - short - 1, block)
        full += 1
    return Source(index, name, size, target, blocks, epochs * blocks + full + 1, last + 1)


def shard_counts(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard: multinomial draws over what is left of the quotas."""
    left = np.array(quotas, dtype=np.int64)
    rng = np.random.default_rng(seed)
    rows = []
    for j in range(shards):
        total = int(left.sum())
        wanted = total // (shards - j)
        drawn = np.zeros_like(left)
        while wanted:
            room = left - drawn
            more = np.minimum(rng.multinomial(wanted, room / room.sum()), room)
            drawn += more
            wanted -= int(more.sum())
        rows.append(drawn)
        left -= drawn
    return np.array(rows)


def _slots(seed: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                slots = np.arange(row["first"], row["first"] + row["n"], dtype=np.int64)
                epochs = slots // row["blocks"]
                numbers = np.empty_like(slots)
                for epoch in np.unique(epochs).tolist():
                    own = epochs == epoch
                    numbers[own] = permuted(slots[own] % row["blocks"], row["blocks"], _key(seed, row["src"], epoch))
                take = np.where(numbers == row["blocks"] - 1, row["size"] - (row["blocks"] - 1) * block, block)
                take[slots == row["slots"] - 1] = row["last"]
                same = np.full(len(slots), row["src"], np.int32), np.full(len(slots), row["shard"], np.int32)
                yield pa.record_batch([*map(pa.array, (*same, slots, epochs, numbers, take))], names=["src", "shard", "slot", "epoch", "block", "take"])

    return run


@dataclass(frozen=True)
class Mix:
    """`sources`: the plan. `docs`: the input rows (struct `row`) with size, src, bucket, rank, and start,
    the number of the row's first word within its source. `slots`: the mix, a block number each."""

    sources: list[Source]
    docs: DataFrame
    slots: DataFrame
    block: int

    def taken(self, keep: list[str]) -> DataFrame:
        """A row per document and slot that takes words of it: the kept columns, epoch, shard, slot,
        begin (number of the first word within the document) and words. Documents of which nothing
        is taken have one row with 0 words."""
        last = F.col("start") + F.col("size") - 1
        numbers = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / self.block), F.floor(last / self.block)))
        pieces = self.docs.select("src", "start", "size", *keep, F.explode_outer(numbers).alias("block"))
        low = F.greatest(F.col("block") * self.block, "start")
        high = F.least(F.col("block") * self.block + F.col("take"), F.col("start") + F.col("size"))
        words = F.when(F.col("take").isNotNull(), F.greatest(high - low, F.lit(0)))
        # slots grow with the mix, which their plan's estimated size does not show
        return pieces.join(self.slots.hint("merge"), ["src", "block"], "left").select(
            *keep, "epoch", "shard", "slot", (low - F.col("start")).alias("begin"), F.coalesce(words, F.lit(0)).alias("words")
        )


def _local(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A local table, whose size the optimizer knows."""
    return spark.createDataFrame(pa.table(columns))


def mixed(
    docs: DataFrame, columns: list[str], weights=(5, 2, 1), share=1.5, most=2.0, id_col="doc_id", text_col="text", source_col="source", block=BLOCK, shards=SHARDS, seed=11
) -> Mix:
    """Plans the mix of `docs`. `columns` of it are carried along, packed, so their names cannot clash.

    Sources go by code point, null last, and weigh `weights`, repeating. Null, empty and wordless
    texts have size 0 and no part in the mix. Rows that repeat are laid out each. An empty table
    has no sources and no slots.
    """
    spark = docs.sparkSession
    one = docs.select(
        packed_row(columns),
        F.coalesce(column(source_col), F.lit("")).alias("source"),
        column(source_col).isNull().alias("missing"),
        column(id_col).alias("id"),
        F.coalesce(F.regexp_count(column(text_col), F.lit(f"[^{_SPACE}]+")), F.lit(0)).cast("long").alias("size"),
        F.pmod(F.xxhash64(column(id_col)), F.lit(BUCKETS)).alias("bucket"),
        F.xxhash64(column(text_col)).alias("tie"),
    )
    sums = one.groupBy("source", "missing", "bucket").agg(F.sum("size").alias("words"))
    rows = sums.groupBy("source", "missing").agg(F.sum("words").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.missing, r.source))
    sizes = [r.words for r in rows]
    sources = [_quota(i, None if r.missing else r.source, r.words, t, block, seed) for i, (r, t) in enumerate(zip(rows, targets(sizes, weights, share, most), strict=True))]

    names = _local(spark, src=pa.array([s.index for s in sources], pa.int32()), source=pa.array([s.name or "" for s in sources], pa.string()), missing=pa.array([s.name is None for s in sources], pa.bool_()))
    before = Window.partitionBy("source", "missing").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "missing", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("bucket_start"))
    starts = starts.join(names, ["source", "missing"])
    within = Window.partitionBy("source", "missing", "bucket").orderBy("id", "size", "tie")
    placed = one.withColumn("rank", F.row_number().over(within)).withColumn(
        "before", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )
    # the window has dealt rows by these keys already
    placed = placed.join(starts, ["source", "missing", "bucket"]).select(
        "row", "src", "bucket", "rank", "size", (F.col("bucket_start") + F.col("before")).alias("start")
    )

    active = [s for s in sources if s.slots]
    counts = shard_counts([s.slots for s in active], shards, seed) if active else np.zeros((0, 0), np.int64)
    firsts = np.cumsum(counts, axis=0) - counts
    runs = [
        (s.index, j, int(firsts[j, i]), int(counts[j, i]), s.blocks, s.size, s.slots, s.last)
        for i, s in enumerate(active)
        for j in range(len(counts))
        if counts[j, i]
    ]
    plan = spark.createDataFrame(runs, "src int, shard int, first long, n long, blocks long, size long, slots long, last long")
    parts = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))).alias("skip"))
    parts = parts.withColumns({"first": F.col("first") + F.col("skip"), "n": F.least(F.col("n") - F.col("skip"), F.lit(RUN))}).drop("skip")
    slots = parts.repartition("src", "first").mapInArrow(_slots(seed, block), "src int, shard int, slot long, epoch long, block long, take long")
    return Mix(sources, placed, slots, block)


def report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of `docs`."""
    mix = mixed(docs, [id_col], id_col=id_col, **options)
    facts = _local(
        docs.sparkSession,
        src=pa.array([s.index for s in mix.sources], pa.int32()),
        source_size=pa.array([s.size for s in mix.sources], pa.int64()),
        target=pa.array([s.target for s in mix.sources], pa.float64()),
    )
    keys = ["src", "bucket", "rank", "size", "row"]
    taken = mix.taken(["bucket", "rank", "row", "src", "size"]).groupBy(*keys).agg(F.sum("words").alias("taken"))
    return taken.join(facts, "src").select(F.col(f"row.{id_col}").alias("doc_id"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixture(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix as rows with the columns of `docs`: a row for each run of words taken in one pass over a
    source. A document taken whole keeps its text unchanged; other rows hold the run's words as they
    stand, separators between them included. `length_col` gets the text's length in characters."""
    mix = mixed(docs, docs.columns, text_col=text_col, **options)
    keys = ["src", "bucket", "rank"]
    pieces = mix.taken(keys).where("words > 0").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("epoch", "begin", "words"))).alias("pieces"))
    # neighbouring pieces of a pass make one run
    none = F.array().cast("array<struct<epoch: bigint, begin: bigint, words: bigint>>")

    def add(runs, piece):
        last = F.try_element_at(runs, F.lit(-1))
        joins = (F.size(runs) > 0) & (last.epoch == piece.epoch) & (last.begin + last.words == piece.begin)
        grown = F.struct(last.epoch.alias("epoch"), last.begin.alias("begin"), (last.words + piece.words).alias("words"))
        return F.when(joins, F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(runs, F.array(piece)))

    runs = pieces.select(*keys, F.explode(F.aggregate("pieces", none, add)).alias("run"))
    text = F.col(f"row.`{text_col}`")
    words = F.regexp_extract_all(text, F.lit(f"[{_SPACE}]*[^{_SPACE}]+"), F.lit(0))
    part = F.ltrim(F.array_join(F.slice(words, (F.col("run.begin") + 1).cast("int"), F.col("run.words").cast("int")), ""))
    found = mix.docs.join(runs, keys).select("row", F.when(F.col("run.words") == F.col("size"), text).otherwise(part).alias("new_text"))
    row = F.col("row").withField(text_col, F.col("new_text"))
    if length_col in docs.columns:
        row = row.withField(length_col, F.length("new_text").cast(docs.schema[length_col].dataType))
    return found.select(row.alias("row")).select("row.*")

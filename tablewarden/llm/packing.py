"""Packing documents into sequences of a fixed length: cutting stock by column generation.

A document's tokens are cut into full sequences and a rest. Lengths of rests are counted in units of `UNIT`
tokens, so the histogram has at most capacity / UNIT bars however many documents there are, and the
driver needs nothing else. A pattern says how many rests of each length share a sequence. The linear
program over patterns (fewest sequences that hold the histogram) starts from patterns of one length;
the dual price of each length goes into a knapsack, solved by dynamic programming, whose best
filling is the next pattern, until none is worth more than a sequence or the bound says that less
than `GAP` is left to gain. Fractions are rounded down, what is left over is filled by smallest slack.

Documents are ranked within their length, in parts, so that a length that most have is spread. The plan gives
ranges of ranks to patterns, so each task places its own documents by arithmetic.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablewarden.llm.durable import cut
from tablewarden.llm.rows import column
from tablewarden.llm.words import buffers

CAPACITY = 2048
UNIT = 4
END = 1
GAP = 1e-4
# pivots after which the patterns found so far are taken
PIVOTS = 4000
STEADY = 0.8
REFACTOR = 100
_BYTES, _TEXTS = 1 << 20, 1024
# Fixed value: where byte-level vocabularies of this kind split texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_EPS = 1e-9


# -- the plan -----------------------------------------------------------------------------------------


def knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable filling of `room` with any number of each size (rising), and its value."""
    best, taken = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        n = int(np.searchsorted(sizes, r, side="right"))
        best[r] = best[r - 1]
        if n:
            gains = best[r - sizes[:n]] + values[:n]
            j = int(gains.argmax())
            if gains[j] > best[r] + _EPS:
                best[r], taken[r] = gains[j], j
    counts, r = np.zeros(len(sizes), np.int64), room
    while r > 0:
        if taken[r] < 0:
            r -= 1
        else:
            counts[taken[r]] += 1
            r -= int(sizes[taken[r]])
    return float(best[room]), counts


def _started(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis: rests of more than half a sequence with one that fills it up, all others with their like.
    A filler there is too much of has a column for what is not used, at no cost."""
    basis, cost = np.diag((room // sizes).astype(float)), np.ones(len(sizes))
    for j in np.flatnonzero(2 * sizes > room).tolist():
        i = int(np.searchsorted(sizes, room - sizes[j]))
        if i < len(sizes) and sizes[i] == room - sizes[j]:
            basis[i, j] = 1
            if demand[i] < demand[j]:
                basis[i, i], cost[i] = -1, 0
    return basis, cost


def relaxed(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, in fractions, by the revised simplex method.

    Knapsacks are priced between the present prices and those of the best bound so far, which keeps prices from
    swinging; if that finds nothing, at the present ones."""
    m = len(sizes)
    # demands that differ a little from each other keep pivots from standing still
    need = demand * (1 + 1e-9) + 1e-7 * np.arange(1, m + 1) / m
    basis, cost = _started(sizes, need, room)
    bound, anchor = 0.0, None
    for pivot in range(PIVOTS):
        if pivot % REFACTOR == 0:
            inverse = np.linalg.inv(basis)
            used, price = inverse @ need, cost @ inverse
        entering, own = np.zeros(m), 0.0
        if price.min() < -_EPS:
            entering[price.argmin()] = -1
        else:
            total = float(cost @ used)
            for steady in (STEADY, 0.0) if anchor is not None else (0.0,):
                tried = price if not steady else steady * anchor + (1 - steady) * price
                value, counts = knapsack(sizes, tried, room)
                if tried @ need > bound * max(value, 1.0):
                    bound, anchor = float(tried @ need) / max(value, 1.0), tried / max(value, 1.0)
                if price @ counts > 1 + 1e-7:
                    break
            if price @ counts <= 1 + 1e-7 or total - bound <= GAP * total:
                break
            entering, own = counts.astype(float), 1.0
        some = np.flatnonzero(entering)
        change = (inverse[:, some] * entering[some]).sum(axis=1)
        ratios = np.where(change > 1e-9, np.maximum(used, 0) / np.maximum(change, 1e-9), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        basis[:, out], cost[out] = entering, own
        row = inverse[out] / change[out]
        price = price + (own - float(price @ entering)) * row
        step = float(used[out]) / float(change[out])
        used -= step * change
        used[out] = step
        inverse -= np.outer(change, row)
        inverse[out] = row
    used = np.linalg.solve(basis, demand.astype(float))
    return [(np.rint(basis[:, j]).astype(np.int64), float(used[j])) for j in range(m) if cost[j] and used[j] > _EPS]


def filled(sizes: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """The fullest sequence of what is left that holds the largest rest; of equal ones, that of the largest rests."""
    counts = np.zeros(len(sizes), np.int64)
    first = int(np.flatnonzero(left)[-1])
    counts[first] = 1
    rest = room - int(sizes[first])
    # by[r]: the last size taken to fill exactly r
    by = np.full(rest + 1, -1)
    reached = np.zeros(rest + 1, bool)
    reached[0] = True
    for j in range(first, -1, -1):
        n = int(left[j]) - (j == first)
        size = int(sizes[j])
        for _ in range(min(n, rest // size)):
            new = np.zeros(rest + 1, bool)
            new[size:] = reached[: rest + 1 - size]
            new &= ~reached
            if not new.any():
                break
            by[new] = j
            reached |= new
        if reached[rest]:
            break
    r = int(np.flatnonzero(reached)[-1])
    while r:
        counts[by[r]] += 1
        r -= int(sizes[by[r]])
    return np.minimum(counts, left)


def plan(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, sequences) that hold all of a histogram of sizes 1 to `room`. A pattern is size: number."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n), dtype=np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[s] for s in sizes.tolist()], dtype=np.int64)
    found: dict[tuple, int] = {}

    def use(counts: np.ndarray, times: int) -> None:
        key = tuple(counts.tolist())
        found[key] = found.get(key, 0) + times
        left[:] = np.maximum(left - counts * times, 0)

    patterns = relaxed(sizes, left, room)
    for counts, used in patterns:
        # as often as all of it is needed; what the program has too much of is not used
        held = counts > 0
        times = min(int(used + 1e-6), int((left[held] // counts[held]).min()))
        if times:
            use(counts, times)
    for counts, used in sorted(patterns, key=lambda p: -(p[1] % 1)):
        if (counts <= left).all():
            use(counts, 1)
    while left.any():
        counts = filled(sizes, left, room)
        held = counts > 0
        use(counts, max(1, int((left[held] // counts[held]).min())))
    return [({int(s): n for s, n in zip(sizes, key, strict=True) if n}, times) for key, times in found.items()]


# -- pieces -------------------------------------------------------------------------------------------


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts of about a megabyte at a time, and the first one's row."""
    offsets, _ = buffers(texts)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _BYTES, side="right")) - 1)
        last = min(last, row + _TEXTS, rows)
        yield row, [t or "" for t in texts.slice(row, last - row).to_pylist()]
        row = last


def _byte_ranks(tokenizer) -> dict[bytes, int]:
    """A byte-level vocabulary as ids of byte strings. Such vocabularies spell bytes that cannot be printed as the
    characters from 256 on, in order."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in printed}
    spelled |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printed)))}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    return {bytes(spelled[c] for c in token): i for token, i in tokenizer.get_vocab().items() if token not in special}


class Encoder:
    """The ids that a tokenizer's file gives for texts. Control strings inside texts are text.

    A byte-level vocabulary whose ids rise with its merges is encoded by `tiktoken`, from the same file, at a third
    of the time, as long as it gives the tokenizer's ids for the first `CHECKED` characters that a task reads."""

    CHECKED = 20_000

    def __init__(self, path: str):
        # a task has one core
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.fast, self.checked = None, 0
        kinds = (type(self.tokenizer.model).__name__, type(self.tokenizer.pre_tokenizer).__name__, self.tokenizer.normalizer)
        if kinds == ("BPE", "ByteLevel", None):
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=_byte_ranks(self.tokenizer), special_tokens={})

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast and self.checked < self.CHECKED:
            some = [t[: self.CHECKED] for t in texts]
            self.checked += sum(map(len, some))
            if any(self.fast.encode_ordinary(t) != self.tokenizer.encode(t, add_special_tokens=False).ids for t in some[:64]):
                self.fast = None
        if self.fast:
            return [self.fast.encode_to_numpy(t, disallowed_special=()) for t in texts]
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _cut(path: str, capacity: int, end: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + keep]
        for batch in batches:
            for row, texts in _slices(batch.column("text")):
                ids = batch.column("doc_id").slice(row, len(texts)).to_pylist()
                out: list[tuple] = []
                for doc_id, encoded in zip(ids, encode(texts), strict=True):
                    tokens = np.append(encoded, np.uint32(end)).astype("<u4")
                    for start in range(0, len(tokens), capacity):
                        piece = tokens[start : start + capacity]
                        out.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(tokens), piece)[: 5 + keep])
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * keep
                yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return run


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, keep: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and `ids`, if kept): each document's tokens and an end, in pieces
    of `capacity` and a rest. A null text is empty: it has its end. Texts are tokenized once."""
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<long>" if keep else "")
    return rows.mapInArrow(_cut(path, capacity, end, keep), kinds)


def _placed(shared):
    """Sequence and slot of each piece, from its size and its rank among pieces of that size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, table = shared.value
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("size", "rank"))
            # ranges of ranks, one behind the other, and behind those of smaller sizes
            at = np.searchsorted(starts, (size << 44) + rank, side="right") - 1
            _, base, per, first, slot = table[:, at] if len(rank) else np.zeros((5, 0), np.int64)
            within = rank - base
            sequence, slots = first + within // np.maximum(per, 1), slot + within % np.maximum(per, 1)
            columns = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name not in ("size", "rank")]
            names = [n for n in batch.schema.names if n not in ("size", "rank")]
            yield pa.record_batch([*columns, pa.array(sequence), pa.array(slots)], names=[*names, "sequence_id", "slot"])

    return run


def _ranges(patterns: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each size and pattern: size, first rank, rests a sequence, first sequence, first slot."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        slot = 0
        for size, per in sorted(pattern.items(), reverse=True):
            rows.append((size, used.get(size, 0), per, sequence, slot))
            used[size] = used.get(size, 0) + per * times
            slot += per
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
    return (table[0] << 44) + table[1], table


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, keep: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and `ids`, if kept) of each piece.

    Null texts have their end only; null ids and rows that repeat are packed each. A document of more than
    `capacity` tokens has full pieces and a rest, all others are whole. Other columns are ignored, so
    their names cannot clash. An empty table gives no rows. `path` names a tokenizer's file, which all
    executors have.
    """
    spark = docs.sparkSession
    unit = UNIT if capacity % UNIT == 0 else 1
    room = capacity // unit
    found = cut(pieces(docs, path, id_col, text_col, capacity, end, keep))
    size = F.ceil(F.col("length") / unit).cast("long")
    rows = found.select("*", size.alias("size"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    counts = cut(rows.groupBy("size", "part").agg(F.count("*").alias("n")))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(room, 0)
    patterns = [*plan(histogram, room), ({room: 1}, full)]
    shared = spark.sparkContext.broadcast(_ranges(patterns))

    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("size", "part").orderBy("at")
    ranked = rows.withColumn("place", F.row_number().over(within) - 1).join(firsts, ["size", "part"])
    ranked = ranked.select(*found.columns, "size", (F.col("first") + F.col("place")).alias("rank"))
    kinds = ranked.drop("size", "rank").schema.add("sequence_id", "long").add("slot", "long")
    placed = ranked.mapInArrow(_placed(shared), kinds)
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*found.columns, "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long").alias("offset"))


def sequences(docs: DataFrame, path: str, pad: int = 0, capacity: int = CAPACITY, **options) -> DataFrame:
    """sequence_id, ids (padded), n_tokens: what a trainer reads. A sequence whose length is a power of two is not padded."""
    rows = packed(docs, path, capacity=capacity, keep=True, **options)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    rows = rows.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"), F.sum("length").alias("n_tokens"))
    missing = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(capacity - F.col("n_tokens"))
    return rows.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad).cast("long"), missing.cast("int"))).alias("ids"), "n_tokens")

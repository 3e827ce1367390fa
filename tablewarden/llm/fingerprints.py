"""Document fingerprints by locally consistent parsing.

A text is a sequence of code points. A level of parsing first makes each run of one symbol a symbol,
then cuts the sequence into phrases and names each phrase by a hash of its symbols; the names are the
next level's sequence. Cuts come from deterministic coin tossing: each symbol gets a label, twice the
index of the lowest bit in which it differs from the symbol before it plus that bit, and the labels
are labelled again until few different ones are left; a phrase begins at each local maximum. A cut
depends on a handful of neighbours only, so equal substrings are cut and named alike except at their
ends, wherever they stand.

The fingerprint is the `NAMES` smallest of all distinct names of levels 2 and up, and the likeness of
two fingerprints is the share of common names among the smallest of their union, which estimates the
overlap of the two sets of names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tablewarden.llm.rows import column, packed as packed_row, schema
from tablewarden.llm.words import mix, place_factor

LEVELS = 6
NAMES = 64
BUCKETS_PER_PARTITION = 2
_CHARS = 1 << 19
_TOSSES = 4
_U = np.uint64
_LOWEST_BIT = np.array([(n & -n).bit_length() - 1 if n else 0 for n in range(256)], np.uint8)


def _starts(owner: np.ndarray) -> np.ndarray:
    """Marks the first position of each text."""
    return np.concatenate([[True], owner[1:] != owner[:-1]])


def _grouped(symbols: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """A name for each phrase; `first` marks where phrases begin."""
    at = np.flatnonzero(first)
    place = np.arange(len(symbols)) - np.repeat(at, np.diff(at, append=len(symbols)))
    return mix(np.add.reduceat(mix(symbols + _U(seed)) * place_factor(place), at))


def _phrases(symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Marks where phrases begin. Neighbours within a text differ."""
    begin = _starts(owner)
    # the first toss leaves labels below 128, so that the others work on bytes
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[begin] = ~symbols[begin]
    differ = symbols ^ before
    low = np.bitwise_count((differ & (~differ + _U(1))) - _U(1))
    labels = low * np.uint8(2) + (symbols >> low & _U(1)).astype(np.uint8)
    before = np.empty_like(labels)
    for _ in range(_TOSSES - 1):
        before[1:] = labels[:-1]
        before[begin] = ~labels[begin]
        low = _LOWEST_BIT[labels ^ before]
        labels = low * np.uint8(2) + (labels >> low & np.uint8(1))
    left = np.concatenate([[True], labels[1:] > labels[:-1]])
    right = np.concatenate([labels[:-1] >= labels[1:], [False]])
    # the last symbol of a text must not be compared with the next text
    right[:-1] &= ~begin[1:]
    return begin | (left & right)


def names(symbols: np.ndarray, owner: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """All names of levels 2 and up, and the text each is of. Texts stand one after another."""
    found, owners = [], []
    for level in range(levels):
        if not len(symbols):
            break
        run = _starts(owner) | np.concatenate([[True], symbols[1:] != symbols[:-1]])
        at = np.flatnonzero(run)
        length = np.diff(at, append=len(symbols)).astype(_U)
        symbols, owner = mix(symbols[at] * _U(2 * level + 3) + mix(length)), owner[at]
        first = _phrases(symbols, owner)
        symbols, owner = _grouped(symbols, first, level), owner[first]
        if level:
            found.append(symbols)
            owners.append(owner)
    if not found:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """Sorted 32-bit names of each text; none for an empty one."""
    out: list[np.ndarray] = []
    begin = 0
    while begin < len(texts):
        end, chars = begin + 1, len(texts[begin])
        while end < len(texts) and chars + len(texts[end]) <= _CHARS:
            chars += len(texts[end])
            end += 1
        part = texts[begin:end]
        points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
        found, owner = names(points, np.repeat(np.arange(len(part)), [len(t) for t in part]))
        keyed = np.sort(owner.astype(_U) << _U(32) | found >> _U(32))
        keyed = keyed[np.concatenate([[True], keyed[1:] != keyed[:-1]])] if len(keyed) else keyed
        bounds = np.searchsorted(keyed, np.arange(len(part) + 1, dtype=_U) << _U(32))
        out += [(keyed[a : min(b, a + NAMES)] & _U(0xFFFFFFFF)).astype(">u4") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        begin = end
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated overlap of two sets of names. Two empty fingerprints are alike, one is not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twice = np.concatenate([both[1:] == both[:-1], [False]])
    smallest = np.flatnonzero(np.concatenate([[True], ~twice[:-1]]))[:NAMES]
    return float(np.count_nonzero(twice[smallest])) / len(smallest)


def fingerprinted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`row` (all columns of `docs` as a struct) and `fingerprint`, hexadecimal; a null text is empty."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            found = fingerprints([t or "" for t in row.field(at).to_pylist()])
            yield pa.record_batch([row, pa.array([f.tobytes().hex() for f in found], pa.string())], names=["row", "fingerprint"])

    packed = docs.select(packed_row(docs.columns))
    return packed.mapInArrow(run, schema(packed, "row", after="fingerprint string"))


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many first characters of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _dealt(bounds: list[int], guests: dict[int, list[int]], last: int):
    """Rows (bucket, doc_id, guest, packed text) for the bucket of each id. The first document of a
    bucket is also sent, as a guest, to the bucket whose last document it follows. A null id has
    the bucket `last`, behind all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                ids = part.column(0).to_pylist()
                packed = [pack((t or "").encode("utf-8", "surrogatepass")) for t in part.column(1).to_pylist()]
                home = [last if i is None else -int(np.searchsorted(bounds, i, side="right")) for i in ids]
                rows = [(h, i, False, t) for h, i, t in zip(home, ids, packed, strict=True)]
                rows += [(b, i, True, t) for i, t in zip(ids, packed, strict=True) for b in guests.get(i, ())]
                yield pa.record_batch(
                    [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.bool_(), pa.binary()))],
                    names=["bucket", "doc_id", "guest", "packed"],
                )

    return run


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each document with the next row of its bucket. Holds about a chunk of texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    waiting: list[tuple[int, int | None, bool, str]] = []
    chars = 0

    def flush(rows) -> pa.RecordBatch:
        texts = [r[3] for r in rows]
        pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][2]]
        changed = [edited(texts[i], texts[i + 1]) for i in pairs]
        own, after = fingerprints(texts), fingerprints(changed)
        columns = [
            pa.array([rows[i][1] for i in pairs], pa.int64()),
            pa.array([len(texts[i]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
            pa.array([own[i].tobytes().hex() for i in pairs], pa.string()),
            pa.array([f.tobytes().hex() for f in after], pa.string()),
            pa.array([likeness(own[i], f) for i, f in zip(pairs, after, strict=True)], pa.float64()),
            pa.array([likeness(own[i], own[i + 1]) for i in pairs], pa.float64()),
        ]
        return pa.record_batch(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = unpack(row[3]).decode("utf-8", "surrogatepass") if row[3] else ""
            waiting.append((row[0], row[1], row[2], text))
            chars += len(text)
            if chars > 2 * _CHARS and len(waiting) > 1:
                yield flush(waiting)
                waiting, chars = waiting[-1:], len(text)
    if len(waiting) > 1:
        yield flush(waiting)


def compared_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The next document is that of the next smaller id, after the last the first; rows of equal ids
    follow each other by their texts, and null ids come last. A single document is its own next.
    An empty table gives no rows. Null texts are empty.

    Ids are dealt into ranges by approximate quantiles, so texts are shuffled once, compressed, and
    each task sorts and reads its ranges as a stream. The range bounds and the ids next to them are
    all that the driver sees.
    """
    spark = docs.sparkSession
    ids = docs.select(column(id_col).cast("long").alias("doc_id"))
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = ids.select(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 20 * buckets).alias("b")).first().b or []
    bounds = sorted(set(bounds))
    # ids fall with the bucket's number: -len(bounds) holds the largest
    number = F.lit(0) - F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]).cast("array<bigint>"), lambda b: b <= F.col("doc_id")))
    heads = ids.groupBy(F.when(F.col("doc_id").isNull(), 1).otherwise(number).alias("bucket")).agg(F.max("doc_id").alias("head")).collect()
    order = sorted((r.bucket, r.head) for r in heads)
    return _compare(docs, id_col, text_col, bounds, order)


def _compare(docs: DataFrame, id_col: str, text_col: str, bounds: list[int], order: list[tuple[int, int | None]]) -> DataFrame:
    guests: dict[int | None, list[int]] = {}
    for (bucket, _), (_, head) in zip(order, order[1:] + order[:1], strict=True):
        guests.setdefault(head, []).append(bucket)
    texts = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    dealt = texts.mapInArrow(_dealt(bounds, guests, 1), "bucket int, doc_id long, guest boolean, packed binary")
    # guests stand last in their bucket; of several rows with a head's id, the first is followed
    order_in = ["bucket", "guest", F.col("doc_id").desc_nulls_last(), "packed"]
    rows = dealt.repartition(F.col("bucket")).sortWithinPartitions(*order_in)
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(_paired, kinds)

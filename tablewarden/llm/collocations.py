"""Phrase collocations by external streams of counts.

Only runs of `ORDER` words are counted in the texts: one record a position, padded where the piece of text
ends. A record's words are ids of the words that occur often enough; a rarer word ends a piece, as no
wanted phrase holds it. Each task counts over some hundred thousand tokens at a time and
hands on sorted, packed records; buckets of records by their first three words are merged by
sorting. In prefix order, counts of shorter phrases are sums over neighbouring records. Pairs, of which a bucket
sees only a part, have records of their own.

Then come the two layouts. In prefix order a phrase stands behind all phrases that it begins with, in
suffix order behind all that it ends with. One pass over each sorted stream, with a stack of at most
`ORDER` counts, gives the counts of its first and of its last words, and says of which phrases it is the
extension that occurs as often. Both streams and these notes are brought into one order and merged in
lockstep; nothing is looked up by hashing. A range of a stream lacks only the phrases that its first
phrase begins with: at most ORDER - 1 a range, which are joined to it.

Ids: the `TABLE` most frequent words at most are sent to the tasks as a sorted table; ids fall with their counts,
so that records, laid out by byte, compress well. If there are more words that are frequent enough, those
beyond go by their own 64-bit hash, as do rare words, which then drop out after counting instead of
before; results are the same. Texts of words are only looked up for the phrases that are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablewarden.llm.durable import cut
from tablewarden.llm.rows import column
from tablewarden.llm.words import buffers, mix, place_factor

ORDER = 5
LEAST = 100
TOP = 2000
UNKNOWN = "und"
# words in the table of ids: 64 MB of hashes
TABLE = 1 << 23
FLUSH = 1 << 21
# records of a bucket, about; and buckets dealt at once, beyond which they are dealt in two rounds
BUCKET = 1 << 20
FAN = 1 << 10
CHUNK = 1 << 19
_U = np.uint64
_OWN = _U(1 << 63)
_SEPARATOR = np.zeros(256, dtype=bool)
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*map(ord, ".,;:!?"), *range(10, 14)]] = True
_SEPARATOR[[32, 9]] = True
_SEPARATOR |= _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHARE = np.where(_SEPARATOR, 0, _LOWER.astype(_U) + _U(1))
_FACTORS = mix(np.arange(1, 4, dtype=_U)) | _U(1)


# -- words --------------------------------------------------------------------------------------------


def _chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes of about CHUNK, where each text begins in them, and the first text's row. A longer text comes in
    parts that end at breaks, which no phrase crosses."""
    offsets, data = buffers(texts)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        low, high = int(offsets[row]), int(offsets[last])
        if high - low <= CHUNK:
            yield data[low:high], offsets[row:last] - low, row
        while high - low > CHUNK:
            end = _break(data, low + CHUNK, high)
            yield data[low:end], np.zeros(1, np.int64), row
            low = end
            if high - low <= CHUNK:
                yield data[low:high], np.zeros(1, np.int64), row
        row = last


def _break(data: np.ndarray, begin: int, end: int) -> int:
    """The first break from `begin` on."""
    while begin < end:
        found = np.flatnonzero(_BREAK[data[begin : min(begin + CHUNK, end)]])
        if len(found):
            return begin + int(found[0])
        begin += CHUNK
    return end


def _words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of adjacent texts: each word's first byte, its hash, its piece (rising), and its text."""
    word = ~_SEPARATOR[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    inner = begins[(begins > 0) & (begins < len(data))]
    start[inner] = word[inner]
    starts = np.flatnonzero(start)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, _U), none, none
    rest = data[starts[0] :]
    position = np.arange(len(rest), dtype=np.int64)
    position -= np.repeat(starts - starts[0], np.diff(starts, append=len(data)))
    hashes = mix(np.add.reduceat(place_factor(position) * _SHARE[rest], starts - starts[0]))
    breaks = _BREAK[data].astype(np.int64)
    owner = np.searchsorted(begins, starts, side="right") - 1
    return starts, hashes, np.cumsum(breaks)[starts] + owner, owner


def _text(data: np.ndarray, start: int) -> str:
    """The word that begins at a byte."""
    end, step = start, 64
    while True:
        gaps = np.flatnonzero(_SEPARATOR[data[end : end + step]])
        if len(gaps):
            end += int(gaps[0])
            break
        if end + step >= len(data):
            end = len(data)
            break
        end, step = end + step, 2 * step
    return _LOWER[data[start:end]].tobytes().decode("utf-8", "replace")


class _Languages:
    """A key of words for each language; words of two languages have nothing in common."""

    def __init__(self):
        self.keys: dict[str, np.uint64] = {}

    def of(self, names: list[str]) -> np.ndarray:
        for name in set(names) - self.keys.keys():
            data = np.frombuffer(name.encode("utf-8", "surrogatepass"), np.uint8)
            value = (place_factor(np.arange(len(data))) * (data.astype(_U) + _U(1))).sum(dtype=_U)
            self.keys[name] = mix(np.array([value + _U(len(data) + 1)]))[0]
        return np.array([self.keys[n] for n in names], dtype=_U)


def _keys(hashes: np.ndarray, language: np.ndarray) -> np.ndarray:
    return mix(hashes * _FACTORS[0] + language * _FACTORS[1]) & ~_OWN


def _batches(batches: Iterator[pa.RecordBatch], languages: _Languages):
    """Per chunk: bytes, languages by text, and each word's first byte, key, piece and text."""
    for batch in batches:
        texts, names = batch.column("text"), batch.column("lang")
        for data, begins, row in _chunks(texts):
            lang = names.slice(row, len(begins)).to_pylist()
            starts, hashes, pieces, owner = _words(data, begins)
            yield data, lang, starts, _keys(hashes, languages.of(lang)[owner]) if len(starts) else hashes, pieces, owner


# -- packed records -----------------------------------------------------------------------------------

_PACKED = "kind int, bucket long, packed binary"


def _planes(values: np.ndarray) -> bytes:
    """The lowest bytes of all values, then the next and so on."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _pack(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Sorted records, column by column, compressed; behind their number and the bytes of an id."""
    raw = b"".join([*map(_planes, columns), _planes(counts.astype(_U))])
    head = len(counts).to_bytes(8, "little") + bytes([columns[0].itemsize])
    return head + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _unpack(packed: bytes, width: int) -> list[np.ndarray]:
    """The columns and the counts."""
    n, size = int.from_bytes(packed[:8], "little"), packed[8]
    sizes = [size] * width + [8]
    raw = np.frombuffer(pa.Codec("zstd").decompress(packed[9:], n * sum(sizes), asbytes=True), np.uint8)
    ends = np.cumsum([0, *sizes]) * n
    parts = [np.ascontiguousarray(raw[a:b].reshape(-1, n).T) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [part.view(np.uint32 if size == 4 else _U).ravel() for part, size in zip(parts, sizes, strict=True)]


def _merged(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal records once, sorted by the first column, then the second and so on, with their counts added up."""
    if len(columns[0]) == 0:
        return columns, np.zeros(0, np.int64)
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    total = np.diff(first, append=len(order)) if counts is None else np.add.reduceat(counts[order].astype(np.int64), first)
    return [c[first] for c in columns], total


def _bucket(columns: list[np.ndarray], kind: int, bits: int) -> np.ndarray:
    """The bucket of each record: by language and key (words), both ids (pairs), the first three ids (runs)."""
    value = sum((c * f for c, f in zip(columns[: 3 if kind == 2 else 2], _FACTORS)), np.zeros(1, _U))
    return (mix(value) >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(columns[0]), np.int64)


def _split(columns: list[np.ndarray], counts: np.ndarray, kind: int, bits: int) -> Iterator[tuple[int, int, bytes]]:
    """Records by bucket, each part sorted as they are."""
    if not len(counts):
        return
    bucket = _bucket(columns, kind, bits)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
        part = order[a:b]
        yield kind, int(bucket[part[0]]), _pack([c[part] for c in columns], counts[part])


def _packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["kind", "bucket", "packed"])


_WIDTH = (2, 2, ORDER)


def _redealt(bits: int):
    """Parts of coarse buckets as parts of fine ones, over as many records at a time as fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0

        def flush() -> pa.RecordBatch:
            arrays = [np.concatenate(c) for c in zip(*held, strict=True)]
            columns, counts = _merged(arrays[:-1], arrays[-1])
            return _packed_batch(list(_split(columns, counts, at[0], bits)))

        for batch in batches:
            for kind, bucket, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == _LANGUAGES:
                    yield _packed_batch([(kind, bucket, packed)])
                    continue
                if held and ((kind, bucket) != at or size >= FLUSH):
                    yield flush()
                    held, size = [], 0
                at = kind, bucket
                held.append(_unpack(packed, _WIDTH[kind]))
                size += len(held[-1][0])
        if held:
            yield flush()

    return run


def _gathered(dealt: DataFrame, bits: int, coarse: int) -> DataFrame:
    """Parts of a bucket side by side, in the number of buckets that is wanted."""
    if bits > coarse:
        # parts of one coarse bucket only have to meet in numbers, not in one task
        spread = dealt.repartition("kind", "bucket", F.pmod(F.xxhash64("packed"), F.lit(1 << (bits - coarse)))).sortWithinPartitions("kind", "bucket")
        dealt = spread.mapInArrow(_redealt(bits), _PACKED)
    return dealt.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")


def _each_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """Kind, columns and counts of one bucket after the other, merged."""
    at, held = None, []

    def merged():
        arrays = [np.concatenate(c) for c in zip(*held, strict=True)]
        return (at[0], *_merged(arrays[:-1], arrays[-1]))

    for batch in batches:
        for kind, bucket, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (kind, bucket) != at:
                yield merged()
                held = []
            at = kind, bucket
            held.append(_unpack(packed, _WIDTH[kind]))
    if held:
        yield merged()


def _bits(records: int) -> int:
    return max(0, -(-records // BUCKET) - 1).bit_length()


# -- counting -----------------------------------------------------------------------------------------


# rows that name the languages, and the words of each
_LANGUAGES = 3


def _count_words(bits: int):
    """Records of words (key of the language, key), and the languages' totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = _Languages()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        totals: dict[str, int] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            return _packed_batch(list(_split(*_merged([np.concatenate(c) for c in zip(*held, strict=True)]), 0, bits)))

        for _, lang, _, keys, _, owner in _batches(batches, languages):
            held.append((languages.of(lang)[owner], keys))
            size += len(keys)
            for name, n in zip(lang, np.bincount(owner, minlength=len(lang)).tolist(), strict=True):
                totals[name] = totals.get(name, 0) + n
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()
        rows = [(_LANGUAGES, 0, n.to_bytes(8, "little") + name.encode("utf-8", "surrogatepass")) for name, n in totals.items()]
        yield _packed_batch(rows)

    return run


_WORDS = "level int, n long, langs binary, keys binary, counts binary, lang string"


def _frequent(least: int):
    """The keys and counts of the words that occur often enough, packed by count level (powers of two); and the words
    of each language (level null)."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string())
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["level", "n", "langs", "keys", "counts", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(parts: Iterator[pa.RecordBatch], totals: dict[str, int]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                own = batch.column("kind").to_numpy() == _LANGUAGES
                for packed in batch.column("packed").filter(pa.array(own)).to_pylist():
                    name = packed[8:].decode("utf-8", "surrogatepass")
                    totals[name] = totals.get(name, 0) + int.from_bytes(packed[:8], "little")
                yield batch.filter(pa.array(~own))

        totals: dict[str, int] = {}
        for _, (langs, keys), counts in _each_bucket(counted(batches, totals)):
            levels = np.where(counts >= least, np.frexp(counts.astype(np.float64))[1], 0)
            rows = []
            for level in np.unique(levels[levels > 0]).tolist():
                at = levels == level
                rows.append((level, int(at.sum()), langs[at].tobytes(), keys[at].tobytes(), counts[at].tobytes(), None))
            yield batch_of(rows)
        yield batch_of([(None, n, None, None, None, name) for name, n in totals.items()])

    return run


def _ids(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray], complete: bool) -> np.ndarray:
    """Each word's id, from 1, by a table of sorted keys. Others are 0 if the table has all words wanted, else they keep
    their key, marked."""
    known, ids = table
    if not len(known):
        return np.zeros(len(keys), np.uint32) if complete else keys | _OWN
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    found = known[at] == keys
    return np.where(found, ids[at], np.uint32(0)) if complete else np.where(found, ids[at].astype(_U), keys | _OWN)


def _count_runs(shared, bits: int):
    """Records of pairs and of runs of ORDER words, padded with 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, complete = shared.value
        pairs: list[list[np.ndarray]] = []
        runs: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for kind, held in ((1, pairs), (2, runs)):
                columns, counts = _merged([np.concatenate(c) for c in zip(*held, strict=True)])
                rows += _split(columns, counts, kind, bits)
                held.clear()
            return _packed_batch(rows)

        for _, _, _, keys, pieces, _ in _batches(batches, _Languages()):
            ids = _ids(keys, table, complete)
            n = len(ids)
            columns, alive = [ids], ids > 0
            for k in range(1, ORDER):
                following = np.zeros(n, ids.dtype)
                if n > k:
                    alive = np.concatenate([alive[: n - k] & (pieces[k:] == pieces[: n - k]) & (ids[k:] > 0), np.zeros(k, bool)])
                    following[: n - k] = ids[k:] * alive[: n - k]
                columns.append(following)
            two, three = columns[1] > 0, columns[2] > 0
            pairs.append([c[two] for c in columns[:2]])
            runs.append([c[three] for c in columns])
            size += int(two.sum())
            if size >= FLUSH:
                yield flush()
                size = 0
        if pairs:
            yield flush()

    return run


def _phrases(least: int):
    """(ids, f) of the phrases of two words and more that occur often enough, from merged buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, columns, counts in _each_bucket(batches):
            for k in (2,) if kind == 1 else range(3, ORDER + 1):
                # a record that ends before its k-th word has 0 there
                held = columns[k - 1] > 0
                if not held.any():
                    continue
                own, n = [c[held] for c in columns[:k]], counts[held]
                new = np.zeros(len(n), bool)
                new[0] = True
                for c in own:
                    new[1:] |= c[1:] != c[:-1]
                first = np.flatnonzero(new)
                total = np.add.reduceat(n, first)
                first, total = first[total >= least], total[total >= least]
                flat = np.stack([c[first] for c in own], axis=1).ravel().astype(_U).view(np.int64)
                ends = pa.array(np.arange(len(first) + 1, dtype=np.int32) * k)
                yield pa.record_batch([pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array(total)], names=["ids", "f"])

    return run


# -- streams of counts --------------------------------------------------------------------------------


def _stream(shared, side: int):
    """Of each phrase the counts of the phrases that it begins with, shortest first; and a note (side 2) on each that it
    extends and occurs as often as. In suffix order all phrases are turned round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = None
        for batch in batches:
            out: list[tuple] = []
            for ids, f in zip(batch.column("ids").to_pylist(), batch.column("f").to_pylist(), strict=True):
                if stack is None:
                    stack = list(shared.value.get(tuple(ids), ()))
                while stack and stack[-1][0] != ids[: len(stack[-1][0])]:
                    stack.pop()
                own = ids if side == 0 else ids[::-1]
                if len(ids) > 1:
                    out.append((own, side, f, [n for _, n in stack]))
                    if stack[-1][1] == f and len(ids) > 2:
                        out.append((own[:-1] if side == 0 else own[1:], 2, f, None))
                stack.append((ids, f))
            kinds = (pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["ids", "side", "f", "parts"])

    return run


_STREAM = "ids array<long>, side int, f long, parts array<long>"


def _layout(grams: DataFrame, side: int) -> DataFrame:
    """One stream in prefix order (side 0) or suffix order (side 1)."""
    context = grams.sparkSession.sparkContext
    own = grams if side == 0 else grams.select(F.reverse("ids").alias("ids"), "f")
    laid = cut(own.repartitionByRange("ids").sortWithinPartitions("ids"))
    # at most ORDER - 1 phrases for each range of the stream
    firsts = laid.groupBy(F.spark_partition_id()).agg(F.min("ids").alias("first")).where(F.size("first") > 1)
    firsts = firsts.select("first", F.explode(F.transform(F.sequence(F.lit(1), F.size("first") - 1), lambda k: F.slice("first", F.lit(1), k))).alias("ids"))
    before: dict[tuple, list] = {}
    for row in sorted(laid.join(firsts, "ids").select("first", "ids", "f").collect(), key=lambda r: len(r.ids)):
        before.setdefault(tuple(row.first), []).append((row.ids, row.f))
    return laid.mapInArrow(_stream(context.broadcast(before), side), _STREAM)


def _lockstep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ids, f, cuts) of each phrase that no longer one takes in, from both streams and the notes in one order."""
    waiting: list[tuple] = []

    def merged(rows: list[tuple]) -> list[tuple]:
        if len(rows) > 2:
            return []
        (ids, _, f, firsts), (_, _, _, lasts) = rows
        return [(ids, f, [{"k": k, "l": left, "r": right} for k, left, right in zip(range(1, len(ids)), firsts, reversed(lasts), strict=True)])]

    def emitted(found: list[tuple]) -> pa.RecordBatch:
        cuts = pa.list_(pa.struct([("k", pa.int32()), ("l", pa.int64()), ("r", pa.int64())]))
        return pa.record_batch([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.list_(pa.int64()), pa.int64(), cuts))], names=["ids", "f", "cuts"])

    for batch in batches:
        found = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("ids", "side", "f", "parts")), strict=True):
            if waiting and waiting[0][0] != row[0]:
                found += merged(waiting)
                waiting = []
            waiting.append(row)
        yield emitted(found)
    if waiting:
        yield emitted(merged(waiting))


# -- the whole job ------------------------------------------------------------------------------------


def _named(shared, wanted):
    """(id, word): where a wanted id's word was first seen in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, complete), missing = shared.value, wanted.value.copy()
        for data, _, starts, keys, _, owner in _batches(batches, _Languages()):
            ids = _ids(keys, table, complete).astype(_U)
            known = ids & _OWN == 0
            new = np.flatnonzero(~known | missing[np.where(known, ids, 0).astype(np.int64)])
            own, at = np.unique(ids[new], return_index=True)
            missing[own[own & _OWN == 0].astype(np.int64)] = False
            words = [_text(data[: _end(data, starts, p)], int(starts[p])) for p in new[at].tolist()]
            yield pa.record_batch([pa.array(own.view(np.int64)), pa.array(words, pa.string())], names=["id", "word"])

    return run


def _end(data: np.ndarray, starts: np.ndarray, place: int) -> int:
    """Where the word at a place ends at the latest: where the next word of the chunk begins."""
    return int(starts[place + 1]) if place + 1 < len(starts) else len(data)


class Counts:
    """What is counted in texts: `grams` (ids, f), the phrases of 1 to ORDER words that occur `least` times or more;
    `words` (id, lang), the frequent words; `languages` (lang, n), each one's words. `texts` has what they
    were counted in, `shared` the table of ids."""

    def __init__(self, docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang"):
        spark = docs.sparkSession
        texts = docs.select(F.coalesce(column(text_col), F.lit("")).alias("text"), F.coalesce(column(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))
        # about four bytes a word; only the number of buckets depends on it
        tokens = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 4
        bits = _bits(tokens)
        coarse = min(bits, FAN.bit_length() - 1)

        counted = texts.mapInArrow(_count_words(coarse), _PACKED)
        found = cut(_gathered(counted, bits, coarse).mapInArrow(_frequent(least), _WORDS))
        self.languages = found.where("level IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
        names = self.languages.select("lang").toLocalIterator()
        keyed = _Languages()
        named = [(r.lang, int(keyed.of([r.lang]).view(np.int64)[0])) for r in names]
        of_key = spark.createDataFrame(named, "lang string, lang_key long")

        words = found.where("level IS NOT NULL")
        level, room = 64, TABLE
        sizes = sorted(((r.level, r.n) for r in words.groupBy("level").agg(F.sum("n").alias("n")).collect()), reverse=True)
        complete = sum(n for _, n in sizes) <= TABLE
        for at, n in sizes:
            if n > room:
                break
            level, room = at, room - n
        kept = [(bytes(r["keys"]), bytes(r["counts"])) for r in words.where(F.col("level") >= level).select("keys", "counts").toLocalIterator()]
        keys, numbers = np.frombuffer(b"".join(k for k, _ in kept), _U), np.frombuffer(b"".join(c for _, c in kept), np.int64)
        ids = np.empty(len(keys), np.uint32)
        ids[np.lexsort((keys, -numbers))] = np.arange(1, len(keys) + 1, dtype=np.uint32)
        order = np.argsort(keys)
        self.table_size = len(keys)
        self.texts, self.shared = texts, spark.sparkContext.broadcast(((keys[order], ids[order]), complete))
        shared = self.shared

        def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, _ = shared.value
            for batch in batches:
                for langs, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("langs", "keys", "counts")), strict=True):
                    # all of these occur often enough; those beyond the table keep their key
                    own = _ids(np.frombuffer(keys, _U), table, False).view(np.int64)
                    columns = [pa.array(own), pa.array(np.frombuffer(langs, np.int64)), pa.array(np.frombuffer(counts, np.int64))]
                    yield pa.record_batch(columns, names=["id", "lang_key", "f"])

        singles = cut(words.select("langs", "keys", "counts").mapInArrow(single, "id long, lang_key long, f long"))
        self.words = singles.join(of_key, "lang_key").select("id", "lang")
        dealt = texts.mapInArrow(_count_runs(shared, coarse), _PACKED)
        longer = _gathered(dealt, bits, coarse).mapInArrow(_phrases(least), "ids array<long>, f long")
        self.grams = cut(singles.select(F.array("id").alias("ids"), "f").unionByName(longer))

    def named(self, phrases: DataFrame) -> DataFrame:
        """(id, word) of the words of phrases (ids), from one more pass over the texts."""

        wanted = np.zeros(self.table_size + 1, bool)
        ids = phrases.select(F.explode("ids").alias("id")).where("id > 0").distinct().toArrow().column("id")
        wanted[ids.to_numpy()] = True
        seen = self.texts.mapInArrow(_named(self.shared, self.texts.sparkSession.sparkContext.broadcast(wanted)), "id long, word string")
        return seen.groupBy("id").agg(F.min("word").alias("word"))


def collocations(docs: DataFrame, least: int = LEAST, top: int | None = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to 5 words, or all (`top` None).

    A null text is empty, a null language is `und`. Texts without words add nothing; rows that repeat
    count each. An empty table gives no rows. Other columns are ignored. Counts are exact but for 64-bit
    hashes of words that coincide; the score is worked out in decimals of 38 digits.
    """
    counts = Counts(docs, least, text_col, lang_col)
    streams = _layout(counts.grams, 0).unionByName(_layout(counts.grams, 1))
    merged = streams.repartitionByRange("ids").sortWithinPartitions("ids", "side").mapInArrow(_lockstep, "ids array<long>, f long, cuts array<struct<k: int, l: long, r: long>>")

    scored = merged.join(counts.words, F.col("ids")[0] == F.col("id")).join(counts.languages, "lang")
    wide = lambda c: c.cast("decimal(19,0)")
    each = F.transform(
        "cuts",
        lambda c: F.struct(
            F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide(F.col("f")) * wide(F.col("n")), wide(c.l) * wide(c.r)).alias("score"), c.k.alias("k"), c.l.alias("l"), c.r.alias("r")
        ),
    )
    best = scored.select("lang", "ids", F.col("f").alias("a"), "n", F.array_min(each).alias("cut")).select("lang", "ids", "a", "cut.l", "cut.r", "n", "cut.score")
    if top is not None:
        # ties at the end of the list stay until their texts are known
        place = F.rank().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc()))
        best = best.withColumn("place", place).where(F.col("place") <= top).drop("place")
    best = cut(best)

    rows = best.withColumn("at", F.monotonically_increasing_id())
    parts = rows.select("at", F.posexplode("ids").alias("place", "id")).join(counts.named(best), "id")
    phrase = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x.word), " ")
    ranked = rows.join(parts.groupBy("at").agg(phrase.alias("phrase")), "at")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase")))
    ranked = ranked.withColumn("rank", rank)
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

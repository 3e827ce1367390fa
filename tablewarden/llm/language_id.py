"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its letters by multiplication,
each permuted (rotated) by its place; a text's vector bundles (adds) the vectors of its trigrams. A
language's prototype bundles all texts it is learned from. A text gets the language whose prototype
has the largest cosine with the text's vector.

Trigrams lie within words; a word's start and end count as a letter. All cases of a letter are one.
Every letter of every script has its own vector, drawn by a seeded hash of its code point, so no table
of letters is kept or sent. Batches are worked off in chunks of bounded size; a longer text is cut where
no letter stands, which leaves its trigrams as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewarden.llm.rows import packed as packed_row, schema
from tablewarden.llm.words import buffers, mix

DIMENSIONS = 1024
SEED = 7
# Prototypes are sent to every executor; labels beyond this number are no languages.
MAX_LANGUAGES = 8192
UNKNOWN = "und"
_BYTES, _TEXTS, _BLOCK = 1 << 20, 512, 4096
_POINT = 21  # bits of a code point
_U = np.uint64


def _symbol(letter: str) -> int:
    return ord(letter.lower()[0])


class Encoder:
    """Turns texts into vectors. One per task: it keeps a table of symbols."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.table = np.array([_symbol(chr(c)) if chr(c).isalpha() else 0 for c in range(1 << 16)], dtype=np.int64)

    def letters(self, points: np.ndarray) -> np.ndarray:
        """The vector of each code point, 0 being a word's edge."""
        words = -(-self.dimensions // 64)
        seeds = points.astype(_U)[:, None] * _U(words) + np.arange(words, dtype=_U) + _U(SEED << 40)
        bits = np.unpackbits(mix(mix(seeds)).view(np.uint8).reshape(len(points), -1), axis=1)[:, : self.dimensions]
        return bits.astype(np.int8) * 2 - 1

    def symbols(self, text: str) -> np.ndarray:
        """A symbol per letter; a run of anything else is one 0, also at both ends."""
        points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        values = self.table[np.minimum(points, 0xFFFF)]
        for i in np.flatnonzero(points > 0xFFFF).tolist():
            values[i] = _symbol(chr(points[i])) if chr(points[i]).isalpha() else 0
        return values[np.concatenate([[True], (values[1:] != 0) | (values[:-1] != 0)])]

    def trigrams(self, text: str) -> np.ndarray:
        s = self.symbols(text)
        codes = (s[:-2] << 2 * _POINT) | (s[1:-1] << _POINT) | s[2:]
        return codes[s[1:-1] != 0]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """A row per trigram code: the bound, permuted letter vectors."""
        low = (1 << _POINT) - 1
        parts = np.stack([codes >> 2 * _POINT, codes >> _POINT & low, codes & low])
        points, index = np.unique(parts, return_inverse=True)
        index = index.reshape(parts.shape)
        letters = self.letters(points)
        first, middle = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
        return first[index[0]] * middle[index[1]] * letters[index[2]]

    def bundles(self, texts: list[str]) -> np.ndarray:
        """A row per text: the sum of its trigrams' vectors, exact in 64 bits."""
        return self.summed(texts, np.arange(len(texts)), len(texts))

    def summed(self, texts: list[str], owners: np.ndarray, size: int) -> np.ndarray:
        """A row per owner: the sum of the vectors of all trigrams of its texts."""
        parts = [self.trigrams(t) for t in texts]
        total = np.zeros((size, self.dimensions))
        if not parts:
            return total
        owner = np.repeat(owners, [len(p) for p in parts])
        codes, index = np.unique(np.concatenate(parts), return_inverse=True)
        order = np.argsort(index, kind="stable")
        owner, index = owner[order], index[order]
        # a block of trigrams at a time, as a script may have very many
        for begin in range(0, len(codes), _BLOCK):
            block = codes[begin : begin + _BLOCK]
            low, high = np.searchsorted(index, [begin, begin + len(block)])
            counts = np.bincount(owner[low:high] * len(block) + index[low:high] - begin, minlength=size * len(block))
            total += counts.reshape(size, -1).astype(np.float32) @ self.vectors(block).astype(np.float32)
        return total


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """Chunks of about a megabyte: the first row, texts, and the row in the chunk of each. A text that is
    longer than a chunk comes in parts, as chunks of their own, cut where no letter stands."""
    offsets, _ = buffers(texts)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _BYTES, side="right")) - 1)
        last = min(last, row + _TEXTS, rows)
        part = [t or "" for t in texts.slice(row, last - row).to_pylist()]
        if last == row + 1 and len(part[0]) > _BYTES:
            for piece in _pieces(part[0]):
                yield row, [piece], np.zeros(1, np.int64)
        else:
            yield row, part, np.arange(len(part))
        row = last


def _pieces(text: str) -> Iterator[str]:
    begin = 0
    while begin < len(text):
        end = min(begin + _BYTES, len(text))
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[begin:end]
        begin = end


def learn(texts: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, list[int]]:
    """The prototype of each language, from columns `text` and `lang`; rows with a null are left out.

    Exact sums of integers, so the result does not depend on partitions. A task holds a chunk of text
    and a vector per language. One row per language and task is shuffled; the driver gets a vector
    per language, of which there are at most MAX_LANGUAGES (more are an error, as `lang` then holds
    something else).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dimensions)
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for row, part, _ in _chunks(batch.column(0)):
                langs = batch.column(1).slice(row, len(part)).to_pylist()
                names = sorted(set(langs))
                place = {name: i for i, name in enumerate(names)}
                sums = encoder.summed(part, np.array([place[lang] for lang in langs]), len(names)).astype(np.int64)
                for name, vector in zip(names, sums, strict=True):
                    totals[name] = totals[name] + vector if name in totals else vector
        for lang, vector in totals.items():
            yield pa.record_batch([pa.array([lang]), pa.array([vector.tolist()], pa.list_(pa.int64()))], names=["lang", "vector"])

    parts = texts.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(run, "lang string, vector array<long>")
    sums = parts.select("lang", F.posexplode("vector").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).value.alias("vector")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r.lang: r.vector for r in sorted(rows, key=lambda r: r.lang)}


def identify(docs: DataFrame, prototypes: dict[str, list[int]], text_col: str = "text") -> DataFrame:
    """Columns `row` (all columns of `docs` as a struct, so names cannot clash), `lang_pred`, `score`.

    `score` is the cosine with the prototype, 0 where it is negative. A null text, one without a
    letter, and any text while there are no prototypes get `und` and 0. Of equal cosines the
    language first in code point order wins. Whole texts are read; each text's result depends on
    nothing but its text.
    """
    names = list(prototypes)
    size = len(prototypes[names[0]]) if names else DIMENSIONS
    table = np.array(list(prototypes.values()), dtype=np.float64).reshape(len(names), size)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-300)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = Encoder(size), shared.value
        for batch in batches:
            row = batch.column(0)
            best, scores = np.zeros(len(row), np.int64), np.zeros(len(row))
            at, bundle = -1, np.zeros((0, size))
            for begin, part, owners in _chunks(row.field(text_at)) if names else ():
                found = encoder.summed(part, owners, len(part))
                # parts of one text add up
                at, bundle = begin, bundle + found if begin == at else found
                norm = np.linalg.norm(bundle, axis=1)
                cosines = bundle @ table.T / np.maximum(norm, 1e-300)[:, None]
                rows = slice(begin, begin + len(part))
                best[rows] = np.where(norm > 0, cosines.argmax(axis=1), -1)
                scores[rows] = np.where(norm > 0, np.clip(cosines.max(axis=1), 0, 1), 0)
            found = [names[b] if names and b >= 0 else UNKNOWN for b in best.tolist()]
            yield pa.record_batch([row, pa.array(found, pa.string()), pa.array(scores)], names=["row", "lang_pred", "score"])

    packed = docs.select(packed_row(docs.columns))
    return packed.mapInArrow(run, schema(packed, "row", after="lang_pred string, score double"))


def held_out(doc_id: str, folds: int = 5, fold: int = 0):
    """Whether a document is kept out of learning: its id's checksum decides; a null id is kept out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(True))

"""Words of whole Arrow string columns as 64-bit hashes, without a Python object per word.

A word is a longest run of bytes other than space and \\x09-\\x0D, lower-cased in A-Z only. A column is
worked off in chunks of about 128 KB, which stay in a core's cache, so memory does not grow with the batch; a longer text is
hashed in parts that end at a separator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 17
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
# a byte's share of its word's hash; separators have none
_SHARE = np.where(_SPACE, 0, _LOWER.astype(_U) + _U(1))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that nearby inputs get unrelated outputs."""
    values = values ^ (values >> _U(30))
    values = values * _U(0xBF58476D1CE4E5B9)
    values = values ^ (values >> _U(27))
    values = values * _U(0x94D049BB133111EB)
    return values ^ (values >> _U(31))


_PLACES = mix(np.arange(1, (1 << 12) + 1, dtype=_U)) | _U(1)


def place_factor(position: np.ndarray) -> np.ndarray:
    """A factor for each position within a word or phrase."""
    if not len(position) or position.max() <= 0xFFF:
        return _PLACES[position]
    return _PLACES[position & 0xFFF] + (position >> 12).astype(_U) * _U(0x9E3779B97F4A7C16)


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and UTF-8 bytes of a string column. A null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def _hash(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of adjacent texts, and the index of each text's first word."""
    word = ~_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = bounds[:-1][bounds[:-1] < len(data)]
    start[first] = word[first]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(bounds), np.int64)
    data, starts_here = data[starts[0] :], (starts - starts[0]).astype(np.int32)
    position = np.arange(len(data), dtype=np.int32)
    position -= np.repeat(starts_here, np.diff(starts_here, append=np.int32(len(data))))
    values = place_factor(position) * _SHARE[data]
    return mix(np.add.reduceat(values, starts - starts[0])), np.searchsorted(starts, bounds)


def hashed_words(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per chunk: its first row, its word hashes, and where each row's words begin (one bound more)."""
    offsets, data = buffers(texts)
    row = 0
    while row < len(offsets) - 1:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        low, high = offsets[row], offsets[last]
        if high - low <= CHUNK:
            yield row, *_hash(data[low:high], offsets[row : last + 1] - low)
        else:
            ids = np.concatenate([_hash(part, np.array([0, len(part)]))[0] for part in _parts(data[low:high])])
            yield row, ids, np.array([0, len(ids)])
        row = last


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of about a chunk; no word is cut."""
    begin = 0
    while begin < len(data):
        end, step = begin + CHUNK, CHUNK
        while end < len(data):
            gaps = np.flatnonzero(_SPACE[data[end : end + step]])
            if len(gaps):
                end += int(gaps[0])
                break
            end, step = end + step, 2 * step
        yield data[begin : min(end, len(data))]
        begin = end

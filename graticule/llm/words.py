"""Whole Arrow batches of text to word positions and 64-bit word hashes, without a Python loop over words.

A word is a maximal run of bytes outside space, tab, line feed, vertical tab, form
feed and carriage return. Its hash is a sum over its bytes of a random value of the
byte times a random odd multiplier of its place, then mixed; equal words hash alike
in every batch, task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes worked on at once: temporary arrays take about forty times as much.
PIECE = 1 << 19
# Texts of about so many bytes are taken from an Arrow batch at once.
CHUNK = 3 << 19

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUES[_SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACES = _RANDOM.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _LOWER[data]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offs[0] : offs[-1]], offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds one text, or about ``CHUNK`` bytes of texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = texts_of(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + CHUNK, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def _piece(data: np.ndarray, lower: bool):
    b = _LOWER[data] if lower else data
    word = ~_SPACE[b]
    return b, word


def words_in(data: np.ndarray, offs: np.ndarray, lower: bool = False):
    """``(starts, ends, hashes, first)``: byte range and hash of each word, and each text's first word number.

    ``first`` has one entry more than there are texts. ``lower`` folds A-Z only.
    """
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    all_s, all_e, all_h = [], [], []
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not (edge[end] or _SPACE[data[end]]):
            look = data[end : end + 65536]
            hits = np.flatnonzero(_SPACE[look] | edge[end : end + len(look)])
            end += int(hits[0]) if len(hits) else len(look)
        b, word = _piece(data[at:end], lower)
        here = edge[at : end + 1]
        before = np.empty(len(b), bool)
        before[0], before[1:] = False, word[:-1]
        s = np.flatnonzero(word & (~before | here[:-1]))
        after = np.empty(len(b), bool)
        after[-1], after[:-1] = False, word[1:]
        e = np.flatnonzero(word & (~after | here[1:])) + 1
        if len(s):
            place = np.arange(len(b), dtype=np.int64)
            place[s[0] :] -= np.repeat(s, np.diff(np.append(s, len(b))))
            times = _PLACES[place & 4095]
            if len(b) > 4096 and int((e - s).max()) > 4096:
                times = times * (np.uint64(2) * (place >> 12).astype(np.uint64) + np.uint64(1))
            h = np.add.reduceat(_VALUES[b] * times, s)
            all_s.append(s + at)
            all_e.append(e + at)
            all_h.append(mix(h + (e - s).astype(np.uint64)))
        at = end
    if not all_s:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    starts, ends = np.concatenate(all_s), np.concatenate(all_e)
    return starts, ends, np.concatenate(all_h), np.searchsorted(starts, offs, "left")


def runs_hashed(hashes: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hash of every ``n`` consecutive entries; entry i covers i .. i+n-1."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    times = np.random.Generator(np.random.PCG64(salt)).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = hashes[:count] * times[0]
    for j in range(1, n):
        out += hashes[j : j + count] * times[j]
    return mix(out)


def least_of_runs(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least of every ``n`` consecutive values and its leftmost place, by doubling the width."""
    width, out, place = 1, values, np.arange(len(values))
    while width < n:
        step = min(width, n - width)
        left = out[: len(out) - step] <= out[step:]
        out = np.where(left, out[: len(out) - step], out[step:])
        place = np.where(left, place[: len(place) - step], place[step:])
        width += step
    return out, place


def lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the size of each row's list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)

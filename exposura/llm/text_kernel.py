"""Texts of an Arrow batch as numpy arrays: words, their 64-bit names, and shingles of them.

A batch is worked on as one array of UTF-8 bytes. The name of a byte string is a polynomial in an
odd base modulo 2**64 over a fixed random value per byte, finished by a bit mixer. Names depend on
nothing but the bytes, so every task and every retry gives the same. Two different strings share a
name with a chance of about 2**-58; operators that compare names accept that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are held as 64-bit arrays at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19

_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_VALUES = _BYTE_VALUES[_LOWER]

WHITE_SPACE = np.zeros(256, bool)
WHITE_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Everything in ASCII that is no letter; bytes of longer characters stay inside words.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[np.r_[65:91, 97:123, 128:256]] = False


def released(work):
    """``work`` for ``mapInArrow`` that hands unused Arrow memory back when its partition is done.

    Python workers live on for later stages and would keep it beside them.
    """
    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    size = max(SLICE_BYTES + 1, 1 << (int(n) - 1).bit_length())
    return _powers(size, _BASE_INVERSE if inverse else _BASE)[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the offsets of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, offsets)`` of groups of rows of about ``max_bytes``."""
    data, offsets = text_bytes(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1)
        own = offsets[first:last + 1]
        yield first, last, data[own[0]:own[-1]], own - own[0]
        first = last


def prefix_names(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Running polynomial of the bytes, with a zero in front."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER_VALUES if lower else _BYTE_VALUES)[data] * powers(len(data)), out=out[1:]) if len(data) else None
    return out


def span_names(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The name of each byte span."""
    raw = (prefix[ends] - prefix[starts]) * powers(len(prefix), inverse=True)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = WHITE_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of the first word of each row (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~gap[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[offsets < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = offsets[offsets > 0] - 1
    after[edges] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_names(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = WHITE_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words with A-Z lower-cased, and the index of the first word of each row."""
    starts, ends, first = word_spans(data, offsets, gap)
    return span_names(prefix_names(data, lower=True), starts, ends), first


def shingle_names(words: np.ndarray, first: np.ndarray, size: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Names of all runs of ``size`` words, and the row of each.

    A row with fewer words gives its whole sequence as one run, or none without ``whole_if_short``.
    """
    counts = np.diff(first)
    rows = np.repeat(np.arange(len(counts)), counts)
    if len(words) < size:
        names, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    else:
        n = len(words) - size + 1
        total = np.full(n, np.uint64(size), np.uint64)
        for k in range(size):
            total = mix(total ^ words[k:k + n]) if k == 0 else mix(total * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n])
        full = rows[:n] == rows[size - 1:]
        names, owner = total[full], rows[:n][full]
    if whole_if_short:
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            extra = np.empty(len(short), np.uint64)
            for at, row in enumerate(short):
                value = np.uint64(counts[row])
                for k, word in enumerate(words[first[row]:first[row + 1]]):
                    one = np.array([word], np.uint64)
                    value = mix(value ^ one)[0] if k == 0 else mix(value * np.array([0x9E3779B97F4A7C15], np.uint64) + one)[0]
                extra[at] = value
            names, owner = np.concatenate([names, extra]), np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            names, owner = names[order], owner[order]
    return names, owner


def distinct_per_row(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct names in ascending order, rows in order."""
    order = np.lexsort((names, owner))
    names, owner = names[order], owner[order]
    keep = np.ones(len(names), bool)
    keep[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    return names[keep], owner[keep]


def row_lists(values: np.ndarray, owner: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """An Arrow list per row from values sorted by row."""
    offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

"""Words and word hashes of whole Arrow text columns, computed with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64 bits wide and depend
only on the word's bytes, so they agree between tasks and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 2 << 20
#: Words longer than this many bytes are hashed one by one.
LONG_WORD = 256

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * j)) - 1 for j in range(9)], dtype=np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit about half the time."""
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def combine(h: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its head and the hash of its last item."""
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + nxt)


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of runs of rows of about ``block_bytes`` each.

    Null texts are empty. A longer text makes a block of its own; no text is cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + block_bytes, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of a block, and the number of words of each row."""
    word = ~_SPACE[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = word
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True  # a row's first byte continues no word of the row before
    starts = np.flatnonzero(word & (~before[:-1] | edge[:-1]))
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = word
    ends = np.flatnonzero(word & (~after[1:] | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes as they are."""
    length = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    hashes = mix(length.astype(np.uint64) + np.uint64(0x51_7C_C1_B7))
    left, at = length.copy(), starts.copy()
    long_ones = np.flatnonzero(length > LONG_WORD)
    left[long_ones] = 0
    active = np.flatnonzero(left > 0)
    while len(active):
        piece = eight[at[active]] & _MASK[np.minimum(left[active], 8)]
        hashes[active] = combine(hashes[active], piece)
        left[active] -= 8
        at[active] += 8
        active = active[left[active] > 0]
    for i in long_ones:
        hashes[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return hashes


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def lowered_words(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, word hashes, words of each row)`` with A-Z lower-cased."""
    for row, end, data, offsets in text_blocks(column, block_bytes):
        low = lower_ascii(data)
        starts, ends, counts = word_spans(low, offsets)
        yield row, end, word_hashes(low, starts, ends), counts


def distinct_per_row(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and how many each row has; rows lie one after the other."""
    rows = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[new], np.bincount(rows[new], minlength=len(counts))


def row_shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each row, in order, and how many each row has.

    A row with fewer words, but one at least, has its whole sequence as its only run.
    """
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    full = np.maximum(counts - width + 1, 0)
    begin = np.repeat(first, full) + (np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full))
    runs = np.full(len(begin), np.uint64(width) * np.uint64(0x2545F4914F6CDD1D))
    for j in range(width):
        runs = combine(runs, hashes[begin + j])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if not len(short):
        return runs, full
    n = full.copy()
    n[short] = 1
    out = np.empty(int(n.sum()), dtype=np.uint64)
    place = np.cumsum(n) - n
    is_short = np.zeros(len(out), dtype=bool)
    is_short[place[short]] = True
    out[~is_short] = runs
    for r in short:
        h = np.array([np.uint64(counts[r]) * np.uint64(0x2545F4914F6CDD1D)])
        for w in hashes[first[r] : first[r] + counts[r]]:
            h = combine(h, np.array([w]))
        out[place[r]] = h[0]
    return out, n

"""Elias-Fano sequences and an n-gram trie of three levels in one flat buffer, read in place with numpy.

A trie is bytes in a row: a directory, then each level's arrays, so a file can be memory-mapped (``np.memmap``). All queries
are vectorised.
"""

from __future__ import annotations

import tempfile

import numpy as np

_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
#: Place of the k-th one bit (lowest first) of a byte.
_NTH = np.zeros((256, 8), dtype=np.uint8)
for _b in range(256):
    for _k, _i in enumerate([i for i in range(8) if _b >> i & 1]):
        _NTH[_b, _k] = _i
#: Bytes of upper bits that one directory entry covers.
_STRIDE = 16


def pack_sequence(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of the Elias-Fano form of non-decreasing ``values``, all below ``universe``."""
    n = len(values)
    values = values.astype(np.uint64)
    low = max(0, (int(universe) // max(n, 1)).bit_length() - 1)
    if low:
        bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1) if n < 1 << 14 else None
        if bits is None:
            packed = [
                np.packbits(((values[i : i + (1 << 13)][:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(bool), bitorder="little")
                for i in range(0, n, 1 << 13)
            ]
            lower = np.concatenate(packed)
        else:
            lower = np.packbits(bits.astype(bool), bitorder="little")
    else:
        lower = np.zeros(0, np.uint8)
    high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    size = int(universe >> low) + n + 1
    upper = np.zeros(-(-size // (8 * _STRIDE)) * _STRIDE, dtype=np.uint8)
    np.bitwise_or.at(upper, high >> 3, (1 << (high & 7)).astype(np.uint8))
    ones = np.concatenate([[0], np.cumsum(_POP[upper].reshape(-1, _STRIDE).sum(axis=1, dtype=np.int64))])
    return {
        "head": np.array([n, low], dtype=np.int64),
        "lower": np.concatenate([lower, np.zeros(8, np.uint8)]),
        "upper": upper,
        "ones": ones.astype(np.uint32),
    }


class Sequence:
    """A packed sequence: random access and search, both for many places at once."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.low = (int(x) for x in arrays["head"])
        self.lower, self.upper, self.ones = arrays["lower"], arrays["upper"], arrays["ones"]
        self.wide = np.ndarray((max(len(self.lower) - 7, 1),), dtype="<u8", buffer=self.lower.data, strides=(1,))
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * (8 * _STRIDE) - self.ones

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        directory = self.ones if one else self.zeros
        block = np.searchsorted(directory, k, side="right") - 1
        left = (k - directory[block]).astype(np.uint8)
        rows = self.upper.reshape(-1, _STRIDE)[block]
        if not one:
            rows = ~rows
        upto = np.zeros((len(k), _STRIDE + 1), dtype=np.uint8)  # at most 8 * _STRIDE ones, so a byte is enough
        np.cumsum(_POP[rows], axis=1, dtype=np.uint8, out=upto[:, 1:])
        byte = np.count_nonzero(upto[:, 1:] <= left[:, None], axis=1)
        each = np.arange(len(k))
        return (block * _STRIDE + byte) * 8 + _NTH[rows[each, byte], left - upto[each, byte]]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low
        return (self.wide[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``."""
        i = i.astype(np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.low)) | self._low(i)

    def bucket(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the values that share the upper bits of ``x``."""
        high = (x >> np.uint64(self.low)).astype(np.int64)
        end = self._select(high, False) - high
        begin = np.zeros(len(x), np.int64)
        some = high > 0
        begin[some] = self._select(high[some] - 1, False) - (high[some] - 1)
        return begin, end

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of ``x`` among places ``begin`` to ``end``, or -1: a search by lower bits within ``x``'s bucket."""
        x = x.astype(np.uint64)
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        lo, hi = self.bucket(x)
        if begin is not None:
            lo, hi = np.maximum(lo, begin), np.minimum(hi, end)
        stop = hi.copy()
        want = x & np.uint64((1 << self.low) - 1)
        while len(open_ones := np.flatnonzero(lo < hi)):
            mid = (lo[open_ones] + hi[open_ones]) >> 1
            less = self._low(mid) < want[open_ones]
            lo[open_ones[less]] = mid[less] + 1
            hi[open_ones[~less]] = mid[~less]
        hit = np.flatnonzero(lo < stop)
        out = np.full(len(x), -1, np.int64)
        good = hit[self._low(lo[hit]) == want[hit]]
        out[good] = lo[good]
        return out


#: Steps a decade of quantised probabilities (8 bits) and of context weights (16 bits).
VALUE_STEPS, WEIGHT_STEPS = 32.0, 4096.0


def quantise(p: np.ndarray) -> np.ndarray:
    """8-bit codes of probabilities, rounded down; 0 stands for an n-gram that is not kept.

    A probability below the smallest step has code 0, so its share goes to the context's weight.
    """
    with np.errstate(divide="ignore"):
        code = 1 + np.ceil(-VALUE_STEPS * np.log10(p) - 1e-9)
    return np.where(code <= 255, np.maximum(code, 1), 0).astype(np.uint8)


def dequantise(codes: np.ndarray) -> np.ndarray:
    table = np.concatenate([[0.0], 10 ** (-np.arange(255) / VALUE_STEPS)])
    return table[codes]


def quantise_weight(w: np.ndarray) -> np.ndarray:
    """16-bit codes of weights in (0, 1], rounded down; 0 is the weight 1 of a context that was not seen."""
    return np.clip(np.ceil(-WEIGHT_STEPS * np.log10(np.maximum(w, 1e-15)) - 1e-9), 0, 65535).astype(np.uint16)


def dequantise_weight(codes: np.ndarray) -> np.ndarray:
    return 10 ** (-codes.astype(np.float64) / WEIGHT_STEPS)


_LEVEL = ("head", "lower", "upper", "ones")
_KINDS = [np.int64, np.uint8, np.uint8, np.uint32] * 6 + [np.uint8, np.uint16, np.uint8, np.uint16]
_HASHES = 1 << 63


def _starts(parent: np.ndarray, parents: int) -> np.ndarray:
    """Where each parent's children begin among children in order, and their number at the end."""
    return np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=parents))])


def build_trie(
    roots: np.ndarray, words: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], values2: np.ndarray, weights2: np.ndarray,
    triples: tuple[np.ndarray, np.ndarray], values3: np.ndarray, weights3: np.ndarray,
) -> bytes:
    """A trie of bigrams and trigrams in bytes.

    ``roots`` and ``words`` are ascending 63-bit hashes. A pair is a root's place and a word's, a triple a pair's place and a
    word's, both in ascending order. Level 1 holds the roots, each with its weight and a pointer to its first pair; level 2
    the pairs with their quantised probabilities, their weights as contexts and pointers to their first triples; level 3 the
    triples. Successors are the places of words, made monotone by the place of their context.
    """
    n = max(len(words), 1)
    levels = [
        pack_sequence(roots, _HASHES),
        pack_sequence(words, _HASHES),
        pack_sequence(_starts(pairs[0], len(roots)), len(pairs[0]) + 1),
        pack_sequence(pairs[0] * n + pairs[1], max(len(roots), 1) * n),
        pack_sequence(_starts(triples[0], len(pairs[0])), len(triples[0]) + 1),
        pack_sequence(triples[0] * n + triples[1], max(len(pairs[0]), 1) * n),
    ]
    arrays = [level[name] for level in levels for name in _LEVEL]
    arrays += [values2.astype(np.uint8), weights2.astype(np.uint16), values3.astype(np.uint8), weights3.astype(np.uint16)]
    raw = [a.tobytes() for a in arrays]
    raw = [r + b"\0" * (-len(r) % 8) for r in raw]
    sizes = np.array([a.nbytes for a in arrays], dtype=np.int64)
    return sizes.tobytes() + b"".join(raw)


class Trie:
    """A trie read in place from a buffer."""

    def __init__(self, buffer):
        data = np.frombuffer(buffer, dtype=np.uint8)
        head = len(_KINDS) * 8
        sizes = data[:head].view(np.int64)
        at, arrays = head, []
        for size, kind in zip(sizes.tolist(), _KINDS):
            arrays.append(data[at : at + size].view(kind))
            at += size + (-size % 8)
        sequences = [Sequence(dict(zip(_LEVEL, arrays[i : i + 4]))) for i in range(0, 24, 4)]
        self.roots, self.words, self.first2, self.pairs, self.first3, self.triples = sequences
        self.values2, self.weights2, self.values3, self.weights3 = arrays[24:]

    def _successors(self, first: Sequence, level: Sequence, context: np.ndarray, word: np.ndarray, at_once: int = 1 << 15) -> np.ndarray:
        """Places of the successors ``word`` of contexts, or -1; each is searched among its own context's."""
        out = np.full(len(context), -1, np.int64)
        known = np.flatnonzero((context >= 0) & (word >= 0))
        n = max(self.words.n, 1)
        for i in range(0, len(known), at_once):
            some = known[i : i + at_once]
            c = context[some]
            begin, end = first.get(c).astype(np.int64), first.get(c + 1).astype(np.int64)
            out[some] = level.find((c * n + word[some]).astype(np.uint64), begin, end)
        return out

    def look_up(self, roots: np.ndarray, words: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        """Weights of roots, values and weights of pairs, and values of triples; 0 for what the trie does not hold.

        ``roots`` and ``words`` are hashes, ``pairs`` places among both, ``triples`` places among pairs and words.
        """
        root, word = self.roots.find(roots), self.words.find(words)
        pair = self._successors(self.first2, self.pairs, root[pairs[0]], word[pairs[1]])
        triple = self._successors(self.first3, self.triples, pair[triples[0]], word[triples[1]])

        def of(table: np.ndarray, place: np.ndarray) -> np.ndarray:
            out = np.zeros(len(place), table.dtype)
            out[place >= 0] = table[place[place >= 0]]
            return out

        return of(self.weights2, root), of(self.values2, pair), of(self.weights3, pair), of(self.values3, triple)


def mapped_trie(raw: bytes) -> Trie:
    """The trie of ``raw`` by way of a memory-mapped file, which has no name and goes with the trie.

    The system may drop the mapped levels' pages from memory while they are not read.
    """
    with tempfile.TemporaryFile(prefix="trie-") as f:
        f.write(raw)
        f.flush()
        return Trie(np.memmap(f, dtype=np.uint8, mode="r"))

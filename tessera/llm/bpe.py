"""Byte-level BPE ids of whole Arrow text columns.

The ids are those of the ``tokenizers`` library for the whole text. Byte-level BPE merges never cross the
borders of its pre-tokens, so each block of texts is cut into pre-tokens with numpy, the library encodes
every distinct pre-token once, and the ids are laid out from that table. Texts that hold an added token's
string, or code points unknown to this Python's Unicode tables, go to the library whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .words import text_blocks, word_hashes

OTHER, LETTER, NUMBER, SPACE, UNKNOWN = range(5)
BLOCK_BYTES = 1 << 20
#: Lines of a page, and pages that the library encodes at once; its own form of the ids is many times their size.
PAGE_LINES, PAGES = 200, 8
#: A Python worker remembers pre-tokens in so many slots (a later one may take a slot), and so many ids, before it starts afresh.
SLOTS, POOL = 1 << 21, 1 << 23
# Fixed values of the byte-level pre-tokenizer: suffixes that an apostrophe splits off.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
# Code points below 0x20 that str.isspace() accepts and the regex class \s does not.
NOT_SPACE = (0x1C, 0x1D, 0x1E, 0x1F)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    kind = {"L": LETTER, "N": NUMBER}
    for cp in range(0x110000):
        c = chr(cp)
        cat = unicodedata.category(c)
        if cat == "Cn":
            table[cp] = UNKNOWN
        elif cat[0] in kind:
            table[cp] = kind[cat[0]]
        elif c.isspace() and cp not in NOT_SPACE:
            table[cp] = SPACE
    return table


_ASCII_LEAD = 0x80


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """The class of the code point that each UTF-8 byte belongs to."""
    table = _classes()
    kind = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        wide = np.concatenate([data, np.zeros(3, np.uint8)])
        b0, b1, b2, b3 = (wide[lead + j].astype(np.int32) for j in range(4))
        cp = ((b0 & 0x1F) << 6) | (b1 & 0x3F)
        three, four = b0 >= 0xE0, b0 >= 0xF0
        cp[three] = (((b0 & 0x0F) << 12) | ((b1 & 0x3F) << 6) | (b2 & 0x3F))[three]
        cp[four] = (((b0 & 0x07) << 18) | ((b1 & 0x3F) << 12) | ((b2 & 0x3F) << 6) | (b3 & 0x3F))[four]
        of_lead = table[cp]
        kind[lead] = of_lead
        kind[lead + 1] = of_lead
        kind[lead[three] + 2] = of_lead[three]
        kind[lead[four] + 3] = of_lead[four]
    return kind


def pre_tokens(data: np.ndarray, kind: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sorted byte starts of the pre-tokens of concatenated texts; ``rows``: start of each text, and the end."""
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[rows] = True
    change = edge.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(change[:n])
    run_end = np.append(runs[1:], n)
    start = np.zeros(n + 1, dtype=bool)
    blank = kind[runs] == SPACE

    solid, solid_end = runs[~blank], run_end[~blank]
    takes_blank = ~edge[solid] & (data[solid - 1] == 32)
    start[solid - takes_blank] = True

    s, e = runs[blank], run_end[blank]
    followed = ~edge[e]
    # The last blank before a word stands alone, or goes to the word if it is a plain space.
    last = e - 1
    while len(wide := np.flatnonzero((data[last] & 0xC0) == _ASCII_LEAD)):
        last[wide] -= 1
    start[s[~followed | (last > s)]] = True
    start[last[followed & (data[last] != 32)]] = True

    lone = solid[(data[solid] == 39) & (solid_end - solid == 1) & ~takes_blank & ~edge[solid_end]]
    if len(lone):
        stop = rows[np.searchsorted(rows, lone, side="right")]
        open_ones = kind[lone + 1] == LETTER
        for suffix in SUFFIXES:
            hit = open_ones & (lone + len(suffix) < stop)
            for j, c in enumerate(suffix, 1):
                hit[hit] &= data[lone[hit] + j] == ord(c)
            open_ones &= ~hit
            at = lone[hit]
            start[at + 1] = False
            rest = at + 1 + len(suffix)
            rest = rest[~edge[rest]]
            start[rest[kind[rest] == LETTER]] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """One tokenizer file and the pre-tokens that this process has met so far."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # The part encoder gets many pre-tokens in one text, each on a line of its own; it needs no cache.
        model = json.loads(self.whole.to_str())["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.part = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0))
        self.part.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.line = self.part.encode("\n", add_special_tokens=False).ids[0]
        self.forget()

    def forget(self) -> None:
        self.key = np.zeros(SLOTS, np.uint64)
        self.at = np.zeros(SLOTS, np.int32)
        self.size = np.zeros(SLOTS, np.int32)
        self.pool = np.zeros(POOL, np.uint32)
        self.used = 0

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one after the other, and the number of each."""
        several = [i for i, t in enumerate(texts) if "\n" in t]
        lines = list(texts)
        for i in several:
            lines[i] = ""
        pages = ["\n".join(lines[i : i + PAGE_LINES]) + "\n" for i in range(0, len(lines), PAGE_LINES)]
        parts = [np.zeros(0, np.uint32)]
        for i in range(0, len(pages), PAGES):
            done = self.part.encode_batch_fast(pages[i : i + PAGES], add_special_tokens=False)
            parts += [np.array(page.ids, dtype=np.uint32) for page in done]
        flat = np.concatenate(parts)
        stop = np.flatnonzero(flat == self.line)
        size = np.diff(stop, prepend=-1) - 1
        flat = flat[flat != self.line]
        if several:
            ids = [self.whole.encode(texts[i], add_special_tokens=False).ids for i in several]
            place = np.cumsum(size)[several]
            flat = np.insert(flat, np.repeat(place, [len(x) for x in ids]), [i for x in ids for i in x]).astype(np.uint32)
            size[several] = [len(x) for x in ids]
        return flat, size

    def _lookup(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool, and number of ids, of each pre-token."""
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        at, size = self.at[slot], self.size[slot]
        missing = np.flatnonzero(self.key[slot] != hashes)
        if len(missing):
            keys, first, place = np.unique(hashes[missing], return_index=True, return_inverse=True)
            spot = missing[first]
            flat, n = self._encode([data[a:b].tobytes().decode() for a, b in zip(starts[spot], ends[spot])])
            if self.used + len(flat) > len(self.pool):
                if self.used:
                    self.forget()
                    return self._lookup(hashes, data, starts, ends)
                self.pool = np.zeros(len(flat), np.uint32)
            self.pool[self.used : self.used + len(flat)] = flat
            new_at = (self.used + np.cumsum(n) - n).astype(np.int32)
            self.used += len(flat)
            at[missing], size[missing] = new_at[place], n[place]
            slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
            self.key[slot], self.at[slot], self.size[slot] = keys, new_at, n
        return at, size

    def _block(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = byte_kinds(data)
        starts = pre_tokens(data, kind, rows)
        ends = np.append(starts[1:], len(data))
        at, size = self._lookup(word_hashes(data, starts, ends), data, starts, ends)
        done = np.concatenate([[0], np.cumsum(size)])
        flat = self.pool[np.repeat(at - done[:-1], size) + np.arange(done[-1])]
        counts = np.diff(done[np.searchsorted(starts, rows)])

        odd = set(np.searchsorted(rows, np.flatnonzero(kind == UNKNOWN), side="right") - 1)
        whole = data.tobytes()
        for special in self.added:
            if special.encode() in whole:
                odd |= {r for r in range(len(rows) - 1) if special.encode() in whole[rows[r] : rows[r + 1]]}
        if odd:
            cuts = np.concatenate([[0], np.cumsum(counts)])
            parts = [flat[cuts[r] : cuts[r + 1]] for r in range(len(counts))]
            for r in odd:
                ids = self.whole.encode(whole[rows[r] : rows[r + 1]].decode(), add_special_tokens=False).ids
                parts[r] = np.array(ids, dtype=np.uint32)
                counts[r] = len(ids)
            flat = np.concatenate(parts)
        return flat, counts

    def blocks(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(first row, end row, ids, ids of each row)``; null texts have no ids."""
        for row, end, data, offsets in text_blocks(column, BLOCK_BYTES):
            if len(data):
                yield row, end, *self._block(data, offsets)
            else:
                yield row, end, np.zeros(0, np.uint32), np.zeros(end - row, np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """This process's encoder of a tokenizer file."""
    return Encoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ids followed by ``end_id``."""
    stops = np.cumsum(counts)
    return np.insert(ids, stops, end_id).astype(np.uint32), counts + 1

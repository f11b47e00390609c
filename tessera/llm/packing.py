"""Vector best-fit packing of token pieces into training sequences.

Every open sequence ("bin") has three residual capacities: tokens, documents and attention cost (the sum of
squared piece lengths). A piece goes to the bin that scores best among those with room in all three, either
by the weighted dot product of the piece and the residual, or by the weighted norm of what would be left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, with_end
from .common import parts_for, stage_table, texts_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"
#: Pieces that one task packs together; larger shares waste less at their ends.
SHARE = 25_000


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, max_tokens: int = 1024) -> DataFrame:
    """One row per piece of each document: ``doc_id, piece, start, length, ids_crc32``.

    A document is the tokenizer's ids of its whole text, then ``end_id``; null and empty texts have the end
    id alone. Documents over ``max_tokens`` are cut into full pieces, the first of which takes the remainder.
    Rows are documents of their own, so repeated rows give repeated pieces; null ids stay null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            names = batch.column("doc_id")
            for row, end, ids, counts in enc.blocks(batch.column("text")):
                ids, counts = with_end(ids, counts, end_id)
                first = counts % max_tokens
                first[first == 0] = max_tokens
                n = (counts - first) // max_tokens + 1
                of = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                length = np.where(piece == 0, first[of], max_tokens)
                start = np.where(piece == 0, 0, first[of] + (piece - 1) * max_tokens)
                raw = ids.astype("<u4").tobytes()
                stop = np.cumsum(length) * 4
                crc = np.fromiter(
                    (zlib.crc32(raw[b - 4 * k : b]) for b, k in zip(stop.tolist(), length.tolist())), np.int64, len(of)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        names.slice(row, end - row).take(pa.array(of)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start.astype(np.int64)),
                        pa.array(length.astype(np.int64)),
                        pa.array(crc),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return texts_of(docs).mapInArrow(cut, PIECES)


class BestFit:
    """Bins of one share. Bins with equal residuals are alike, so they are kept as one state with a stack."""

    def __init__(self, capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str):
        if rule not in ("dot", "norm"):
            raise ValueError(f"unknown rule: {rule}")
        self.capacity = np.array(capacity, dtype=np.float64)
        self.weights = np.array(weights, dtype=np.float64)
        self.rule = rule
        self.left = np.zeros((64, 3))
        self.bins: list[list[int]] = []
        self.state: dict[tuple[int, int, int], int] = {}
        self.free: list[int] = []
        self.opened = 0

    def _put(self, left: tuple[int, int, int], bin_no: int) -> None:
        if left[0] <= 0 or left[1] <= 0 or left[2] <= 0:
            return  # full
        k = self.state.get(left)
        if k is None:
            if self.free:
                k = self.free.pop()
            else:
                k = len(self.bins)
                self.bins.append([])
                if k == len(self.left):
                    self.left = np.concatenate([self.left, np.zeros_like(self.left)])
            self.left[k] = left
            self.state[left] = k
        self.bins[k].append(bin_no)

    def place(self, length: int) -> tuple[int, int]:
        """Bin of the next piece, and where in it the piece begins."""
        need = np.array([length, 1, length * length], dtype=np.float64)
        left = self.left[: len(self.bins)]
        fits = np.flatnonzero((left >= need).all(axis=1))
        if len(fits):
            if self.rule == "dot":
                score = -(left[fits] / self.capacity * (need / self.capacity) * self.weights).sum(axis=1)
            else:
                score = (((left[fits] - need) / self.capacity) ** 2 * self.weights).sum(axis=1)
            k = int(fits[np.argmin(score)])
            had = tuple(int(x) for x in self.left[k])
            bin_no = self.bins[k].pop()
            if not self.bins[k]:
                del self.state[had]
                self.left[k] = 0
                self.free.append(k)
        else:
            had = tuple(int(x) for x in self.capacity)
            bin_no = self.opened
            self.opened += 1
        self._put((had[0] - length, had[1] - 1, had[2] - length * length), bin_no)
        return bin_no, int(self.capacity[0]) - had[0]


def pack(
    pieces: DataFrame,
    max_tokens: int = 1024,
    max_docs: int = 1024,
    max_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
) -> DataFrame:
    """``sequence_id`` and ``offset`` of each piece; sequences are gapless and hold every capacity.

    Pieces are dealt by hash, of equal rows by their place in the table, into shares of about ``SHARE``, each packed by
    one task, longest piece first, in an order that a rerun repeats; give a table that is read from files. No sequence
    spans two shares, so at most one sequence a share is left part-empty for that reason. ``max_cost`` is
    ``max_tokens ** 2`` unless given; then, and with as many documents as tokens, tokens alone bind, as a sequence's
    sum of squares is at most the square of its sum. A piece that exceeds a capacity by itself fits no sequence and
    raises ``ValueError``. Null ids are documents of their own. An empty table gives no rows.
    """
    cost = max_tokens * max_tokens if max_cost is None else max_cost
    spark = pieces.sparkSession
    shares = max(1, -(-pieces.count() // SHARE))
    limits = (max_tokens, max_docs, cost)

    def fill(key, table):
        length = table.column("length").to_numpy()
        doc = table.column("doc_id").combine_chunks().fill_null(-1).to_numpy()
        order = np.lexsort((table.column("ids_crc32").to_numpy(), table.column("piece").to_numpy(), doc, -length))
        if len(length) and (length.max() > limits[0] or length.max() ** 2 > limits[2]):
            raise ValueError("a piece is longer than a sequence may be")
        share = key[0].as_py() << 40
        bins = BestFit(limits, weights, rule)
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        alone = length[order] == limits[0]  # these fill a sequence each and open no choice
        bins.opened = int(alone.sum())
        sequence[order[alone]] = np.arange(bins.opened)
        order = order[~alone]
        for i, n in zip(order.tolist(), length[order].tolist()):
            sequence[i], offset[i] = bins.place(n)
        table = table.drop_columns(["share"])
        return table.append_column("sequence_id", pa.array(sequence + share)).append_column("offset", pa.array(offset))

    share = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "__row"), F.lit(shares)).cast("int")
    spread = pieces.withColumn("__row", F.monotonically_increasing_id()).withColumn("share", share).drop("__row")
    spread = spread.repartition(parts_for(spark, shares, 1), "share")
    return spread.groupBy("share").applyInArrow(fill, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, max_tokens: int = 1024, piece_tokens: int | None = None, **options) -> DataFrame:
    """Tokenize, cut and pack whole documents; see :func:`token_pieces` and :func:`pack`.

    Pieces have at most ``piece_tokens`` (``max_tokens`` unless given); ``docs`` may have any other columns.
    """
    pieces = stage_table(token_pieces(docs, tokenizer, end_id, piece_tokens or max_tokens), "pieces")
    return pack(pieces, max_tokens, **options)

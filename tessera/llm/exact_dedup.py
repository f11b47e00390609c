"""Exact deduplication by content-defined chunk recipes.

A text is cut where a rolling hash of its own bytes says so, so equal passages give equal chunks wherever they stand. A
chunk's identifier is its digest and length. A first pass over the texts writes a recipe a document: the ordered
identifiers, a few dozen bytes. A second pass sends the bytes of chunks to be verified: only chunks of recipes that occur
more than once (by a bit table of bounded size, which lets few others through), and each distinct one once a task. If all bytes under an identifier are
equal, it names its chunk exactly, and documents are equal if and only if their recipes are; otherwise the corpus is read
again under another digest. So texts are compared byte by byte, yet no long document is moved or gathered as a whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_table, join_keyed, stage_table, texts_of
from .words import text_blocks

#: Bytes of a chunk: at least, on average beyond that (a power of two, as bits), and at most.
LEAST, MEAN_BITS, MOST = 2 << 10, 13, 64 << 10
#: Bytes that the rolling hash sees, and bytes that are hashed at once.
WINDOW, SEGMENT = 32, 1 << 20
BLOCK_BYTES = 2 << 20
GEAR = np.random.default_rng(20_240).integers(0, 1 << 32, 256, dtype=np.uint32)
DIGEST_BYTES = 16
#: Bits of the table of wanted identifiers: for each of them, at least and at most. Its pieces have ``TABLE_PIECE`` bits.
BITS_EACH, LEAST_BITS, MOST_BITS, TABLE_PIECE = 64, 17, 27, 17


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, ``sum(GEAR[b] << age)`` over the last ``WINDOW`` bytes, in 32 bits, by doubling the window."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h, width = wider, 2 * width
    return h


def cut_places(data: np.ndarray, mean_bits: int = MEAN_BITS) -> np.ndarray:
    """Ascending offsets after which a chunk may end."""
    found = []
    for at in range(0, len(data), SEGMENT):
        begin = max(0, at - WINDOW)
        hit = np.flatnonzero(rolling(data[begin : at + SEGMENT]) >> np.uint32(32 - mean_bits) == 0)
        found.append(hit[hit >= at - begin] + begin + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(places: list[int], begin: int, end: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of the text from ``begin`` to ``end``; ``places`` may span other texts as well.

    A chunk has ``least`` bytes at least, more than the rolling hash sees, so its end depends on its own text alone.
    """
    out, at = [], begin
    while end - at > least:
        k = bisect_left(places, at + least)
        stop = min(places[k] if k < len(places) else end, at + most, end)
        out.append(stop)
        at = stop
    return out + [end] * (at < end)


def digest_of(chunk: bytes, seed: int) -> bytes:
    """A chunk's identifier under the digest of this seed."""
    return xxhash.xxh3_128_digest(chunk, seed=seed)[:DIGEST_BYTES] + len(chunk).to_bytes(4, "little")


def chunks_of(column: pa.Array, sizes: tuple[int, int, int]) -> Iterator[tuple[bytes, list[list[tuple[int, int]]]]]:
    """Blocks of texts: their bytes, and the spans of each text's chunks."""
    least, mean_bits, most = sizes
    for _, _, data, offsets in text_blocks(column, BLOCK_BYTES):
        places = cut_places(data, mean_bits).tolist() if np.diff(offsets).max() > least else []
        spans = []
        for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
            ends = chunk_ends(places, a, b, least, most)
            spans.append(list(zip([a, *ends[:-1]], ends)))
        yield data.tobytes(), spans


RECIPES = "doc_id long, row long, text_sha256 binary, recipe binary"


def recipes_of(rows: DataFrame, seed: int, sizes: tuple[int, int, int]) -> DataFrame:
    """A written table of each document's recipe and digest; ``row`` numbers the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = 0
            for raw, spans in chunks_of(batch.column("text"), sizes):
                n = len(spans)
                recipes = [b"".join(digest_of(raw[a:b], seed) for a, b in each) for each in spans]
                digests = [hashlib.sha256(raw[each[0][0] : each[-1][1]] if each else b"").digest() for each in spans]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, n), pa.array(range(row, row + n), pa.int64()), pa.array(digests, pa.binary()), pa.array(recipes, pa.binary())],
                    names=["doc_id", "row", "text_sha256", "recipe"],
                )
                at, row = at + n, row + n

    return stage_table(rows.mapInArrow(run, RECIPES), "recipes")


def bit_table(ids: DataFrame) -> np.ndarray:
    """A bit for each value that the first bytes of an identifier may have, of which those of ``ids`` are set.

    The table has 2 to the power of ``MOST_BITS`` bits at most, whatever the number of identifiers: beyond about as many it
    fills up and tells less. It comes to the driver in pieces that tasks have made.
    """
    bits = min(max((ids.count() * BITS_EACH).bit_length(), LEAST_BITS), MOST_BITS)
    place = F.conv(F.hex(F.substring("id", 1, 4)), 16, 10).cast("long").bitwiseAND((1 << bits) - 1)
    places = ids.select(place.alias("place")).distinct()
    split = places.select(F.shiftright("place", TABLE_PIECE).cast("int").alias("piece"), F.col("place").bitwiseAND((1 << TABLE_PIECE) - 1).cast("int").alias("bit"))

    def one(table: pa.Table) -> pa.Table:
        bit = np.zeros(1 << TABLE_PIECE, bool)
        bit[table.column("bit").to_numpy()] = True
        return pa.table({"piece": table.column("piece").slice(0, 1), "packed": pa.array([np.packbits(bit).tobytes()], pa.binary())})

    out = np.zeros((1 << (bits - TABLE_PIECE), (1 << TABLE_PIECE) // 8), np.uint8)
    for r in split.groupBy("piece").applyInArrow(one, "piece int, packed binary").collect():
        out[r.piece] = np.frombuffer(r.packed, np.uint8)
    return out.reshape(-1)


def clashes(rows: DataFrame, recipes: DataFrame, seed: int, sizes: tuple[int, int, int]) -> int:
    """How many identifiers stand for different bytes, among those of recipes that occur more than once and some others."""
    width = DIGEST_BYTES + 4
    again = recipes.groupBy("recipe").agg(F.count("*").alias("n")).where("n > 1 AND octet_length(recipe) > 0")
    each = F.transform(F.sequence(F.lit(0), (F.octet_length("recipe") / width).cast("int") - 1), lambda k: F.substring(F.col("recipe"), k * width + 1, F.lit(width)))
    wanted = stage_table(again.select(F.explode(each).alias("id")).distinct(), "chunk-ids")
    shared = rows.sparkSession.sparkContext.broadcast(bit_table(wanted))
    drop_table(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        mask = 8 * len(table) - 1

        def asked(digest: bytes) -> bool:
            place = int.from_bytes(digest[:4], "big") & mask
            return bool(table[place >> 3] >> (7 - (place & 7)) & 1)

        for batch in batches:
            for raw, spans in chunks_of(batch.column("text"), sizes):
                every = ((digest_of(raw[a:b], seed), a, b) for each in spans for a, b in each)
                met = {(digest, raw[a:b]) for digest, a, b in every if asked(digest)}
                columns = zip(*met) if met else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["id", "content"])

    contents = rows.select("text").mapInArrow(run, "id binary, content binary").groupBy("id", "content").agg(F.lit(1).alias("one"))
    return contents.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").count()


def exact_groups(docs: DataFrame, least: int = LEAST, mean_bits: int = MEAN_BITS, most: int = MOST) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every document.

    Documents are equal if their texts are, byte by byte; null texts are empty, and empty ones are equal. Of equal
    documents the one with the largest id is kept (ids that are null are below all others), of rows with one id and text
    one; ``group_size`` counts rows. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
    """
    if least < WINDOW:
        raise ValueError(f"a chunk needs at least {WINDOW} bytes")
    bound_batches(docs.sparkSession)
    rows, sizes = texts_of(docs), (least, mean_bits, most)
    for seed in count():
        recipes = recipes_of(rows, seed, sizes)
        if not clashes(rows, recipes, seed, sizes):
            break
        drop_table(recipes)
    groups = recipes.groupBy("recipe").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("best"))
    out = join_keyed(recipes, groups, "recipe", "group_size", recipes.count())
    return out.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
    )


def oracle_sql() -> str:
    return """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""

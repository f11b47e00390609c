"""Chunks: bounded runs of whole documents that a job can meet again under the same number.

Some operators need an answer for every word sequence of every document. A chunk asks for each distinct one
once, answers come back by chunk number, and the chunk's texts are read a second time beside them. So what is
shuffled has a bound a chunk, however often a sequence occurs, and no document is taken apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import stage_table, texts_of
from .words import text_blocks

CHUNKS = "chunk long, ids array<long>, sizes array<long>, texts binary"
#: UTF-8 bytes of text in a chunk; a longer document has a chunk of its own.
CHUNK_BYTES = 8 << 20


def chunk_table(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A written table of chunks: document ids, byte sizes and all texts, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        number = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        texts: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    one(pa.concat_arrays(ids)),
                    one(pa.array(np.concatenate(sizes))),
                    pa.array([packer.compress(b"".join(texts))], pa.binary()),
                ],
                names=["chunk", "ids", "sizes", "texts"],
            )

        for batch in batches:
            for start, end, data, offsets in text_blocks(batch.column("text")):
                ids.append(batch.column("doc_id").slice(start, end - start))
                sizes.append(np.diff(offsets))
                texts.append(data.tobytes())
                held += len(data)
                if held >= chunk_bytes:
                    yield row()
                    number, held = number + 1, 0
                    ids, sizes, texts = [], [], []
        if ids:
            yield row()

    return stage_table(texts_of(docs).mapInArrow(run, CHUNKS), "chunks", compression="none")


def open_chunk(row: pa.RecordBatch | pa.Table, i: int = 0) -> tuple[int, pa.Array, np.ndarray, np.ndarray]:
    """Number, document ids, bytes and offsets of the chunk in row ``i``."""
    ids = row.column("ids")[i].values
    sizes = row.column("sizes")[i].values.to_numpy()
    raw = zstandard.ZstdDecompressor().decompress(row.column("texts")[i].as_py())
    return row.column("chunk")[i].as_py(), ids, np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def chunk_blocks(data: np.ndarray, offsets: np.ndarray, block_bytes: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A chunk's texts in blocks that fit the processor's cache; see :func:`tessera.llm.words.text_blocks`."""
    column = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
    yield from text_blocks(column, block_bytes)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys: differences, split into byte planes, compressed."""
    steps = np.diff(keys, prepend=np.zeros(1, np.uint64))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_small(values: np.ndarray, kind: str) -> bytes:
    """Small numbers, compressed; ``kind`` is their numpy type."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def unpack_small(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)

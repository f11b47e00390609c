"""Token ids as bit-plane shuffled binary chunks.

Format: a Parquet folder with one row per chunk. A chunk holds whole documents of one file, at least
``CHUNK_IDS`` ids unless it is the file's last. Its ids are cut into blocks of ``BLOCK_IDS`` (the last may be
shorter); each block is transposed, so that plane *k* holds bit *k* of every id (byte planes: byte *k*), and each
plane is compressed by zstandard; planes above the highest one that is not zero are left out. The other columns
are the chunk index: file and chunk number, the chunk's first id within its file, ids, planes of each block, byte
size of each plane, and the chunk's documents in ascending order with the number of their ids. Files are numbered
in ascending document order. Parquet keeps columns apart, so the index is read without the planes, and every
chunk can be decoded by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import encoder, with_end
from .common import texts_of

BLOCK_IDS = 1 << 14
CHUNK_IDS = 1 << 18
#: UTF-8 bytes of text that one file takes, and files whose sizes are added up together.
FILE_BYTES = 24 << 20
FILE_GROUP = 1 << 12
CHUNKS = (
    "file int, chunk int, first_id long, n_ids long, block_planes array<int>, plane_bytes array<int>, "
    "doc_ids array<long>, doc_tokens array<long>, planes array<binary>"
)
_ARROW = pa.schema(
    [
        ("file", pa.int32()), ("chunk", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()),
        ("block_planes", pa.list_(pa.int32())), ("plane_bytes", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())),
    ]
)


def to_planes(ids: np.ndarray, unit: str = "bit", level: int = 3) -> list[bytes]:
    """The compressed planes of a block of unsigned 32-bit ids, lowest first; zero planes at the end are left out."""
    packer = zstandard.ZstdCompressor(level=level)
    raw = ids.astype("<u4")
    if unit == "byte":
        planes = [np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 4)[:, k]) for k in range(4)]
    elif unit == "bit":
        planes = [np.packbits((raw >> np.uint32(k)) & np.uint32(1), bitorder="little") for k in range(int(raw.max(initial=0)).bit_length())]
    else:
        raise ValueError(f"unknown plane unit: {unit}")
    while planes and not planes[-1].any():
        planes.pop()
    return [packer.compress(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int, unit: str = "bit") -> np.ndarray:
    """The ids that :func:`to_planes` packed."""
    out = np.zeros(n, dtype=np.uint32)
    unpacker = zstandard.ZstdDecompressor()
    for k, plane in enumerate(planes):
        raw = np.frombuffer(unpacker.decompress(plane), dtype=np.uint8)
        if unit == "byte":
            out |= raw.astype(np.uint32) << np.uint32(8 * k)
        else:
            out |= np.unpackbits(raw, count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, unit: str = "bit", level: int = 3) -> None:
    """Tokenize every whole text, append ``end_id``, and write all ids to ``path`` in ascending ``doc_id`` order.

    Null and empty texts have the end id alone; null ids come first; rows with equal ids follow each other, over several
    files where they are many, in the order of their texts' first characters. An empty table writes empty tables. A
    chunk holds whole documents, so a very long one makes a long chunk.
    """
    rows = texts_of(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-int(size) // FILE_BYTES))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        held, names, sizes = [], [], []
        kept = begun = chunk = file = 0

        def chunk_row() -> pa.RecordBatch:
            ids = np.concatenate(held)
            blocks = [to_planes(ids[i : i + BLOCK_IDS], unit, level) for i in range(0, len(ids), BLOCK_IDS)]
            row = {
                "file": file, "chunk": chunk, "first_id": begun, "n_ids": len(ids),
                "block_planes": [len(x) for x in blocks], "plane_bytes": [len(p) for x in blocks for p in x],
                "doc_ids": [i for x in names for i in x], "doc_tokens": np.concatenate(sizes).tolist(),
                "planes": [p for x in blocks for p in x],
            }
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            if not batch.num_rows:
                continue
            file = batch.column("file")[0].as_py()
            column = batch.column("doc_id")
            for row, end, ids, counts in enc.blocks(batch.column("text")):
                ids, counts = with_end(ids, counts, end_id)
                held.append(ids)
                names.append(column.slice(row, end - row).to_pylist())
                sizes.append(counts)
                kept += len(ids)
                if kept >= CHUNK_IDS:
                    yield chunk_row()
                    held, names, sizes = [], [], []
                    begun, chunk, kept = begun + kept, chunk + 1, 0
        if held:
            yield chunk_row()

    # Beside the id, files are divided by the text's beginning, and equal rows by their place.
    keyed = rows.withColumn("__head", F.substring("text", 1, 32)).withColumn("__row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(files, "doc_id", "__head", "__row").sortWithinPartitions("doc_id", "__head", "__row")
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().alias("file"))
    ordered.mapInArrow(encode, CHUNKS).write.option("compression", "none").parquet(path)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunk index: which ids and documents each chunk holds, and how large its planes are."""
    return spark.read.schema(CHUNKS).parquet(path).drop("planes")


def read_tokens(spark: SparkSession, path: str, unit: str = "bit", with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files, and its ``ids`` if asked for.

    ``start`` counts the ids of all documents before it. Chunks are decoded independently; only one number a
    file, and one a group of ``FILE_GROUP`` files, meet in windows.
    """
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
    columns = ["doc_id", "file", "begin", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                blocks, at = [], 0
                for i, n in enumerate(row["block_planes"]):
                    count = min(BLOCK_IDS, row["n_ids"] - i * BLOCK_IDS)
                    blocks.append(from_planes(row["planes"][at : at + n], count, unit))
                    at += n
                ids = np.concatenate(blocks)
                raw = ids.astype("<u4").tobytes()
                sizes = np.array(row["doc_tokens"], dtype=np.int64)
                stops = np.cumsum(sizes)
                spans = list(zip((stops - sizes).tolist(), stops.tolist()))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans]
                out = [row["doc_ids"], [row["file"]] * len(sizes), row["first_id"] + stops - sizes, sizes, crc]
                out += [[ids[a:b].tolist() for a, b in spans]] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=columns)

    chunks = spark.read.schema(CHUNKS).parquet(path)
    read = chunks.mapInArrow(decode, "doc_id long, file int, begin long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    # Sums before each file within its group of files, and before each group: a window of FILE_GROUP rows at most, and
    # one of a row for each group.
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    before_in = F.coalesce(F.sum("of_file").over(earlier(W.partitionBy("group").orderBy("file"))), F.lit(0))
    files = chunks.groupBy("file").agg(F.sum("n_ids").alias("of_file")).withColumn("group", F.floor(F.col("file") / FILE_GROUP))
    groups = files.groupBy("group").agg(F.sum("of_file").alias("of_group"))
    groups = groups.select("group", F.coalesce(F.sum("of_group").over(earlier(W.orderBy("group"))), F.lit(0)).alias("before_group"))
    before = files.withColumn("before_in", before_in).join(groups, "group").select("file", (F.col("before_in") + F.col("before_group")).alias("before"))
    start = (F.col("before") + F.col("begin")).alias("start")
    return read.join(before, "file").select("doc_id", start, *columns[3:])

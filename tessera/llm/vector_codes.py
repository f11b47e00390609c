"""Vector code compression: product codes whose nearest entries are screened in float32 and settled in int64.

Components become integers; vectors are cut into equal parts, and each part position has a codebook. An assignment takes
blocks of vectors: one float32 matrix product gives the scores of all entries, each with an interval that holds the exact
score whatever the order of the additions was. Every entry whose interval overlaps the best one's is evaluated again in
int64, so the result is exact, and the smallest index wins a tie. A round sends one partial sum for each entry and
component from each task; codebooks have a fixed size and are all that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, join_keyed, stage_table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are screened at once.
BLOCK = 4096
#: Rounding unit of float32, and how much wider an interval is made for the float64 arithmetic of its own width.
UNIT, WIDER = 2.0**-24, 1 + 1e-6


def intervals(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores ``|entry|^2 - 2 value.entry`` by a float32 matrix product, and the radius of each one's interval.

    Both factors are rounded once, and a term takes part in at most ``width`` roundings of a sum, one of a product and one
    of the difference. So the error is at most ``g (|entry|^2 + 2 |value| |entry|)`` with ``g = k u / (1 - k u)`` and
    ``k = width + 4``, by the inequality of Cauchy and Schwarz.
    """
    small, entries = values.astype(np.float32), book.astype(np.float32)
    scores = (entries * entries).sum(axis=1, dtype=np.float32) - np.float32(2) * (small @ entries.T)
    k = book.shape[1] + 4
    bound = k * UNIT / (1 - k * UNIT) * WIDER
    size = np.sqrt((book.astype(np.float64) ** 2).sum(axis=1)) * WIDER
    lengths = np.sqrt((values.astype(np.float64) ** 2).sum(axis=1)) * WIDER
    return scores.astype(np.float64), bound * (size * size + 2 * lengths[:, None] * size)


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of ``book`` to each row, the smallest of equally near ones, and the exact squared distance."""
    scores, radius = intervals(values, book)
    open_ones = scores - radius <= (scores + radius).min(axis=1, keepdims=True)
    row, entry = np.nonzero(open_ones)
    exact = ((values[row] - book[entry]) ** 2).sum(axis=1)
    first = np.searchsorted(row, np.arange(len(values)))
    best = np.minimum.reduceat(exact, first) if len(first) else exact
    hit = np.flatnonzero(exact == best[row])
    return entry[hit[np.searchsorted(row[hit], np.arange(len(values)))]], best


def assign(values: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes ``(vectors, parts)`` and squared distances summed over parts; ``books`` is ``(parts, entries, width)``."""
    parts, _, width = books.shape
    codes, error = np.zeros((len(values), parts), np.int64), np.zeros(len(values), np.int64)
    for p in range(parts):
        codes[:, p], off = nearest(values[:, p * width : (p + 1) * width], books[p])
        error += off
    return codes, error


def integers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of every component, shorter vectors filled up with zeros to ``dim`` components."""
    lists = column.cast(pa.list_(pa.float64()))
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * float(scale))
    most = np.sqrt(2.0**61 / max(dim, 1))
    if len(flat) and np.abs(flat).max() >= most:
        raise ValueError(f"a component beyond {most / scale:.6g} has distances that 64 bits do not hold")
    out = np.zeros((len(sizes), dim), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.astype(np.int64)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, integers(part.column("embedding"), dim, scale)


def moved(kept: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """Codebooks after one round: each entry becomes the floor of the mean of its parts; unused entries stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for _, values in _blocks(batches, parts * width, scale):
            codes, _ = assign(values, books)
            for p in range(parts):
                n[p] += np.bincount(codes[:, p], minlength=entries)
                for j in range(width):  # sums of a block are exact in float64
                    total[p, :, j] += np.bincount(codes[:, p], weights=values[:, p * width + j], minlength=entries).astype(np.int64)
        p, e, j = np.nonzero(np.broadcast_to(n[:, :, None] > 0, books.shape))
        columns = [(p * entries + e) * width + j, total[p, e, j], n[p, e]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["slot", "total", "n"])

    sums = kept.select("embedding").mapInArrow(run, "slot long, total long, n long")
    rows = sums.groupBy("slot").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n")).collect()
    out = books.reshape(-1).copy()
    for r in rows:  # as many as the codebooks have components
        out[r.slot] = int(r.total) // r.n
    return out.reshape(books.shape)


def fit_books(kept: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks ``(parts, entries, width)`` that start with the rows of the smallest ids; fewer rows make fewer entries."""
    ordered = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(entries)
    start = integers(ordered.toArrow().column(0).combine_chunks(), dim, scale)
    books = np.ascontiguousarray(start.reshape(len(start), parts, dim // parts).transpose(1, 0, 2))
    for _ in range(rounds if len(start) else 0):
        books = moved(kept, books, scale)
    return books


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, embedding`` of the vectors without null or non-finite components."""
    v = vectors["embedding"].cast("array<double>")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].alias("label"), v.alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("embedding").isNotNull() & ~odd)


CODED = "code string, error long"


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector without null or non-finite components.

    ``code`` has two hex digits a part, ``error`` the exact squared distances; ``label_error`` sums it over equal labels
    (null ones are one label). Ties go to the lower index. Repeated rows and null ids are rows of their own; among rows
    with one id, those with smaller components start the codebooks first, and null ids come last. Vectors are filled up with
    zeros to the longest one's length, and that to a multiple of ``parts``. A component so large that a distance leaves
    64 bits raises. An empty table gives no rows. Only ``vec_id, embedding, label`` are read.
    """
    bound_batches(vectors.sparkSession)
    kept = usable(vectors)
    longest, total = kept.agg(F.max(F.size("embedding")), F.count("*")).first()
    dim = -(-(longest or 0) // parts) * parts
    books = fit_books(kept, dim, parts, entries, rounds, scale)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in _blocks(batches, dim, scale):
            codes, error = assign(values, books)
            raw = codes.astype(np.uint8).tobytes().hex()
            text = [raw[i : i + 2 * parts] for i in range(0, len(raw), 2 * parts)]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("of_label"), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "of_label", "code", "error"])

    # In a struct a null label is a key like any other.
    labelled = kept.select("vec_id", F.struct("label").alias("of_label"), "embedding")
    kind = labelled.schema["of_label"].dataType.simpleString()
    coded = stage_table(labelled.mapInArrow(run, f"vec_id long, of_label {kind}, {CODED}"), "codes")
    sums = coded.groupBy("of_label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error"))
    out = join_keyed(coded, sums, "of_label", "n", total)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same codes in DuckDB SQL, for vectors of one length that is a multiple of ``parts``."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS (
  SELECT vec_id, part, min(d * {entries} + entry) AS best
  FROM (SELECT c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM cells c JOIN book{r} b USING (part, pos) GROUP BY ALL)
  GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
sums{r} AS (
  SELECT c.part, (n.best % {entries})::BIGINT AS entry, c.pos, sum(c.x)::BIGINT AS s, count(*) AS n
  FROM cells c JOIN near{r} n USING (vec_id, part) GROUP BY ALL),
book{r + 1} AS (
  SELECT b.part, b.entry, b.pos, coalesce((s - ((s % n) + n) % n) // n, b.x) AS x
  FROM book{r} b LEFT JOIN sums{r} USING (part, entry, pos))""")
    return f"""
WITH raw AS (
  SELECT vec_id, len(embedding) // {parts} AS width, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i
  FROM embeddings WHERE embedding IS NOT NULL),
kept AS (
  SELECT vec_id, label FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id NOT IN (SELECT vec_id FROM raw WHERE v IS NULL OR NOT isfinite(v))),
comps AS (SELECT raw.* FROM raw JOIN kept USING (vec_id)),
cells AS (SELECT vec_id, (i // width)::BIGINT AS part, (i % width)::BIGINT AS pos, floor({scale} * v::DOUBLE)::BIGINT AS x FROM comps),
start AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}),
book0 AS (SELECT part, entry, pos, x FROM cells JOIN start USING (vec_id)),{",".join(steps)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', (best % {entries})::INT), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error
  FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""

"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A table rotates vectors ``hashes`` times by three rounds of sign flips and Hadamard transforms; each rotation's hash is
the signed axis with the largest coordinate. A vector's bucket joins the first axes of all rotations; it also visits the
buckets that take the second axis instead, in every combination. Two vectors meet in a bucket that is the own bucket
of one of them. Buckets first meet as sketches (the signs of one more rotation) and axes: a visit stays if some other
vector there is near by its sketch and meets it here for the first time. The vectors themselves are sent to those
visits alone, about once for each link, where pairs are verified in double precision; a pair counts in the first of
its meetings, so it is counted once without any list of pairs. Buckets with more than ``BLOCK`` vectors are cut into
blocks and a task takes a pair of blocks, so no bucket gathers in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_keyed, parts_for, stage_table
from .components import components, roots_of
from .words import combine

BLOCK = 1024
ROUNDS = 3
#: How likely a pair at the threshold is to meet under one rotation, and the most misses that tables are added for.
MEETS, MISSED = 0.715, 0.002
#: Bits of a sketch, and bits in which those of two vectors at a cosine of 0.9 differ by chance once in 10**9 at most.
SKETCH_BITS, SKETCH_FAR = 256, 72
_SAME_SIZE = 64


def tables_for(hashes: int) -> int:
    """Tables under which a pair at the threshold is missed with a probability of about ``MISSED``."""
    return math.ceil(math.log(MISSED) / math.log(1 - MEETS**hashes))


def padded(dim: int) -> int:
    """The power of two that a vector is padded to."""
    return 1 << max(1, (dim - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the number of columns is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d)


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for r in signs:
        x = hadamard(x * r)
    return x


def axes(x: np.ndarray, tables: int, hashes: int, kind: type = np.uint32, seed: int = 17) -> np.ndarray:
    """First and second signed axis of each vector: ``(vectors, tables, hashes, 2)``."""
    n, d = x.shape
    size = padded(d)
    x = np.hstack([x, np.zeros((n, size - d))]) if size != d else x
    out = np.empty((n, tables, hashes, 2), dtype=kind)
    rows = np.arange(n)
    rng = np.random.default_rng(seed + size)
    for t in range(tables):
        for k in range(hashes):
            y = rotated(x, rng.choice([-1.0, 1.0], size=(ROUNDS, size)))
            big = np.abs(y)
            for j in range(2):
                top = big.argmax(axis=1)
                out[:, t, k, j] = 2 * top + (y[rows, top] > 0)
                big[rows, top] = -1.0
    return out


def sketches(x: np.ndarray, seed: int = 29) -> np.ndarray:
    """``SKETCH_BITS`` signs of random directions of each vector, packed into 64-bit words."""
    rng = np.random.default_rng(seed + x.shape[1])
    signs = x @ rng.normal(size=(x.shape[1], SKETCH_BITS)) > 0
    return np.packbits(signs, axis=1).view(np.uint64)


def codes_of(picked: np.ndarray) -> np.ndarray:
    """Bucket numbers from the chosen axes ``(..., tables, hashes)``: a hash above the table's number in 8 bits."""
    tables, hashes = picked.shape[-2:]
    code = np.zeros(picked.shape[:-1], dtype=np.uint64) + np.arange(tables, dtype=np.uint64)
    for k in range(hashes):
        code = combine(code, picked[..., k].astype(np.uint64))
    return ((code & ~np.uint64(255)) | np.arange(tables, dtype=np.uint64)).view(np.int64)


HASHED = "vid long, copies long, dim int, vector binary, sketch binary, axes binary, codes array<long>"


def hash_vectors(distinct: DataFrame, tables: int, hashes: int, kind: type) -> DataFrame:
    """Unit vectors with their sketches, axes and bucket numbers; in ``codes`` the own buckets of all tables come first."""
    combos = sorted(product((0, 1), repeat=hashes), key=sum)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            place = np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes).tolist():
                whole = np.flatnonzero(sizes == d)
                for mine in np.split(whole, range(0, len(whole), max(1, (1 << 20) // d))):
                    if not len(mine):
                        continue
                    x = flat[place[mine][:, None] + np.arange(d)].astype(np.float64)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                    found = axes(x, tables, hashes, kind)
                    codes = np.stack([codes_of(np.stack([found[:, :, k, j] for k, j in enumerate(c)], axis=-1)) for c in combos], axis=1)
                    codes = codes.reshape(len(mine), -1)
                    bounds = pa.array(np.arange(len(mine) + 1, dtype=np.int32) * codes.shape[1])
                    raw = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
                    at = pa.array(mine)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("vid").take(at), batch.column("copies").take(at), pa.array([d] * len(mine), pa.int32()),
                            raw(x), raw(sketches(x)), raw(found), pa.ListArray.from_arrays(bounds, pa.array(codes.ravel())),
                        ],
                        names=["vid", "copies", "dim", "vector", "sketch", "axes", "codes"],
                    )

    return distinct.mapInArrow(run, HASHED)


def first_meeting(ax: np.ndarray, u: np.ndarray, v: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether ``bucket`` is the first in which ``u`` and ``v`` meet; ``ax``: ``(vectors, tables, hashes, 2)``."""
    a, b = ax[u], ax[v]
    in_v = ((a[..., 0] == b[..., 0]) | (a[..., 0] == b[..., 1])).all(axis=2)  # the own bucket of u is visited by v
    in_u = ((b[..., 0] == a[..., 0]) | (b[..., 0] == a[..., 1])).all(axis=2)
    meet = in_u | in_v
    table = bucket & 255
    each = np.arange(len(u))
    first = meet.argmax(axis=1) == table
    bu, bv = codes_of(a[..., 0])[each, table], codes_of(b[..., 0])[each, table]
    iu, iv = in_v[each, table], in_u[each, table]
    return first & meet[each, table] & ((iu & (bu == bucket) & ~(iv & (bv < bu))) | (iv & (bv == bucket) & ~(iu & (bu < bv))))


FOUND = "vid long, links long, other long"


CELL = ("bucket", "i", "j", "dim")


def near_in_cells(part: pa.Table, near, each: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows ``u, v`` of one cell for which ``near`` holds; rows are sorted by cell.

    ``near`` takes two stacks of row lists, ``(cells, m)`` and ``(cells, k)``, and says which pairs are near; ``each`` is
    the size of what it makes for a pair. Cells of two blocks compare the one with the other only.
    """
    side = part.column("side").to_numpy()
    cross = part.column("i").to_numpy() != part.column("j").to_numpy()
    fresh = np.ones(part.num_rows, dtype=bool)
    fresh[1:] = False
    for c in CELL:  # vectors of different lengths may share a bucket, but not a cell
        x = part.column(c).to_numpy()
        fresh[1:] |= x[1:] != x[:-1]
    start = np.flatnonzero(fresh)
    size = np.diff(np.append(start, part.num_rows))
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = (size <= _SAME_SIZE) & ~cross[start]
    dim = part.column("dim").to_numpy()
    for m, d in sorted(set(zip(size[small].tolist(), dim[start[small]].tolist()))):
        if m < 2:
            continue
        begin = start[small & (size == m) & (dim[start] == d)]
        upper = np.triu(np.ones((m, m), dtype=bool), 1)
        step = max(1, (1 << 22) // (m * m * each))
        for s in range(0, len(begin), step):
            rows = begin[s : s + step][:, None] + np.arange(m)
            c, i, j = np.nonzero(near(rows, rows) & upper)
            us.append(rows[c, i])
            vs.append(rows[c, j])
    for s, m in zip(start[~small].tolist(), size[~small].tolist()):
        rows = np.arange(s, s + m)
        a, b = (rows[side[rows] == 0], rows[side[rows] == 1]) if cross[s] else (rows, rows)
        step = max(1, (1 << 22) // max(1, len(b) * each))
        for t in range(0, len(a), step):
            _, i, j = np.nonzero(near(a[None, t : t + step], b[None, :]))
            i = i + t
            if not cross[s]:
                i, j = i[i < j], j[i < j]
            us.append(a[i])
            vs.append(b[j])
    return np.concatenate(us), np.concatenate(vs)


def by_cells(cells: DataFrame, settle, schema: str) -> DataFrame:
    """``settle`` over whole cells, some thousands of rows at a time; rows come sorted by ``CELL``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 20_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            same = np.ones(table.num_rows, dtype=bool)
            for c in CELL[:3]:
                same &= table.column(c).to_numpy() == table.column(c)[-1].as_py()
            cut = int(np.argmax(same))
            if cut:
                yield settle(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield settle(pa.Table.from_batches(held).combine_chunks())

    return cells.mapInArrow(run, schema)


def _axes_of(part: pa.Table, tables: int, hashes: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(part.column("axes").to_pylist()), dtype=kind).reshape(-1, tables, hashes, 2)


SEEN = "vid long, bucket long, i int, j int, side int, dim int"


def sketch_cells(cells: DataFrame, tables: int, hashes: int, kind: type) -> DataFrame:
    """The visits at which some vector meets another for the first time that is near by its sketch."""

    def settle(part: pa.Table) -> pa.RecordBatch:
        words = np.frombuffer(b"".join(part.column("sketch").to_pylist()), dtype=np.uint64).reshape(part.num_rows, -1)

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            apart = np.zeros((len(a), a.shape[1], b.shape[1]), dtype=np.uint16)
            for k in range(words.shape[1]):
                apart += np.bitwise_count(words[a, k][:, :, None] ^ words[b, k][:, None, :])
            return apart <= SKETCH_FAR

        u, v = near_in_cells(part, near, 4)
        ax, bucket = _axes_of(part, tables, hashes, kind), part.column("bucket").to_numpy()
        stay = np.zeros(part.num_rows, dtype=bool)
        step = max(1, (1 << 22) // (tables * hashes))
        for s in range(0, len(u), step):
            a, b = u[s : s + step], v[s : s + step]
            ok = first_meeting(ax, a, b, bucket[a])
            stay[a[ok]] = True
            stay[b[ok]] = True
        names = [x.split(" ")[0] for x in SEEN.split(", ")]
        return part.select(names).filter(pa.array(stay)).combine_chunks().to_batches()[0] if stay.any() else pa.RecordBatch.from_pylist([], part.select(names).schema)

    return by_cells(cells, settle, SEEN)


FOUND = "vid long, links long, other long"


def verify(cells: DataFrame, tables: int, hashes: int, kind: type, threshold: float) -> DataFrame:
    """``vid, links, other`` from rows sorted by ``CELL``: links counted here, and a vector that ``vid`` reaches."""

    def settle(part: pa.Table) -> pa.RecordBatch:
        vid = part.column("vid").to_numpy()
        copies = part.column("copies").to_numpy()
        bucket = part.column("bucket").to_numpy()
        raw = part.column("vector").to_pylist()

        def of(rows: np.ndarray) -> np.ndarray:
            return np.frombuffer(b"".join([raw[r] for r in rows.ravel().tolist()]), dtype=np.float64).reshape(*rows.shape, -1)

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            x = of(a)
            y = x if a is b else of(b)
            return x @ y.transpose(0, 2, 1) >= threshold

        u, v = near_in_cells(part, near, 64)
        ax = _axes_of(part, tables, hashes, kind)
        step = max(1, (1 << 22) // (tables * hashes))
        ok = [first_meeting(ax, u[s : s + step], v[s : s + step], bucket[u[s : s + step]]) for s in range(0, len(u), step)]
        if ok:
            ok = np.concatenate(ok)
            u, v = u[ok], v[ok]
        names, place = np.unique(vid, return_inverse=True)
        links = np.bincount(place[u], weights=copies[v], minlength=len(names)) + np.bincount(place[v], weights=copies[u], minlength=len(names))
        root = names[roots_of(len(names), place[u], place[v])]
        some = links > 0
        columns = [pa.array(names[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some], mask=(root == names)[some])]
        return pa.RecordBatch.from_arrays(columns, names=["vid", "links", "other"])

    return by_cells(cells, settle, FOUND)


def near_vectors(vectors: DataFrame, threshold: float = 0.9, tables: int | None = None, hashes: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (``vec_id``, ``embedding``).

    ``n_links`` counts the other rows at a cosine of ``threshold`` or more that share a bucket; ``component_id`` is the
    smallest ``vec_id`` that links reach. Null vectors, empty ones, zero vectors, and those with null or non-finite
    components link with nothing, nor do vectors of different lengths. Equal vectors are hashed once and link with each
    other, so repeated rows are links too; rows that share an id, but not a vector, are linked as other rows are; a null ``vec_id`` links with nothing and has a null component. An
    empty table gives no rows; other columns are not read. ``hashes`` grows with the logarithm of the number of distinct
    vectors, ``tables`` with ``hashes``; more than 256 tables (13 hashes) raise ``ValueError``. Vectors may have any length.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast(f"array<{kind}>").alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.coalesce(~bad & F.exists("embedding", lambda v: v != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    usable = rows.where(good)
    distinct = usable.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    distinct = stage_table(distinct.withColumn("vid", F.monotonically_increasing_id()), "vectors")
    size, dim, total = distinct.select(F.count("*"), F.max(F.size("embedding")), F.sum("copies")).first()
    if hashes is None:
        hashes = max(1, math.ceil(math.log(max(size, 1) / 8 + 1) / math.log(2 * max(dim or 2, 2))))
    tables = tables_for(hashes) if tables is None else tables
    if tables > 256:
        raise ValueError(f"{hashes} hashes need {tables} tables; at most 256 are supported")
    kind = np.uint16 if 2 * padded(dim or 2) <= 1 << 16 else np.uint32
    hashed = stage_table(hash_vectors(distinct.repartition(parts_for(spark, size, 20_000), "vid"), tables, hashes, kind), "hashed")
    visits = hashed.select("vid", F.posexplode("codes").alias("pos", "bucket"))
    visits = visits.select("vid", "bucket", (F.col("pos") < tables).cast("long").alias("own"))
    busy = visits.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("own").alias("own")).where("n > 1 and own > 0")
    busy = busy.select("bucket", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = join_keyed(visits.select("vid", "bucket"), busy, "bucket", "n", size * tables * 2**hashes)
    block = F.pmod(F.xxhash64("vid", F.lit(5)), F.col("blocks")).cast("int")
    met = met.withColumn("block", block).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("vid", "bucket", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), (F.col("block") > F.col("to")).cast("int").alias("side"))
    parts = parts_for(spark, size * tables * 2**hashes, 100_000)

    def dealt(rows: DataFrame, *columns: str) -> DataFrame:
        whole = rows.join(hashed.select("vid", *columns), "vid")
        return whole.repartition(parts, "bucket", "i", "j").sortWithinPartitions(*CELL)

    seen = stage_table(sketch_cells(dealt(met, "dim", "sketch", "axes"), tables, hashes, kind), "near-visits")
    found = verify(dealt(seen, "copies", "vector", "axes"), tables, hashes, kind, threshold)
    found = stage_table(found, "vector-links")
    links = found.groupBy("vid").agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select(F.col("vid").alias("a"), F.col("other").alias("b"))
    roots = stage_table(components(edges), "vector-roots")
    mine = distinct.select("vid", "first").join(roots, distinct["vid"] == roots["node"])
    tops = mine.groupBy("root").agg(F.min("first").alias("top"))
    known = distinct.join(links, "vid", "left").join(roots, distinct["vid"] == roots["node"], "left").join(tops, "root", "left")
    known = known.select("embedding", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("top", "first").alias("root"))
    marked = rows.withColumn("__good", good)
    out = join_keyed(marked.where("__good"), known, "embedding", "copies", total or 0).select("vec_id", "n", "root")
    lone = marked.where("not __good").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("root"))
    return out.unionByName(lone).select("vec_id", F.col("n").alias("n_links"), F.col("root").alias("component_id"), (F.col("vec_id") == F.col("root")).alias("kept"))

"""Sparse linear text models: features of whole texts, a bounded labelled sample, and a softmax fit.

A document's features are the distinct words it holds (A-Z lower-cased), the distinct beginnings of its longer
words, and a few dense measures. Features are 64-bit hashes; the model keeps the ``max_features`` that tell the
classes apart most clearly, so its size has a fixed bound and it can be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table, texts_of
from .words import distinct_per_row, lower_ascii, mix, text_blocks, word_hashes, word_spans

#: Lengths, in bytes, of the word beginnings that are features of longer words.
BEGINNINGS = (4, 5, 6)
#: Combinations of label values that a sample may have.
MAX_CLASSES = 256
#: Bytes of the blocks that texts are read in, so that a block's words stay small beside the model.
TEXT_BYTES = 1 << 20
DENSE = ("log_words", "distinct_share", "word_bytes", "symbol_share")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>{}[]=_\\^~/@")] = True


def block_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: feature hashes, the row of each (repeats included), dense measures, and words of each row."""
    low = lower_ascii(data)
    starts, ends, counts = word_spans(low, offsets)
    words = word_hashes(low, starts, ends)
    row = np.repeat(np.arange(len(counts)), counts)
    eight = np.ndarray((len(low) + 1,), dtype="<u8", buffer=np.concatenate([low, np.zeros(8, np.uint8)]).data, strides=(1,))
    hashes, rows = [words], [row]
    for n in BEGINNINGS:
        longer = np.flatnonzero(ends - starts > n)
        head = eight[starts[longer]] & np.uint64((1 << (8 * n)) - 1)
        hashes.append(mix(head + np.uint64(n << 56)))
        rows.append(row[longer])
    _, distinct = distinct_per_row(words, counts)
    some = np.maximum(counts, 1)
    size = np.maximum(np.diff(offsets), 1)
    symbols = np.diff(np.concatenate([[0], np.cumsum(_SYMBOL[data])])[offsets])
    letters = np.diff(np.concatenate([[0], np.cumsum(ends - starts)])[np.concatenate([[0], np.cumsum(counts)])])
    dense = np.stack([np.log1p(counts), distinct / some, np.minimum(letters / some, 30) / 10, symbols / size], axis=1)
    return np.concatenate(hashes), np.concatenate(rows), dense, counts


@dataclass
class Features:
    """The features that a model keeps, sorted, with a small filter in front of the search."""

    kept: np.ndarray

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.kept & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def present(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row and column of each kept feature that a row has, once each; dense measures; words of each row."""
        hashes, rows, dense, counts = block_features(data, offsets)
        near = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        hashes, rows = hashes[near], rows[near]
        if not len(self.kept) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), dense, counts
        at = np.minimum(np.searchsorted(self.kept, hashes), len(self.kept) - 1)
        hit = self.kept[at] == hashes
        cells = np.unique(rows[hit] * len(self.kept) + at[hit])
        return cells // len(self.kept), cells % len(self.kept), dense, counts


@dataclass
class Softmax:
    """Class scores ``X @ sparse + dense @ ... + bias`` and their softmax."""

    sparse: np.ndarray
    dense: np.ndarray
    bias: np.ndarray

    def scores(self, row: np.ndarray, col: np.ndarray, dense: np.ndarray) -> np.ndarray:
        out = dense @ self.dense + self.bias
        for c in range(out.shape[1]):
            out[:, c] += np.bincount(row, weights=self.sparse[col, c], minlength=len(dense))
        return out

    def probabilities(self, row: np.ndarray, col: np.ndarray, dense: np.ndarray) -> np.ndarray:
        z = self.scores(row, col, dense)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_softmax(
    row: np.ndarray, col: np.ndarray, dense: np.ndarray, target: np.ndarray, n_features: int,
    weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 150,
) -> Softmax:
    """Weighted multinomial logistic regression: full-batch Adam with a falling step; the outcome repeats."""
    n, classes = target.shape
    weight = np.ones(n) if weight is None else weight
    weight = weight / weight.sum()
    mean, spread = dense.mean(axis=0), dense.std(axis=0) + 1e-9
    scaled = (dense - mean) / spread
    now = [np.zeros((n_features, classes)), np.zeros((dense.shape[1], classes)), np.log(weight @ target + 1e-9)]
    first, second = [np.zeros_like(x) for x in now], [np.zeros_like(x) for x in now]
    for t in range(1, steps + 1):
        z = scaled @ now[1] + now[2]
        for c in range(classes):
            z[:, c] += np.bincount(row, weights=now[0][col, c], minlength=n)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        gap = (z / z.sum(axis=1, keepdims=True) - target) * weight[:, None]
        sparse = [np.bincount(col, weights=gap[row, c], minlength=n_features) for c in range(classes)]
        grads = [np.stack(sparse, axis=1) + l2 * now[0] / max(n_features, 1), scaled.T @ gap + l2 * now[1], gap.sum(axis=0)]
        rate = 0.15 * (1 - t / (steps + 1))
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            now[i] = now[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-7)
    return Softmax(now[0], now[1] / spread[:, None], now[2] - (mean / spread) @ now[1])


@dataclass
class Sample:
    """A labelled sample's kept features, dense measures, labels and population weights, one row a document."""

    features: Features
    row: np.ndarray
    col: np.ndarray
    dense: np.ndarray
    labels: np.ndarray
    weight: np.ndarray
    fold: np.ndarray


def labelled_sample(
    docs: DataFrame, labels: DataFrame, columns: list[str], per_class: int = 2500, max_features: int = 8192, folds: int = 5
) -> Sample:
    """A bounded sample of labelled documents: at most ``per_class`` of each combination of label values.

    Rows are taken in the order of a hash of the id, so a rerun takes the same. Labels that are null or whose
    document is missing are left out before classes are counted, so sample and weights describe ``docs`` itself.
    More than ``MAX_CLASSES`` combinations raise ``ValueError``. Repeated ids count once: of several labels the
    smallest of each column, of several texts the one whose features have the smallest hash. Empty tables give an
    empty sample. Feature counts are taken by Spark; what reaches
    the driver is bounded by ``per_class``, the number of classes and ``max_features``.
    """
    spark = docs.sparkSession
    named = labels.select(labels["doc_id"].cast("long").alias("doc_id"), *[labels[c].cast("int").alias(f"y{i}") for i, c in enumerate(columns)])
    ys = [f"y{i}" for i in range(len(columns))]
    named = named.na.drop().groupBy("doc_id").agg(*[F.min(y).alias(y) for y in ys])
    present = docs.select(docs["doc_id"].cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    named = stage_table(named.join(present, "doc_id", "left_semi"), "present-labels")
    kinds = sorted((tuple(r[y] for y in ys), r["count"]) for r in named.groupBy(*ys).count().limit(MAX_CLASSES + 1).collect())
    if len(kinds) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} combinations of label values in {columns}")
    picked = None
    for values, _ in kinds:
        of_class = named
        for y, v in zip(ys, values):
            of_class = of_class.where(F.col(y) == v)
        of_class = of_class.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = of_class if picked is None else picked.unionByName(of_class)
    empty = Sample(
        Features(np.zeros(0, np.uint64)), *[np.zeros(0, np.int64)] * 2, np.zeros((0, len(DENSE))),
        np.zeros((0, len(columns)), np.int64), np.zeros(0), np.zeros(0, np.int64),
    )
    if picked is None:
        return empty
    picked = picked.withColumn("class", F.concat_ws(",", *ys))
    texts = texts_of(docs).join(F.broadcast(picked), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_blocks(batch.column("text"), TEXT_BYTES):
                hashes, rows, dense, counts = block_features(data, offsets)
                order = np.lexsort((hashes, rows))
                hashes, rows = hashes[order], rows[order]
                new = np.ones(len(rows), dtype=bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
                hashes, rows = hashes[new], rows[new]
                bounds = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(counts)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, end - start),
                        batch.column("class").slice(start, end - start),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * dense.shape[1]), pa.array(dense.ravel())),
                    ],
                    names=["doc_id", "class", "features", "dense"],
                )

    found = stage_table(
        texts.mapInArrow(features, "doc_id long, class string, features array<long>, dense array<double>"), "labelled"
    )
    row = F.min_by(F.struct("features", "dense"), F.struct(F.xxhash64("features", "dense"), F.size("features"))).alias("r")
    found = found.groupBy("doc_id", "class").agg(row).select("doc_id", "class", "r.features", "r.dense")
    classes = [",".join(map(str, v)) for v, _ in kinds]
    sizes = {c: n for c, n in found.groupBy("class").count().collect()}
    total = sum(sizes.values())
    if not total:
        return empty

    n_of = {c: F.sum((F.col("class") == c).cast("long")).alias(f"n{i}") for i, c in enumerate(classes)}
    counted = found.select("class", F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("n"), *n_of.values())
    # The largest difference, in standard errors, between a class's share of the feature and its share of all.
    gap = [
        F.abs(F.col(f"n{i}") - F.col("n") * (sizes.get(c, 0) / total)) / F.sqrt(F.col("n") * F.lit(sizes.get(c, 0) / total * (1 - sizes.get(c, 0) / total) + 1e-9))
        for i, c in enumerate(classes)
    ]
    clear = F.greatest(*gap, F.lit(0.0)) if len(gap) > 1 else gap[0]
    kept = counted.where("n >= 4").withColumn("clear", clear).where("clear > 4").orderBy(F.desc("clear"), "f").limit(max_features)
    keep = np.array([r[0] for r in kept.select("f").collect()], dtype=np.int64).view(np.uint64)
    model_features = Features(np.sort(keep))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().view(np.uint64)
            at = np.minimum(np.searchsorted(model_features.kept, flat), max(len(model_features.kept) - 1, 0))
            hit = model_features.kept[at] == flat if len(model_features.kept) else np.zeros(len(flat), bool)
            ends = np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
            columns = pa.ListArray.from_arrays(pa.array(ends), pa.array(at[hit].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("class"), batch.column("dense"), columns], names=["doc_id", "class", "dense", "cols"]
            )

    known = found.select("doc_id", "class", "dense", "features")
    known = known.mapInArrow(cells, "doc_id long, class string, dense array<double>, cols array<int>")
    people = known.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow().combine_chunks()
    lists = people.column("cols").combine_chunks()
    cols = lists.flatten().to_numpy()
    rows = np.repeat(np.arange(people.num_rows, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    of_class = people.column("class").to_pylist()
    dense = people.column("dense").combine_chunks().flatten().to_numpy().reshape(people.num_rows, -1)
    population = {",".join(map(str, v)): n for v, n in kinds}
    weight = np.array([population[c] / sizes[c] for c in of_class])
    values = np.array([[int(x) for x in c.split(",")] for c in of_class], dtype=np.int64)
    return Sample(model_features, rows, cols, dense, values, weight, np.arange(people.num_rows) % folds)


def fit_on(sample: Sample, use: np.ndarray, target: np.ndarray, extra: np.ndarray | None = None, **options) -> Softmax:
    """:func:`fit_softmax` on the documents of ``use``, with ``extra`` dense columns."""
    dense = sample.dense if extra is None else np.hstack([sample.dense, extra])
    place = np.cumsum(use) - 1
    inside = use[sample.row]
    return fit_softmax(
        place[sample.row[inside]], sample.col[inside], dense[use], target[use], len(sample.features.kept), sample.weight[use], **options
    )

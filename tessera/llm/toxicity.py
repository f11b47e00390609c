"""Toxicity by a chain of linear classifiers.

The categories are label columns, in chain order. The model of each category sees a document's text features and
the log-odds that the models before it give; in training those come from out-of-fold predictions, so that a later
model meets earlier ones as they behave on new text. The threshold of the deciding category is the one with the
best F1 among the sample's out-of-fold predictions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .linear import TEXT_BYTES, Features, Softmax, fit_on, labelled_sample
from .words import text_blocks


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _binary(values: np.ndarray) -> np.ndarray:
    return np.stack([values == 0, values != 0], axis=1).astype(float)


@dataclass
class Chain:
    """Models in chain order over shared features, and each category's threshold."""

    categories: list[str]
    features: Features
    models: list[Softmax]
    thresholds: list[float]

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One column a category."""
        row, col, dense, _ = self.features.present(data, offsets)
        found: list[np.ndarray] = []
        for model in self.models:
            extra = np.stack([_odds(p) for p in found], axis=1) if found else np.zeros((len(dense), 0))
            found.append(model.probabilities(row, col, np.hstack([dense, extra]))[:, 1])
        return np.stack(found, axis=1)


def best_threshold(p: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> float:
    """The threshold with the best weighted F1; halfway to the next lower prediction."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(weight[order] * positive[order])
    taken = np.cumsum(weight[order])
    f1 = 2 * hit / (taken + (weight * positive).sum() + 1e-12)
    k = int(np.argmax(f1))
    below = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + below) / 2)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], per_class: int = 2500, folds: int = 5) -> Chain:
    """Fit on a bounded sample: at most ``per_class`` documents of each combination of category labels.

    With no labelled document every probability is 0 and nothing is toxic.
    """
    sample = labelled_sample(docs, labels, categories, per_class, folds=folds)
    n = len(sample.weight)
    models, thresholds = [], []
    extra = np.zeros((n, 0))
    for k in range(len(categories)):
        if not n:
            models.append(Softmax(np.zeros((0, 2)), np.zeros((sample.dense.shape[1] + k, 2)), np.array([50.0, -50.0])))
            thresholds.append(1.0)
            continue
        target = _binary(sample.labels[:, k])
        outside = np.zeros(n)
        for f in range(folds):
            held = sample.fold == f
            if not held.any() or held.all():
                continue
            model = fit_on(sample, ~held, target, extra)
            place = np.cumsum(held) - 1
            inside = held[sample.row]
            p = model.probabilities(place[sample.row[inside]], sample.col[inside], np.hstack([sample.dense, extra])[held])
            outside[held] = p[:, 1]
        models.append(fit_on(sample, np.ones(n, bool), target, extra))
        thresholds.append(best_threshold(outside, target[:, 1], sample.weight))
        extra = np.hstack([extra, _odds(outside)[:, None]])
    return Chain(categories, sample.features, models, thresholds)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` with ``p_<category>`` columns and ``toxic``: the last category's verdict.

    Whole texts are scored; null and empty texts have no words and get the models' scores of such. Null ids and repeated
    rows are scored as others are, equal texts alike; a probability equal to the threshold is toxic; an empty table
    gives no rows. All other columns are kept as they are, and a column of ``docs`` that has a new column's name gives way to it.
    """
    model = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]
    new = {*names, "toxic"}
    kept = [c for c in docs.columns if c not in new]
    others = [c for c in kept if c != "text"]
    inner = docs.select(F.struct(F.lit(0).alias("__"), *[docs[f"`{c}`"].alias(c) for c in others]).alias("row"), docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = model.value
        for batch in batches:
            p = [chain.probabilities(data, offsets) for _, _, data, offsets in text_blocks(batch.column("text"), TEXT_BYTES)]
            p = np.concatenate(p) if p else np.zeros((0, len(names)))
            columns = [pa.array(p[:, k]) for k in range(len(names))]
            toxic = pa.array(p[:, -1] >= chain.thresholds[-1])
            fields = ["row", "text", *[f"p{k}" for k in range(len(names))], "toxic"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, toxic], names=fields)

    schema = StructType([*inner.schema.fields, *[StructField(f"p{k}", DoubleType()) for k in range(len(names))], StructField("toxic", BooleanType())])
    out = inner.mapInArrow(run, schema)
    back = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in kept]
    return out.select(*back, *[F.col(f"p{k}").alias(n) for k, n in enumerate(names)], "toxic")


def toxicity(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("quality", "toxic"), **options) -> DataFrame:
    """Score every document by a chain fitted to ``labels``; see :func:`fit_chain` and :func:`score`."""
    return score(docs, fit_chain(docs, labels, list(categories), **options))


def clean_only(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the chain does not call toxic, with the columns of ``docs``."""
    columns = docs.columns
    return toxicity(docs, labels, **options).where(~F.col("toxic")).select(*[f"`{c}`" for c in columns])

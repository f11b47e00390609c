"""Soft-membership mixing of sources to target weights.

A classifier fitted to a labelled table gives each document the posterior of every domain. Document rates
``r >= 0`` then minimise ``|sum_i r_i n_i p_i / N - t|^2 + ridge * sum_i n_i / N * (r_i - 1)^2``, where ``n_i`` is a
document's tokens, ``p_i`` its posteriors, ``N`` all tokens and ``t`` the target share of each domain. The fit is
projected gradient descent with momentum: each round, Spark sums the domains' expected tokens over all documents
(one small vector a partition), and the next rate of each document follows from its own posteriors and the few
vectors so far, so rates are recomputed where they are needed and no document's rate meets the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table
from .linear import TEXT_BYTES, fit_on, labelled_sample
from .words import text_blocks

POSTERIORS = "doc_id long, n_tokens long, posterior array<double>"


def domain_posteriors(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...], per_class: int = 2500) -> tuple[DataFrame, list[str]]:
    """``doc_id, n_tokens, posterior`` of every document, and the domains' names such as ``quality=1,toxic=0``.

    Domains are the combinations of label values that the labelled sample holds; ``n_tokens`` counts words of
    the whole text (null: none). Without labelled documents there is one domain, ``all``. Rows with equal ids are rows of their own.
    """
    sample = labelled_sample(docs, labels, list(columns), per_class)
    if len(sample.weight):
        values, of = np.unique(sample.labels, axis=0, return_inverse=True)
        names = [",".join(f"{c}={v}" for c, v in zip(columns, row)) for row in values.tolist()]
        fitted = fit_on(sample, np.ones(len(of), bool), np.eye(len(values))[of.ravel()])
    else:
        names, fitted = ["all"], None
    model = docs.sparkSession.sparkContext.broadcast((sample.features, fitted))
    size = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, fitted = model.value
        for batch in batches:
            for start, end, data, offsets in text_blocks(batch.column("text"), TEXT_BYTES):
                row, col, dense, counts = features.present(data, offsets)
                p = fitted.probabilities(row, col, dense) if fitted else np.ones((len(dense), 1))
                bounds = np.arange(len(counts) + 1, dtype=np.int32) * size
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, end - start),
                        pa.array(counts.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(p.ravel())),
                    ],
                    names=["doc_id", "n_tokens", "posterior"],
                )

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return narrow.mapInArrow(run, POSTERIORS), names


def rates_after(posterior: np.ndarray, gradients: list[np.ndarray], ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """A document's rate after the given rounds, and the point at which the next round's sum is taken.

    ``gradients`` holds each round's residual ``sum_i look_i n_i p_i / N - t``.
    """
    rate = look = np.ones(len(posterior))
    momentum = 1.0
    for g in gradients:
        step = 1.0 / (1.0 + ridge)  # the metric of the token shares bounds the curvature by 1 + ridge
        nxt = np.maximum(0.0, look - step * (posterior @ g + ridge * (look - 1.0)))
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = nxt + (momentum - 1) / later * (nxt - rate)
        rate, momentum = nxt, later
    return rate, look


def fit_rates(table: DataFrame, target: np.ndarray, ridge: float = 1e-3, rounds: int = 60, tolerance: float = 1e-4) -> list[np.ndarray]:
    """The residual vectors of the rounds, at most ``rounds``; fewer once no residual moves by ``tolerance``."""
    size = len(target)
    total = table.agg(F.sum("n_tokens")).first()[0] or 0
    gradients: list[np.ndarray] = []
    if not total:
        return gradients

    def sums(history: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for batch in batches:
                p = batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                _, look = rates_after(p, history, ridge)
                out += (look * batch.column("n_tokens").to_numpy() / total) @ p
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names=[f"s{i}" for i in range(size)])

        return run

    for _ in range(rounds):
        part = table.mapInArrow(sums(list(gradients)), ", ".join(f"s{i} double" for i in range(size)))
        row = part.agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(size)]).first()
        gradients.append(np.array([row[i] for i in range(size)]) - target)
        if len(gradients) > 2 and max(np.abs(gradients[-1] - gradients[-2]).max(), np.abs(gradients[-2] - gradients[-3]).max()) < tolerance * 0.1:
            break
    return gradients


def mix(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float], columns: tuple[str, ...] = ("quality", "toxic"),
    budget: float = 1.0, ridge: float = 1e-3, **options,
) -> DataFrame:
    """``doc_id, n_tokens, posterior, domains, rate`` of every document.

    ``targets`` gives domains' shares of ``budget`` times all tokens; domains without one share nothing, and
    shares are scaled to sum to 1 over the domains at hand. Documents without words, null texts among them, keep rate
    1; null ids are rated as others are; repeated rows are rated alike, each for itself; an empty table gives no rows.
    Only ``doc_id`` and ``text`` are read.
    """
    table, names = domain_posteriors(docs, labels, columns, **options)
    table = stage_table(table, "posteriors")
    share = np.array([max(0.0, float(targets.get(n, 0.0))) for n in names])
    if not share.sum():
        share = np.ones(len(names))
    target = share / share.sum() * budget
    gradients = fit_rates(table, target, ridge)
    size = len(names)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            r, _ = rates_after(p, gradients, ridge)
            r = np.where(batch.column("n_tokens").to_numpy() > 0, r, 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r)], names=[*batch.schema.names, "rate"])

    domains = F.array(*[F.lit(n) for n in names])
    return table.mapInArrow(rate, POSTERIORS + ", rate double").withColumn("domains", domains)


def apply_rates(docs: DataFrame, rated: DataFrame) -> DataFrame:
    """Each document ``floor(rate + u)`` times, ``u`` uniform in [0, 1) by a hash of its id and text.

    The columns are those of ``docs``. Documents without a rate (a null id) come once; of several rates for one
    id the largest counts.
    """
    columns = docs.columns
    rates = rated.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max("rate").alias("__rate"))
    joined = docs.join(rates, docs["doc_id"].cast("long") == F.col("__id"), "left")
    u = F.pmod(F.xxhash64(docs["doc_id"], docs["text"]), F.lit(1 << 20)) / F.lit(float(1 << 20))
    times = F.floor(F.coalesce(F.col("__rate"), F.lit(1.0)) + u).cast("int")
    copies = joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), times)))
    return copies.select(*[docs[f"`{c}`"] for c in columns])

"""The training-corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import delete_at_end, work_dir
from tessera.llm.jaccard_join import one_of_each
from tessera.llm.mixing import apply_rates, mix
from tessera.llm.packing import pack_documents
from tessera.llm.pii import redact
from tessera.llm.queries import MIX_TARGETS, tokenizer_path
from tessera.llm.toxicity import clean_only


#: Tokens of the longest piece of a document.
PIECE = 1024


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier chain does not reject.

    Null and empty texts are scored as such; repeated rows are rows of their own; of an empty table nothing is left;
    without labels no document goes. All columns are kept, whatever their names.
    """
    return clean_only(docs, _labels(spark, sf_dir))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Empty, blank and null texts are alike to none and stay; rows with a null id stay as they are; of rows with one id
    each distinct text stays once. An empty table stays empty. All columns are kept.
    """
    return one_of_each(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the selected spans of its text replaced by their kinds.

    Null texts stay null; repeated rows and null ids are rows as others are; an empty table stays empty. All columns
    are kept; only ``text`` changes.
    """
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says.

    Rows with a null id, and texts without words, come once; rows with one id share its largest rate; an empty table
    stays empty. All columns are kept.
    """
    return apply_rates(docs, mix(docs, _labels(spark, sf_dir), MIX_TARGETS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with the sequences that hold them, under capacities that each may bind.

    Sequences have two pieces' room, at most twelve documents, and three quarters of the attention cost of a sequence
    that is one text. Null and empty texts are one end token; null ids and repeated rows are documents of their own;
    an empty table gives no rows.
    """
    return pack_documents(docs, tokenizer_path(), max_tokens=2 * PIECE, piece_tokens=PIECE, max_docs=12, max_cost=3 * PIECE**2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_per_group),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can fit neither the classifiers nor the packing; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage returns is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{work_dir(spark)}/tessera/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    delete_at_end(spark, folder)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fim, licenses, vector_codes
from .common import delete_at_end, work_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_bit_plane_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import read_tokens, write_tokens

    path = f"{work_dir(spark)}/tessera/tokens-{uuid.uuid4().hex}"
    write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_path())
    delete_at_end(spark, path)
    return read_tokens(spark, path)


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, _table(spark, sf_dir, "labels")).drop("text")


#: Shares of all tokens that the mix gives to the domains of the label table.
MIX_TARGETS = {"quality=1,toxic=0": 0.95, "quality=0,toxic=0": 0.04, "quality=1,toxic=1": 0.01}


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), MIX_TARGETS)


def op2_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_report

    return pii_report(_table(spark, sf_dir, "documents"))


def op3_cross_polytope_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_trie_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import lm_scores

    return lm_scores(_table(spark, sf_dir, "documents"))


def op7_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .perplexity import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op8_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_matches

    return license_matches(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_report(_table(spark, sf_dir, "documents"))


def op13_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_pii_boosting": op2_pii_boosting,
    "op3_cross_polytope_dedup": op3_cross_polytope_dedup,
    "op4_toxicity_chain": op4_toxicity_chain,
    "op5_token_group_join": op5_token_group_join,
    "op6_trie_lm_scoring": op6_trie_lm_scoring,
    "op7_perplexity_rules": op7_perplexity_rules,
    "op8_license_digest": op8_license_digest,
    "op9_soft_mixing": op9_soft_mixing,
    "op10_bit_plane_output": op10_bit_plane_output,
    "op11_vector_codes": op11_vector_codes,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_chunk_recipes": op13_chunk_recipes,
}
ORACLES: dict[str, str] = {
    "op8_license_digest": licenses.oracle_sql(),
    "op11_vector_codes": vector_codes.oracle_sql(),
    "op12_fill_in_middle": fim.oracle_sql(),
    "op13_chunk_recipes": exact_dedup.oracle_sql(),
}

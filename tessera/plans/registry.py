"""The registered queries of the library's own operators, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import collections, documents, epochs, recordings, relations, stored, streams  # noqa: F401
from .inputs import REGISTRY, SQL

QUERIES: dict = REGISTRY
ORACLES: dict[str, str] = SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by class, and how they depend on each other."""
    return documents.dependency_summary(spark, sf_dir)

"""Queries by name, with the SQL that checks them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import models, texts, vectors

QUERIES: dict = vectors.QUERIES | texts.QUERIES | models.QUERIES
ORACLE_SQL: dict[str, str] = vectors.ORACLE_SQL | texts.ORACLE_SQL | models.ORACLE_SQL


def entry(spark: SparkSession) -> DataFrame:
    """Documents to unit vectors: tokenised, encoded, pooled, normalised."""
    return QUERIES["embed_bert"](spark, os.environ.get("ENTRY_SF_DIR", "/root/testdata/sf0.001"))

"""Golden files: texts with the ids and vectors that a model must give, and refusals of files that prove nothing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "model string, cases array<struct<text:string,input_ids:array<bigint>,embedding:array<double>,hidden:array<array<double>>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(model, case, text, input_ids, embedding, hidden) of a golden JSON file; one without cases is an error."""
    rows = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(SCHEMA).json(path)
    if not rows.select(F.max(F.coalesce(F.size("cases"), F.lit(0)))).first()[0]:
        raise ValueError(f"{path}: no cases, so it would prove nothing")
    return rows.select("model", F.posexplode("cases").alias("case", "c")).select("model", "case", "c.text", "c.input_ids", "c.embedding", "c.hidden")


def write(path: str, model: str, cases: list[dict]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"model": model, "cases": cases}, f)

"""Packs: tensors as Parquet with the fingerprint of what they were made from; rebuilt when that changes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec

#: Columns of a pack.
SCHEMA = "name string, dtype string, shape array<int>, values array<float>, source string"


def fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """One row: `name:size:mtime` of each file in order of name, joined by line feeds."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.unix_millis("modificationTime").alias("ms"))
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "name", "length", "ms")))
    return files.agg(F.array_join(lines, "\n").alias("source"))


def write_pack(tensors: DataFrame, path: str, source: str) -> None:
    """The committer's rename makes it atomic; values are checked against shapes."""
    checked = tensors.withColumn("source", F.lit(source)).withColumn("fits", vec.elements(F.transform("shape", lambda d: d.cast("long"))) == F.size("values"))
    checked.filter(F.when(~F.col("fits"), F.raise_error(F.lit("a tensor's values don't fit its shape"))).otherwise(True)).drop("fits").write.mode("overwrite").parquet(path)


def open_pack(spark: SparkSession, path: str, source: str | None = None) -> DataFrame | None:
    """The tensors, or None where the pack is absent or was made from something else.

    A pack that is there but can't be read, lacks columns, or whose values don't fit their shapes is an error.
    """
    try:
        df = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    first = df.select("source").first()
    if first is None or source is not None and first["source"] != source:
        return None
    fits = vec.elements(F.transform("shape", lambda d: d.cast("long"))) == F.size("values")
    return df.withColumn("values", F.when(F.coalesce(fits, F.lit(False)), F.col("values")).otherwise(F.raise_error(F.concat(F.lit("pack: tensor "), F.coalesce("name", F.lit("without name")), F.lit(" doesn't fit its shape"))).cast("array<float>"))).drop("source")


def cached_pack(spark: SparkSession, path: str, source: str, build) -> DataFrame:
    found = open_pack(spark, path, source)
    if found is None:
        write_pack(build(), path, source)
        found = open_pack(spark, path, source)
    return found

"""Corpus pipeline: five stages over documents, each a llm operator, each written before the next reads it.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of `documents`, whatever others its input has.  run() applies them in order through Parquet files in
the shared folder.  An empty table passes through all stages.  Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textvec.llm.byte_bpe import encode_decode
from textvec.llm.common import hinted, stored, table
from textvec.llm.decontamination import decontamination
from textvec.llm.jaccard_join import jaccard_join
from textvec.llm.language_id import PER_LANGUAGE, fitted, language_id, training_rows
from textvec.llm.line_dedup import LEAST, line_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Of the n-grams that ordinary text shares with its language's filter, the share that a document must reach.
EVIDENCE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or whose n-grams no learned language has, go.

    lang becomes the predicted language.  The filters learn from the documents' own labels, on a
    bounded sample; a document's own label is never an input of its prediction.  Null and empty
    texts go; repeated rows go or stay together; without any label every text is und, and goes.
    """
    filters = fitted(training_rows(docs, PER_LANGUAGE))
    out = language_id(docs, filters, keep=("text", "source", "n_chars"))
    return out.filter((F.col("lang_pred") != "und") & (F.col("evidence") >= EVIDENCE)).withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: boilerplate lines of a source go; a document of which nothing is left goes too.

    Copies count as one page, so that near_duplicates meets whole groups of them and keeps one of each.
    Null texts stay; rows without a source are a host of their own; a line just at the ratio stays.
    """
    out = line_dedup(docs, distinct=True, least=LEAST).withColumn("n_chars", F.length("text").cast("long"))
    return out.filter(F.col("n_dropped").eqNullSafe(0) | (F.length(F.trim("text")) > 0)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: five words, similarity of 0.8; the document of smallest id of each group stays.

    Of rows that repeat an id one stays; rows without an id stay, as they link with nothing.
    """
    gone = stored(jaccard_join(docs, n=5, per_cent=80).filter("doc_id <> component_id").select(F.col("doc_id").alias("k")).distinct())
    twice = stored(docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select(F.col("doc_id").alias("k2")))
    out = docs.join(hinted(gone), docs["doc_id"] == gone["k"], "left_anti")
    if not twice.isEmpty():
        once = out.join(hinted(twice), F.col("doc_id") == F.col("k2"), "left_semi").dropDuplicates(["doc_id"])
        out = out.join(hinted(twice), F.col("doc_id") == F.col("k2"), "left_anti").unionByName(once)
    return out.select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that contain a benchmark item go.

    Null and empty texts contain none; rows without an id are never told apart, so they stay; rows
    that repeat an id go where one of them contains an item.
    """
    found = stored(decontamination(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("k")).distinct())
    return docs.join(hinted(found), docs["doc_id"] == found["k"], "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids encoded and decoded again; one row per document with the digests.

    Null texts count as empty; repeated rows give repeated results.
    """
    return encode_decode(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("decontamination", decontaminated), ("byte_bpe", tokens)]
#: Stages that SQL can't express: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs

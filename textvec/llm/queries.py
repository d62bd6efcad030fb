"""The thin queries opN_<name>: each operator over its whole table, digest columns as contracted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encode_decode
from .common import table
from .decontamination import decontamination
from .embedding_dedup import embedding_dedup
from .jaccard_join import jaccard_join
from .language_id import PER_LANGUAGE, fitted, language_id, training_rows
from .licenses import license_scan
from .line_dedup import MIN_PAGES, RATIO, line_dedup
from .pii import KINDS, pii
from .substring_dedup import substring_dedup
from .token_counts import token_counts

CONTEXT = 1024


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), n=3, per_cent=90)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_<kind> counts base spans; spans holds the added ones too, by start, then kind."""
    out = pii(table(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    order = F.array(*(F.lit(k) for k in KINDS))
    rank = lambda kind: F.when(F.array_contains(order, kind), F.array_position(order, kind)).otherwise(F.lit(99))
    every = F.transform(F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(k) for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(every).alias("spans"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of each benchmark item that a document contains, with the evidence."""
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that is left."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = f"""
WITH pages AS (SELECT source AS host, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT host, unnest(list_filter(list_distinct(parts), lambda x: NOT regexp_full_match(x, '[ \\t\\r\\f\\x0b]*'))) AS line FROM pages),
totals AS (SELECT source AS host, count(*) AS host_pages FROM documents GROUP BY 1),
bad AS (SELECT l.host, l.line FROM (SELECT host, line, count(*) AS pages FROM lines GROUP BY 1, 2) l JOIN totals t ON l.host IS NOT DISTINCT FROM t.host
        WHERE t.host_pages >= {MIN_PAGES} AND l.pages > t.host_pages * CAST({RATIO} AS DOUBLE)),
lists AS (SELECT host, list(line) AS bad FROM bad GROUP BY 1),
done AS (SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS parts,
                list_filter(string_split(d.text, chr(10)), lambda x: b.bad IS NULL OR NOT list_contains(b.bad, x)) AS kept
         FROM documents d LEFT JOIN lists b ON d.source IS NOT DISTINCT FROM b.host)
SELECT doc_id, CAST(coalesce(len(list_filter(parts, lambda x: NOT regexp_full_match(x, '[ \\t\\r\\f\\x0b]*'))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(parts) - len(kept), 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
FROM done
"""


def held_out(id_column) -> F.Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters learned from rows that aren't held out; a prediction for every row."""
    docs = table(spark, sf_dir, "documents")
    filters = fitted(training_rows(docs.filter(~held_out(F.col("doc_id"))), PER_LANGUAGE))
    return language_id(docs, filters).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > CONTEXT)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spans: label:start:end:edits of each fuzzy match, places in the lower-case words joined by one space."""
    out = license_scan(table(spark, sf_dir, "documents"))
    said = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"], s["end"], s["edits"])), ",")
    return out.withColumn("base_labels", F.array_join("base_labels", ",")).withColumn("labels", F.array_join("labels", ",")).withColumn("spans", said)


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_pii": op2_pii,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_decontamination": op5_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_language_id": op7_language_id,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_license_scan": op10_license_scan,
}
ORACLE_SQL = {"op6_line_dedup": OP6_SQL}

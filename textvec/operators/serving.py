"""Embedding requests as rows: JSON in, JSON out, the limits as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pipeline import Embedder, embed, tokenize_with

MAX_BATCH, MAX_BODY = 256, 32 << 20
NO_INPUT, EMPTY, BAD_JSON, BAD_INPUT = "missing input", "input is empty", "invalid JSON", "input must be a string or an array of strings"


def texts_of(given: Column) -> Column:
    """The texts of a request's input, a variant: a string or an array of strings, else null; nulls count as empty."""
    kind = F.schema_of_variant(given)
    one, many = F.try_variant_get(given, "$", "string"), F.try_variant_get(given, "$", "array<string>")
    return F.when(kind.isin("STRING", "VOID"), F.array(F.coalesce(one, F.lit("")))).when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.transform(many, lambda t: F.coalesce(t, F.lit(""))))


def problem(body: Column, document: Column, given: Column, texts: Column, max_batch: int = MAX_BATCH) -> Column:
    """The message with which a request is refused, null where it is served."""
    kind = F.coalesce(F.schema_of_variant(document), F.lit(""))
    return (
        F.when(F.octet_length(body) > MAX_BODY, "request body is too large")
        .when(~(kind.startswith("OBJECT") | (kind == "VOID")), BAD_JSON)
        .when(given.isNull(), NO_INPUT)
        .when(texts.isNull(), BAD_INPUT)
        .when(F.size(texts) == 0, EMPTY)
        .when(F.size(texts) > max_batch, F.concat(F.lit("batch of "), F.size(texts), F.lit(f" exceeds max-batch {max_batch}")))
    )


def error_envelope(message: Column) -> Column:
    return F.to_json(F.struct(F.struct(message.alias("message"), F.lit("invalid_request_error").alias("type")).alias("error")))


def health(model: str, dim: int) -> Column:
    return F.to_json(F.struct(F.lit("ok").alias("status"), F.lit(model).alias("model"), F.lit(dim).alias("dim")))


def parse(requests: DataFrame, body_col: str = "body", max_batch: int = MAX_BATCH) -> DataFrame:
    """requests with `texts` and `error`.

    The body is parsed once, to a variant, and decided by its type.  A body that repeats a key, or holds
    a string of over 20 million characters, counts as invalid JSON.
    """
    rows = requests.withColumn("__document", F.try_parse_json(body_col)).withColumn("__input", F.try_variant_get("__document", "$.input", "variant"))
    rows = rows.withColumn("texts", texts_of(F.col("__input")))
    return rows.withColumn("error", problem(F.col(body_col), F.col("__document"), F.col("__input"), F.col("texts"), max_batch)).drop("__document", "__input")


def envelope(model: str, vectors: Column, tokens: Column) -> Column:
    data = F.transform(vectors, lambda v, k: F.struct(F.lit("embedding").alias("object"), k.alias("index"), v.alias("embedding")))
    return F.to_json(F.struct(F.lit("list").alias("object"), data.alias("data"), F.lit(model).alias("model"), F.struct(tokens.alias("prompt_tokens"), tokens.alias("total_tokens")).alias("usage")))


def serve(requests: DataFrame, embedder: Embedder, model: str, id_col: str = "request_id", body_col: str = "body", max_batch: int = MAX_BATCH) -> DataFrame:
    """(id, status, response): every request answered; usage counts framed, truncated tokens."""
    parsed = parse(requests, body_col, max_batch)
    good = parsed.filter("error is null").select(id_col, F.posexplode("texts").alias("index", "text"))
    rows = tokenize_with(embed(good, embedder), embedder).withColumn("n", F.size("ids")).drop("ids")
    done = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("index", "embedding"))).alias("rows"), F.sum("n").alias("tokens"))
    answers = done.select(id_col, F.lit(200).alias("status"), envelope(model, F.transform("rows", lambda r: r["embedding"]), F.col("tokens")).alias("response"))
    refused = parsed.filter("error is not null").select(id_col, F.lit(400).alias("status"), error_envelope(F.col("error")).alias("response"))
    return answers.unionByName(refused)

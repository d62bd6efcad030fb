"""Encoder, configuration, validation, benchmark, serving and source queries."""

from __future__ import annotations

import json
import os
import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from ..functions.weights import embedding_sql, weight_sql
from ..operators import config, nn, pipeline, relational, serving
from ..sources import pack, safetensors
from ..sources.shared import fresh_path
from . import texts
from .texts import documents, spread
from .vectors import X, embeddings, gelu_sql, r4

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def _embed(spark: SparkSession, sf_dir: str, arch: str = "bert", **more) -> DataFrame:
    """Unit vectors of all documents: dimension, norm and the first component of each."""
    out = pipeline.embed(spread(documents(spark, sf_dir)), pipeline.Embedder.tiny(arch, **more))
    v = vec.doubles(F.col("embedding"))
    return out.select("doc_id", F.size("embedding").cast("long").alias("dim"), r4(vec.norm(v)).alias("norm"), r4(v[0]).alias("first"))


for _arch in ("bert", "distilbert", "mpnet", "roberta", "modernbert", "qwen3", "gemma", "nomic"):
    _add(f"embed_{_arch}", partial(_embed, arch=_arch))
_add("embed_sentencepiece", partial(_embed, arch="roberta", kind="sentencepiece"))
_add("embed_int8", partial(_embed, mode=nn.WEIGHTS))
_add("embed_int8_full", partial(_embed, mode=nn.FULL))
_add("embed_matryoshka", partial(_embed, dim=16))
_add("embed_cls", partial(_embed, pooling="cls"))


def embed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipeline.embed_tokens(spread(documents(spark, sf_dir)), pipeline.Embedder.tiny("bert", max_len=32))
    return out.select("doc_id", "pos", "token_id", r4(vec.norm(vec.doubles(F.col("hidden")))).alias("norm"))


_add("embed_tokens", embed_tokens)


def tokens_pool_to_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token vectors, averaged and normalised by SQL, against embed(): the largest difference of each document."""
    own = pipeline.Embedder.tiny("bert", max_len=32)
    docs = spread(documents(spark, sf_dir))
    tokens = pipeline.embed_tokens(docs, own).select("doc_id", F.posexplode("hidden").alias("j", "x"))
    pooled = tokens.groupBy("doc_id", "j").agg(F.avg("x").alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("r"))
    pooled = pooled.select("doc_id", vec.l2_normalize(F.transform("r", lambda r: r["x"])).alias("p"))
    whole = pipeline.embed(docs, own).select("doc_id", vec.doubles(F.col("embedding")).alias("e"))
    gap = F.array_max(F.zip_with("p", "e", lambda a, b: F.abs(a - b)))
    return pooled.join(whole, "doc_id").select("doc_id", (gap < 1e-5).alias("agrees"))


_add("tokens_pool_to_embed", tokens_pool_to_embed, "SELECT doc_id, true AS agrees FROM documents WHERE text IS NOT NULL")


def dedupe_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embed_once(): every row has its vector though each distinct text was encoded once."""
    out = pipeline.embed_once(documents(spark, sf_dir), pipeline.Embedder.tiny("bert"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("vectors"), F.countDistinct("text").alias("texts"))


_add("dedupe_embed", dedupe_embed, "SELECT count(*) AS n, count(text) AS vectors, count(DISTINCT text) AS texts FROM documents")


def try_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipeline.try_embed(documents(spark, sf_dir), pipeline.Embedder.tiny("bert"))
    return out.select("doc_id", F.col("result.error").isNull().alias("ok"))


_add("try_embed", try_embed, "SELECT doc_id, true AS ok FROM documents")


def quant_mode_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both int8 modes against single precision: within bounds, and not the same (the mode did run)."""
    docs = spread(documents(spark, sf_dir))
    for name, mode in (("plain", nn.FP32), ("w8", nn.WEIGHTS), ("full", nn.FULL)):
        docs = pipeline.embed(docs, pipeline.Embedder.tiny("bert", mode=mode), out=name)
    a, b, c = (vec.doubles(F.col(n)) for n in ("plain", "w8", "full"))
    return docs.filter("text is not null").agg((F.min(vec.cosine(a, b)) > 0.99).alias("w8_close"), (F.min(vec.cosine(a, c)) > 0.95).alias("full_close"), (F.max(F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))) > 1e-5).alias("w8_differs"), (F.max(F.array_max(F.zip_with(a, c, lambda x, y: F.abs(x - y)))) > 1e-5).alias("full_differs"))


_add("quant_mode_drift", quant_mode_drift, "SELECT true AS w8_close, true AS full_close, true AS w8_differs, true AS full_differs")

# A small BERT by joins and windows alone, against the same in SQL.

TINY = nn.tiny("bert", pipeline.tokenizer("wordpiece")[1], hidden=8, layers=1, heads=2, inter=16, max_len=32)
#: Documents of a task: 64,000 tokens at most, of a few hundred bytes each where they are sorted and summed.
TINY_ROWS = 2000


def tiny_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ids = pipeline.tokenize(docs, "wordpiece", TINY.max_len).select("doc_id", "ids")
    # the only shuffle, of ids; a number that is given stays, as small ids become many rows.  It follows the rows, which
    # Parquet's footers tell, not the session's splits: what a task sorts and sums then stays in memory
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // TINY_ROWS))
    # outer: else a filter on the ids goes below and each text is tokenised twice; a row without ids goes with the joins
    rows = ids.repartition(n, "doc_id").select(F.col("doc_id").alias("sid"), F.posexplode_outer("ids").alias("pos", "id"))
    return relational.bert_states(rows, TINY, nn.closed_form(TINY, float))


def embed_tiny_bert(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relational.bert_vectors(tiny_states(spark, sf_dir), TINY.hidden).select(F.col("sid").alias("doc_id"), F.posexplode("v").alias("j", "x"))
    return out.select("doc_id", F.col("j").cast("long").alias("j"), r4(F.col("x")).alias("value"))


def embed_tokens_tiny_bert(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tiny_states(spark, sf_dir).select(F.col("sid").alias("doc_id"), F.col("pos").cast("long").alias("pos"), F.posexplode("v").alias("j", "x"))
    return out.select("doc_id", "pos", F.col("j").cast("long").alias("j"), r4(F.col("x")).alias("value"))


def _tiny_sql(result: str) -> str:
    w = lambda name, o, i: weight_sql(nn.salt_of(name), o, i)
    linear = lambda name, source, width: f"SELECT doc_id, pos, o AS j, sum(x * ({w(name, 'o', 'j')})) + any_value({w(name + '.bias', '0', 'o')}) AS x FROM {source}, range({width}) r(o) GROUP BY doc_id, pos, o"
    normed = lambda name, source: f"(SELECT doc_id, pos, j, c / sqrt(avg(c * c) OVER (PARTITION BY doc_id, pos) + {TINY.eps}) * (1.0::DOUBLE + {w(name + '.g', '0', 'j')}) + {w(name + '.b', '0', 'j')} AS x FROM (SELECT *, x - avg(x) OVER (PARTITION BY doc_id, pos) AS c FROM {source}))"
    added = lambda a, b: f"(SELECT doc_id, pos, j, {a}.x + {b}.x AS x FROM {a} JOIN {b} USING (doc_id, pos, j))"
    return f"""WITH {texts.SEGMENTED}, t AS (SELECT doc_id, unnest(cut) AS id, generate_subscripts(cut, 1) - 1 AS pos FROM framed),
e AS (SELECT doc_id, pos, j, {embedding_sql('id', 'j')} + {w('position', 'pos', 'j')} + {w('type', '0', 'j')} AS x FROM t, range(8) r(j)),
n AS {normed('embed_norm', 'e')},
q AS ({linear('layer0.q', 'n', 8)}), k AS ({linear('layer0.k', 'n', 8)}), v AS ({linear('layer0.v', 'n', 8)}),
s AS (SELECT q.doc_id, q.pos, q.j // 4 AS head, k.pos AS kp, sum(q.x * k.x) * 0.5::DOUBLE AS s FROM q JOIN k ON q.doc_id = k.doc_id AND q.j = k.j GROUP BY 1, 2, 3, 4),
p AS (SELECT *, exp(s - max(s) OVER (PARTITION BY doc_id, pos, head)) AS p FROM s), a AS (SELECT *, p / sum(p) OVER (PARTITION BY doc_id, pos, head) AS a FROM p),
c AS (SELECT a.doc_id, a.pos, v.j, sum(a.a * v.x) AS x FROM a JOIN v ON a.doc_id = v.doc_id AND a.kp = v.pos AND a.head = v.j // 4 GROUP BY 1, 2, 3),
o AS ({linear('layer0.o', 'c', 8)}), n1 AS {normed('layer0.attn_norm', added('n', 'o'))},
u AS ({linear('layer0.up', 'n1', 16)}), g AS (SELECT doc_id, pos, j, {gelu_sql('x')} AS x FROM u), d AS ({linear('layer0.down', 'g', 8)}),
h AS {normed('layer0.mlp_norm', added('n1', 'd'))}, m AS (SELECT doc_id, j, avg(x) AS x FROM h GROUP BY 1, 2)
{result}"""


_add("embed_tiny_bert", embed_tiny_bert, _tiny_sql("SELECT doc_id, j, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 4) + 0.0 AS value FROM m"))
_add("embed_tokens_tiny_bert", embed_tokens_tiny_bert, _tiny_sql("SELECT doc_id, pos, j, round(x, 4) + 0.0 AS value FROM h"))

# Validation and benchmark figures.


def validate_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against itself with a closed-form error added: larger than the tolerance for every third id."""
    want = embeddings(spark, sf_dir).select("vec_id", F.array("vec_id").alias("input_ids"), F.col("v").alias("embedding"))
    size = F.when(F.col("vec_id") % 3 == 0, 0.01).otherwise(0.00001)
    got = want.withColumn("embedding", F.transform("embedding", lambda x, j: x + F.when(j == F.col("vec_id") % 64, size).otherwise(0.0))).withColumn("input_ids", F.array(F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("vec_id"))))
    out = pipeline.validate(want, got, "vec_id")
    return out.select("vec_id", "ids_equal", F.round("max_abs", 6).alias("max_abs"), F.round("cosine", 5).alias("cosine"), "passed")


_add("validate_golden", validate_golden, f"""WITH {X}, g AS (SELECT vec_id, j, x, x + CASE WHEN j = vec_id % 64 THEN CASE WHEN vec_id % 3 = 0 THEN 0.01::DOUBLE ELSE 0.00001::DOUBLE END ELSE 0 END AS y FROM x),
s AS (SELECT vec_id, max(abs(x - y)) AS m, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS c FROM g GROUP BY 1)
SELECT vec_id, vec_id % 7 <> 0 AS ids_equal, round(m, 6) AS max_abs, round(c, 5) AS cosine, vec_id % 7 <> 0 AND m <= 0.0001::DOUBLE AS passed FROM s""")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").filter("value is not null").select("event_type", "event_id", "user_id", F.col("value").alias("sec"))


def bench_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipeline.bench_stats(_runs(spark, sf_dir), ["event_type"])
    return out.select("event_type", "runs", *(F.round(c, 4).alias(c) for c in ("median", "p10", "p90", "spread")))


_STATS = "SELECT {keys}, count(*) AS runs, list_sort(list(value))[count(*) // 2 + 1] AS median, list_sort(list(value))[count(*) // 10 + 1] AS p10, list_sort(list(value))[count(*) * 9 // 10 + 1] AS p90 FROM {source} GROUP BY {keys}"
_add("bench_stats", bench_stats, f"WITH s AS ({_STATS.format(keys='event_type', source='(SELECT * FROM events WHERE value IS NOT NULL)')}) SELECT event_type, runs, round(median, 4) AS median, round(p10, 4) AS p10, round(p90, 4) AS p90, round(100 * (p90 - p10) / median, 4) AS spread FROM s")


def ab_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir).select(F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("engine"), (F.col("event_id") % 2).alias("order"), "sec")
    return pipeline.ab_compare(runs).select("order", F.round("A", 4).alias("a"), F.round("B", 4).alias("b"), F.round("ratio", 4).alias("ratio"), "drifts")


_ENGINES = "(SELECT value, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS engine, event_id % 2 AS \"order\" FROM events WHERE value IS NOT NULL)"
_add("ab_compare", ab_compare, f"WITH s AS ({_STATS.format(keys='engine, \"order\"', source=_ENGINES)}), w AS (SELECT \"order\", max(median) FILTER (engine = 'A') AS a, max(median) FILTER (engine = 'B') AS b FROM s GROUP BY 1), r AS (SELECT *, a / b AS ratio FROM w) SELECT \"order\", round(a, 4) AS a, round(b, 4) AS b, round(ratio, 4) AS ratio, (SELECT max(ratio) / min(ratio) FROM r) > 1.1 AS drifts FROM r")


def ab_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir).select(F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("engine"), (F.col("event_id") % 2).alias("order"), "sec")
    out = pipeline.ab_verdict(runs)
    return out.select(*(F.round(c, 4).alias(c) for c in ("median_a", "median_b", "spread_a", "spread_b", "ratio")), "unstable_a", "unstable_b", "parity")


_SPREAD = "100 * (p90 - p10) / median"
_add("ab_verdict", ab_verdict, f"""WITH s AS ({_STATS.format(keys='engine', source=_ENGINES)}), o AS ({_STATS.format(keys='engine, "order"', source=_ENGINES)}),
w AS (SELECT max(median) FILTER (engine = 'A') AS a, max(median) FILTER (engine = 'B') AS b, max({_SPREAD}) FILTER (engine = 'A') AS sa, max({_SPREAD}) FILTER (engine = 'B') AS sb FROM s),
u AS (SELECT bool_or(u) FILTER (engine = 'A') AS ua, bool_or(u) FILTER (engine = 'B') AS ub FROM (SELECT engine, max(median) / min(median) - 1 > 0.1 AS u FROM o GROUP BY 1))
SELECT round(a, 4) AS median_a, round(b, 4) AS median_b, round(sa, 4) AS spread_a, round(sb, 4) AS spread_b, round(a / b, 4) AS ratio, ua AS unstable_a, ub AS unstable_b, 100 * abs(a / b - 1) < greatest(sa, sb) AS parity FROM w, u""")

# Configuration rules over literal rows.

_MODES = ['{"pooling_mode_mean_tokens": true}', '{"pooling_mode_cls_token": true, "pooling_mode_mean_tokens": false}', '{"pooling_mode_lasttoken": "1"}', '{"pooling_mode_max_tokens": true}', '{"pooling_mode_mean_tokens": true, "pooling_mode_cls_token": 1}', '{"word_embedding_dimension": 8}', '{"pooling_mode_cls_token": "False", "pooling_mode_mean_tokens": 1}', '{"pooling_mode_cls_token": "0"}', '{"pooling_mode_cls_token": "0", "pooling_mode_mean_tokens": true}', '{"pooling_mode_cls_token": 0, "pooling_mode_mean_tokens": 0.5}']
_REFS = ["org/name", "org/name.v1_2-x", "org", "/abs/path", "a/b/c", "../x/y", "org/..", "-a/b", "a/", "/b", "a b/c", "o1/n", "org/na me", "a/b..c"]
_SHARDS = ["model-00001-of-00002.safetensors", "", ".", "..", "a/b", "..\\x", "...", "x"]
_CONFIGS = [("bert", 512, 0), ("mpnet", 514, 1), ("roberta", 514, 1), ("modernbert", 8192, 0), ("qwen3", 32768, 0), ("roberta", 130, 5)]
_TYPES = [("bert", "BertTokenizer"), ("bert", "XLMRobertaTokenizerFast"), ("xlm-roberta", ""), ("roberta", ""), ("modernbert", ""), ("qwen3", ""), ("gemma3_text", ""), ("nomic_bert", ""), ("mpnet", ""), ("distilbert", "PreTrainedTokenizerFast")]


def _q(x) -> str:
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows)


def _literal(rows: list, schema: str, *columns):
    return lambda spark, sf_dir: spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select("*", *[f().alias(n) for n, f in columns])


_add("pooling_allowlist", _literal(_MODES, "doc string", ("mode", lambda: config.pooling_of(F.col("doc")))), f"""WITH m(doc) AS (VALUES {_values([(m,) for m in _MODES])}), k AS (SELECT doc, unnest(json_keys(doc)) AS k FROM m),
o AS (SELECT doc, k FROM k WHERE k LIKE 'pooling_mode_%' AND CASE json_type(doc, k) WHEN 'VARCHAR' THEN doc ->> k NOT IN ('', 'false', 'False') WHEN 'BOOLEAN' THEN doc ->> k = 'true' ELSE CAST(doc ->> k AS DOUBLE) <> 0 END)
SELECT m.doc, CASE WHEN count(o.k) = 1 THEN CASE any_value(o.k) WHEN 'pooling_mode_mean_tokens' THEN 'mean' WHEN 'pooling_mode_cls_token' THEN 'cls' WHEN 'pooling_mode_lasttoken' THEN 'lasttoken' END END AS mode FROM m LEFT JOIN o USING (doc) GROUP BY 1""")
_add("model_id_check", _literal(_REFS, "ref string", ("ok", lambda: config.model_id_ok(F.col("ref")))), f"SELECT ref, regexp_full_match(ref, '[A-Za-z0-9][A-Za-z0-9._-]*/[A-Za-z0-9._-]+') AND NOT contains(ref, '..') AS ok FROM (VALUES {_values([(r,) for r in _REFS])}) t(ref)")
_add("shard_name_check", _literal(_SHARDS, "name string", ("ok", lambda: config.shard_name_ok(F.col("name")))), f"SELECT name, name NOT IN ('', '.', '..') AND NOT contains(name, '/') AND NOT contains(name, chr(92)) AS ok FROM (VALUES {_values([(s,) for s in _SHARDS])}) t(name)")
_add("max_seq_len", _literal(_CONFIGS, "model_type string, positions long, pad long", ("max_len", lambda: config.max_seq_len(F.col("model_type"), F.col("positions"), F.col("pad")))), f"SELECT model_type, positions, pad, positions - CASE WHEN model_type IN ('mpnet', 'roberta') THEN pad + 1 ELSE 0 END AS max_len FROM (SELECT a AS model_type, b::BIGINT AS positions, c::BIGINT AS pad FROM (VALUES {_values(_CONFIGS)}) t(a, b, c))")
_add("tokenizer_files", _literal(_TYPES, "model_type string, class string", ("files", lambda: config.tokenizer_files(F.col("model_type"), F.col("class")))), f"SELECT model_type, class, CASE WHEN model_type = 'xlm-roberta' OR class LIKE 'XLMRobertaTokenizer%' THEN 'sentencepiece.bpe.model' WHEN model_type = 'roberta' THEN 'vocab.json,merges.txt?' WHEN model_type IN ('modernbert', 'qwen3', 'gemma3_text', 'gemma3') THEN 'tokenizer.json' WHEN model_type = 'nomic_bert' THEN 'vocab.txt' ELSE 'vocab.txt?' END AS files FROM (VALUES {_values(_TYPES)}) t(model_type, class)")


def tensor_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, shape and number of elements of each tensor of the tiny models."""
    rows = [(a, n, list(s)) for a in ("bert", "qwen3", "gemma", "nomic") for n, s in nn.tensors(nn.tiny(a, 100)).items()]
    return spark.createDataFrame(rows, "arch string, name string, shape array<int>").select("arch", "name", F.array_join("shape", "x").alias("shape"), vec.elements(F.transform("shape", lambda d: d.cast("long"))).alias("elements"))


_ONCE = {"bert": "embed 100x32, position 64x32, type 1x32, embed_norm.g 32, embed_norm.b 32", "qwen3": "embed 100x32, final_norm.g 32", "gemma": "embed 100x32, final_norm.g 32, dense1 48x32, dense2 32x48", "nomic": "embed 100x32, type 1x32, embed_norm.g 32, embed_norm.b 32"}
_EACH = {
    "bert": "q 32x32, k 32x32, v 32x32, o 32x32, q.bias 32, k.bias 32, v.bias 32, o.bias 32, up 64x32, up.bias 64, down 32x64, down.bias 32, attn_norm.g 32, attn_norm.b 32, mlp_norm.g 32, mlp_norm.b 32",
    "qwen3": "q 64x32, k 32x32, v 32x32, o 32x64, gate 64x32, up 64x32, down 32x64, in_norm.g 32, pre_mlp_norm.g 32, q_norm.g 16, k_norm.g 16",
    "gemma": "q 64x32, k 16x32, v 16x32, o 32x64, gate 64x32, up 64x32, down 32x64, in_norm.g 32, post_norm.g 32, pre_mlp_norm.g 32, post_mlp_norm.g 32, q_norm.g 16, k_norm.g 16",
    "nomic": "q 32x32, k 32x32, v 32x32, o 32x32, gate 64x32, up 64x32, down 32x64, attn_norm.g 32, attn_norm.b 32, mlp_norm.g 32, mlp_norm.b 32",
}
_MANIFEST = lambda of: ", ".join(f"('{a}', '{n}', '{s}')" for a, text in of.items() for n, s in (x.split() for x in text.split(", ")))
_add("tensor_manifest", tensor_manifest, f"WITH m AS (SELECT * FROM (VALUES {_MANIFEST(_ONCE)}) a(arch, name, shape) UNION ALL SELECT arch, 'layer' || k || '.' || name, shape FROM (VALUES {_MANIFEST(_EACH)}) b(arch, name, shape), range(2) r(k)) SELECT arch, name, shape, CAST(list_product(list_transform(string_split(shape, 'x'), lambda d: CAST(d AS BIGINT))) AS BIGINT) AS elements FROM m")

# Serving, over `conversations`: each turn is a request.


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("text is not null")
    body = F.when(F.col("turn") % 5 == 4, '{"model": "m"}').when(F.col("turn") % 5 == 3, '{"input": []}').when(F.col("turn") % 5 == 2, '{"input": [1, 2]}').when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("input")))).otherwise(F.to_json(F.struct(F.array("text", F.lit("x")).alias("input"))))
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), "turn", "text", body.alias("body"))


def request_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = serving.parse(_requests(spark, sf_dir))
    return out.select("request_id", F.coalesce(F.size("texts"), F.lit(-1)).cast("long").alias("n"), F.sha2(F.coalesce(F.array_join("texts", "\x01"), F.lit("")), 256).alias("digest"), "error")


_KIND = "CASE WHEN turn % 5 = 4 THEN 'missing input' WHEN turn % 5 = 3 THEN 'input is empty' WHEN turn % 5 = 2 THEN 'input must be a string or an array of strings' END"
_add("request_parse", request_parse, f"SELECT conv_id || '-' || turn AS request_id, CAST(CASE WHEN turn % 5 IN (2, 4) THEN -1 WHEN turn % 5 = 3 THEN 0 WHEN turn % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS n, sha256(CASE WHEN turn % 5 IN (2, 3, 4) THEN '' WHEN turn % 2 = 0 THEN text ELSE text || chr(1) || 'x' END) AS digest, {_KIND} AS error FROM conversations WHERE text IS NOT NULL")


def error_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = serving.parse(_requests(spark, sf_dir)).filter("error is not null")
    return out.select("request_id", serving.error_envelope(F.col("error")).alias("response"))


_add("error_envelope", error_envelope, f"""SELECT conv_id || '-' || turn AS request_id, '{{"error":{{"message":"' || {_KIND} || '","type":"invalid_request_error"}}}}' AS response FROM conversations WHERE text IS NOT NULL AND turn % 5 IN (2, 3, 4)""")


def response_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request answered; of each answer its status, number of vectors, model, and the usage's two counts agreeing."""
    out = serving.serve(_requests(spark, sf_dir), pipeline.Embedder.tiny("bert"), "tiny")
    get = lambda path: F.get_json_object("response", path)
    rows = F.from_json(F.col("response"), "object string, model string, data array<struct<index:int>>")
    return out.select("request_id", F.col("status").cast("long").alias("status"), F.coalesce(F.size(rows["data"]), F.lit(0)).cast("long").alias("n"), F.coalesce(rows["model"], F.lit("")).alias("model"), F.coalesce(get("$.usage.prompt_tokens") == get("$.usage.total_tokens"), F.lit(False)).alias("counted"))


_add("response_envelope", response_envelope, "SELECT conv_id || '-' || turn AS request_id, CAST(CASE WHEN turn % 5 < 2 THEN 200 ELSE 400 END AS BIGINT) AS status, CAST(CASE WHEN turn % 5 >= 2 THEN 0 WHEN turn % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS n, CASE WHEN turn % 5 < 2 THEN 'tiny' ELSE '' END AS model, turn % 5 < 2 AS counted FROM conversations WHERE text IS NOT NULL")
_add("health", lambda s, d: s.range(1).select(serving.health("tiny", 32).alias("response")), """SELECT '{"status":"ok","model":"tiny","dim":32}' AS response""")

# Sources: a tiny model's weights, written once to a file and read back through the data source.


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; tensors are read by place in a file, so it must be mounted."""
    path = re.sub(r"^file:/+", "/", fresh_path(spark, "weights"))
    if "://" in path:
        raise ValueError(f"{path} isn't mounted: model files need a shared folder of scheme file")
    os.makedirs(path)
    return path


def safetensors_scan(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    """name, shape and sum of each tensor of two shards, written by the driver to the shared folder."""
    folder = _folder(spark)
    values = {f"t{k}": nn.weights.weight(k, 8, 16) for k in range(6)}
    for shard in (0, 1):
        safetensors.write(os.path.join(folder, f"s{shard}.safetensors"), {n: v for k, (n, v) in enumerate(values.items()) if k % 2 == shard})
    with open(os.path.join(folder, "model.safetensors.index.json"), "w", encoding="utf-8") as f:
        json.dump({"weight_map": {n: f"s{k % 2}.safetensors" for k, n in enumerate(values)}}, f)
    df = safetensors.read(spark, folder)
    df = df.filter(F.col("name") == only) if only else df
    return df.select("name", "dtype", F.array_join("shape", "x").alias("shape"), r4(vec.total(vec.doubles(F.col("values")))).alias("total"))


def safetensors_dtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tensor in three types: widened to single precision, by the largest error of each."""
    folder, x = _folder(spark), nn.weights.weight(3, 8, 16)
    for kind in ("F32", "F16", "BF16"):
        safetensors.write(os.path.join(folder, f"{kind}.safetensors"), {"t": x}, kind)
    scans = [safetensors.read(spark, os.path.join(folder, f"{kind}.safetensors")) for kind in ("F32", "F16", "BF16")]
    rows = scans[0].unionByName(scans[1]).unionByName(scans[2])
    want = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda n: ((F.floor(n / 16) * 31 + n % 16 * 17 + 303) % 97 - 48) / F.lit(480.0))
    gap = F.array_max(F.zip_with(vec.doubles(F.col("values")), want, lambda a, b: F.abs(a - b)))
    return rows.select("dtype", F.size("values").cast("long").alias("n"), F.when(gap < 1e-8, 8).when(gap < 1e-4, 4).when(gap < 1e-3, 3).otherwise(0).cast("long").alias("places"))


_add("safetensors_dtypes", safetensors_dtypes, "SELECT dtype, 128::BIGINT AS n, places::BIGINT AS places FROM (VALUES ('F32', 8), ('F16', 4), ('BF16', 3)) t(dtype, places)")


def _tensor_sql(where: str) -> str:
    return f"SELECT 't' || k AS name, 'F32' AS dtype, '8x16' AS shape, round(sum(CAST(((o * 31 + i * 17 + k * 101) % 97 - 48) / 480.0::DOUBLE AS FLOAT)::DOUBLE), 4) + 0.0 AS total FROM range(6) a(k), range(8) b(o), range(16) c(i) WHERE {where} GROUP BY k"


_add("safetensors_scan", safetensors_scan, _tensor_sql("true"))
_add("safetensors_pushdown", partial(safetensors_scan, only="t3"), _tensor_sql("k = 3"))


def pack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a pack, opened with the right fingerprint, refused with another."""
    path = os.path.join(_folder(spark), "pack")
    rows = spark.range(6).select(F.concat(F.lit("t"), "id").alias("name"), F.lit("F32").alias("dtype"), F.array(F.lit(8), F.lit(16)).alias("shape"), F.expr(f"transform(sequence(0, 127), n -> cast({weight_sql(0, 'n div 16 + id * 0', 'n % 16')} as float))").alias("values"))
    found = pack.cached_pack(spark, path, "v1", lambda: rows)
    stale = pack.open_pack(spark, path, "v2") is None
    return found.select("name", F.size("values").cast("long").alias("n"), F.lit(stale).alias("stale_refused"))


_add("pack_roundtrip", pack_roundtrip, "SELECT 't' || range AS name, 128::BIGINT AS n, true AS stale_refused FROM range(6)")


def source_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    for name, size in (("b.bin", 5), ("a.bin", 3)):
        with open(os.path.join(folder, name), "wb") as f:
            f.write(b"x" * size)
    out = pack.fingerprint(spark, folder)
    return out.select(F.regexp_replace("source", r":[0-9]+(\n|\z)", "$1").alias("source"))


_add("source_fingerprint", source_fingerprint, "SELECT 'a.bin:3' || chr(10) || 'b.bin:5' AS source")

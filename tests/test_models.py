"""Encoders against plain loops in double precision, quantisation bounds, configuration, sources, serving, streaming."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from textvec.operators import config, nn, pipeline, relational, serving
from textvec.plans import models
from textvec.sources import safetensors
from textvec.streaming.serve import embed_stream, serve_stream

ARCHS = ("bert", "distilbert", "mpnet", "roberta", "modernbert", "qwen3", "gemma", "nomic")


def loops(s, ids):
    """The forward pass again: loops over positions and heads, double precision, nothing shared but erf's constants."""
    w = {k: v.astype(np.float64) for k, v in nn.closed_form(s).items()}
    d, n, classic = s.dim_head, len(ids), s.arch in ("bert", "distilbert", "roberta", "mpnet")

    def lin(x, name):
        return w[name] @ x + w.get(name + ".bias", 0)

    def norm(x, name, head=False):
        if name + ".g" not in w:
            return x
        g = w[name + ".g"] + (1 if s.arch == "gemma" else 0)
        if s.arch in ("qwen3", "gemma"):
            return x / math.sqrt(sum(v * v for v in x) / len(x) + s.eps) * g
        mean = sum(x) / len(x)
        var = sum((v - mean) ** 2 for v in x) / len(x)
        return (x - mean) / math.sqrt(var + s.eps) * g + w.get(name + ".b", 0)

    def turn(x, p, theta):
        out = x.copy()
        for k in range(d // 2):
            a = p * theta ** (-2 * k / d)
            out[k], out[k + d // 2] = x[k] * math.cos(a) - x[k + d // 2] * math.sin(a), x[k + d // 2] * math.cos(a) + x[k] * math.sin(a)
        return out

    def gelu(v):
        t = 1 / (1 + 0.3275911 * abs(v / math.sqrt(2)))
        e = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * math.exp(-v * v / 2)
        return 0.5 * v * (1 + math.copysign(e, v))

    def bucket(delta):
        a = abs(delta)
        return (16 if delta > 0 else 0) + (a if a < 8 else min(15, 8 + int(math.log(a / 8) / math.log(16) * 8)))

    def attention(xs, k):
        p = f"layer{k}."
        local = s.arch == "modernbert" and k % s.every or s.arch == "gemma" and (k + 1) % s.every
        theta = s.local_theta if local else s.theta
        scale = (s.scalar or d) ** -0.5 if s.arch == "gemma" else d**-0.5
        q, key, val = ([lin(x, p + c) for x in xs] for c in "qkv")
        out = []
        for i in range(n):
            parts = []
            for h in range(s.heads):
                g = h // s.groups
                rows, score = [], []
                for j in range(n):
                    if s.arch == "qwen3" and j > i or local and (abs(i - j) > s.window // 2 if s.arch == "modernbert" else abs(i - j) >= s.window):
                        continue
                    a, b = q[i][h * d : h * d + d], key[j][g * d : g * d + d]
                    if s.arch in ("qwen3", "gemma"):
                        a, b = norm(a, p + "q_norm"), norm(b, p + "k_norm")
                    if s.arch in ("modernbert", "qwen3", "gemma", "nomic"):
                        a, b = turn(a, i, theta), turn(b, j, theta)
                    score.append(a @ b * scale + (w["relative"][bucket(j - i)][h] if s.arch == "mpnet" else 0))
                    rows.append(val[j][g * d : g * d + d])
                e = [math.exp(v - max(score)) for v in score]
                parts.append(sum(a / sum(e) * r for a, r in zip(e, rows, strict=True)))
            out.append(lin(np.concatenate(parts), p + "o"))
        return out

    def mlp(x, k):
        p = f"layer{k}."
        if classic:
            return lin(np.array([gelu(v) for v in lin(x, p + "up")]), p + "down")
        act = {"modernbert": gelu, "gemma": lambda v: 0.5 * v * (1 + math.tanh(math.sqrt(2 / math.pi) * (v + 0.044715 * v**3)))}.get(s.arch, lambda v: v / (1 + math.exp(-v)))
        return lin(np.array([act(a) for a in lin(x, p + "gate")]) * lin(x, p + "up"), p + "down")

    xs = []
    for p, i in enumerate(ids):
        x = w["embed"][i] * (math.sqrt(s.hidden) if s.arch == "gemma" else 1)
        if "position" in w:
            x = x + w["position"][p + (2 if s.arch in ("roberta", "mpnet") else 0)]
        xs.append(norm(x + (w["type"][0] if "type" in w else 0), "embed_norm"))
    for k in range(s.layers):
        p = f"layer{k}."
        if s.arch == "gemma":
            a = attention([norm(x, p + "in_norm") for x in xs], k)
            xs = [x + norm(y, p + "post_norm") for x, y in zip(xs, a, strict=True)]
            xs = [x + norm(mlp(norm(x, p + "pre_mlp_norm"), k), p + "post_mlp_norm") for x in xs]
        elif s.arch in ("modernbert", "qwen3"):
            a = attention([norm(x, p + "in_norm") for x in xs], k)
            xs = [x + y for x, y in zip(xs, a, strict=True)]
            xs = [x + mlp(norm(x, p + "pre_mlp_norm"), k) for x in xs]
        else:
            a = attention(xs, k)
            xs = [norm(x + y, p + "attn_norm") for x, y in zip(xs, a, strict=True)]
            xs = [norm(x + mlp(x, k), p + "mlp_norm") for x in xs]
    return np.array([norm(x, "final_norm") for x in xs])


@pytest.mark.parametrize("arch", ARCHS)
def test_encoder_equals_loops(arch):
    s = nn.tiny(arch, 90)
    ids = [3, 17, 44, 8, 60, 71, 2, 5, 33, 89, 12, 1]
    assert np.abs(nn.Encoder(s).tokens(ids) - loops(s, ids)).max() < 1e-4


def test_relational_bert_equals_loops(spark):
    s = nn.tiny("bert", 50, hidden=12, layers=2, heads=3, inter=20, max_len=32)
    texts = {1: [2, 9, 9, 31, 3], 2: [2, 3], 3: [2, *range(5, 35), 3]}
    rows = spark.createDataFrame([(k, p, i) for k, ids in texts.items() for p, i in enumerate(ids)] + [(None, 0, 2)], "sid long, pos int, id long")
    states = relational.bert_states(rows, s, nn.closed_form(s, float))
    got = {(r.sid, r.pos): r.v for r in states.filter(F.size("v") == 12).collect()}
    assert sorted(got) == [(k, p) for k, ids in texts.items() for p in range(len(ids))]
    for k, ids in texts.items():
        assert np.allclose([got[k, p] for p in range(len(ids))], loops(s, ids), atol=1e-5)


def test_relational_bert_of_odd_rows(spark):
    """Scores in the thousands have a softmax; a position beyond the table is refused, not left out."""
    s = nn.tiny("bert", 50, hidden=8, layers=1, heads=2, inter=16, max_len=4)
    values = nn.closed_form(s, float)
    steep = values | {"layer0.q": values["layer0.q"] * 1e5}
    rows = lambda n: spark.createDataFrame([(1, p, 7 + p) for p in range(n)], "sid long, pos int, id long")
    assert np.isfinite([r.v for r in relational.bert_states(rows(4), s, steep).collect()]).all()
    with pytest.raises(Exception, match="no position 4"):
        relational.bert_states(rows(5), s, values).collect()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tiny_bert_shuffles_ids_once(spark, sf_dir):
    """Neither pairs of tokens nor their vectors are shuffled, and each text is tokenised once."""
    plan = plan_of(models.embed_tiny_bert(spark, sf_dir))
    assert (plan.count("Exchange hashpartitioning"), plan.count("ArrowEvalPython")) == (1, 1)


@pytest.mark.parametrize("query", (models.embed_tiny_bert, models.embed_tokens_tiny_bert))
def test_tiny_bert_is_compiled(spark, sf_dir, query):
    """No method of the code made for it is too long for the JVM's compiler, whatever columns are pruned."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = query(spark, sf_dir)._jdf.queryExecution().debug().codegenToSeq()
        assert max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_tiny_bert_tokens_shuffle_ids_once(spark, sf_dir):
    plan = plan_of(models.embed_tokens_tiny_bert(spark, sf_dir))
    assert (plan.count("Exchange"), plan.count("SortMergeJoin"), plan.count("ArrowEvalPython")) == (3, 0, 1)  # two are the broadcasts of the tables


def test_tiny_bert_tasks_follow_the_rows(spark, tmp_path):
    """A file of one split and a session of few partitions still make tasks that sort and sum in memory."""
    spark.range(10 * models.TINY_ROWS + 1).selectExpr("id AS doc_id", "'one two' AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert models.documents(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    states = models.tiny_states(spark, str(tmp_path))
    assert states.rdd.getNumPartitions() == 11 and states.select("sid").distinct().count() == 10 * models.TINY_ROWS + 1


def test_refusals():
    e = nn.Encoder(nn.tiny("bert", 90))
    for bad in ([], [90], [-1], [1] * 65):
        with pytest.raises(ValueError):
            e.tokens(bad)
    with pytest.raises(ValueError):
        nn.Encoder(nn.tiny("bert", 90), dim=33)
    with pytest.raises(ValueError):
        nn.pack_weight(np.array([[np.nan]]))


def test_modes():
    s, ids = nn.tiny("bert", 90), [3, 17, 44, 8]
    plain = nn.Encoder(s).pooled(ids)
    for mode, least in ((nn.WEIGHTS, 0.998), (nn.FULL, 0.95)):
        e = nn.Encoder(s, mode=mode)
        got = e.pooled(ids)
        assert e.mode_active == mode and least < float(got @ plain) and np.abs(got - plain).max() > 1e-5
    u, scale = nn.quantize_rows(np.array([[127, -127, 0.0]], np.float32))
    assert u.tolist() == [[255, 1, 128]] and scale[0] == 1
    w = nn.weights.weight(3, 16, 32)
    q, sc = nn.pack_weight(w.astype(np.float32))
    assert np.abs(q * sc[:, None] - w).max() <= sc.max() / 2 + 1e-7


def test_matryoshka():
    s, ids = nn.tiny("bert", 90), [3, 17, 44]
    full, short = nn.Encoder(s).pooled(ids), nn.Encoder(s, dim=16).pooled(ids)
    assert np.allclose(short, full[:16] / np.linalg.norm(full[:16]), atol=1e-6)


def test_partitions_dont_matter(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["hello there", "", "the other thing", None] * 5)], "doc_id long, text string")
    own = pipeline.Embedder.tiny("modernbert")
    got = [{r["doc_id"]: r["embedding"] for r in pipeline.embed(df.repartition(n), own).collect()} for n in (1, 4, 16)]
    assert got[0] == got[1] == got[2] and got[0][3] is None and len(got[0][1]) == 32
    pipeline.register(spark, own)
    assert spark.sql("SELECT size(embed('hello there')) AS n").first()["n"] == 32
    assert df.limit(0).transform(lambda d: pipeline.embed(d, own)).count() == 0


def test_vocabulary_must_fit():
    with pytest.raises(ValueError):
        pipeline.Embedder(nn.tiny("bert", 7), "wordpiece")


BASE = {"hidden_size": 8, "num_hidden_layers": 1, "num_attention_heads": 2, "intermediate_size": 8, "vocab_size": 9, "max_position_embeddings": 16}
MEAN, MODULES = {"pooling_mode_mean_tokens": True}, [{"type": "x.models.Transformer"}, {"type": "x.models.Pooling"}, {"type": "x.models.Normalize"}]


def derive(kind, tok=None, **more):
    return config.derive(BASE | {"model_type": kind} | more, {"do_lower_case": True} if tok is None else tok, MEAN, MODULES, {"out_features": 4})


def test_derive():
    assert derive("bert").normalize and derive("bert").do_lower_case
    g = derive("gemma3_text", {}, head_dim=4, num_key_value_heads=1, rope_theta=1e6, rope_local_base_freq=1e4, sliding_window=512, _sliding_window_pattern=6, query_pre_attn_scalar=4, use_bidirectional_attention=True, hidden_activation="gelu_pytorch_tanh")
    assert g.sliding_window == 257 and g.dense_hidden == 4
    r = derive("xlm-roberta", {}, pad_token_id=1)
    assert r.model_type == "roberta" and r.tokenizer == "sentencepiece" and r.max_seq_len == 14


@pytest.mark.parametrize("kind,more", [("gpt", {}), ("bert", {"hidden_act": "relu"}), ("roberta", {}), ("mpnet", {"pad_token_id": 1}), ("mpnet", {"pad_token_id": 1, "relative_attention_num_buckets": 16}), ("modernbert", {"norm_bias": True}), ("qwen3", {"rope_scaling": {}}), ("nomic_bert", {"causal": True}), ("bert", {"position_embedding_type": "relative_key"}), ("distilbert", {}), ("gemma3", {})])
def test_derive_refuses(kind, more):
    with pytest.raises(ValueError):
        derive(kind, {} if kind in ("roberta", "modernbert", "qwen3", "gemma3") else None, **more)


def test_pooling_refuses():
    for doc in ({}, {"pooling_mode_max_tokens": 1}, MEAN | {"pooling_mode_cls_token": "1"}):
        with pytest.raises(ValueError):
            config.pooling_mode(doc)
    assert config.pooling_mode(MEAN | {"pooling_mode_cls_token": "False"}) == "mean"


def test_safetensors(spark, tmp_path):
    path = str(tmp_path / "model.safetensors")
    values = {"a": np.array([[1.5, -2.0]], np.float32), "b": np.array([0.5], np.float32)}
    for dtype in ("F32", "F16", "BF16"):
        safetensors.write(path, values, dtype)
        df = safetensors.read(spark, str(tmp_path))
        assert {r["name"]: list(r["values"]) for r in df.collect()} == {"a": [1.5, -2.0], "b": [0.5]}
    assert df.filter(F.col("name").isin("b", "c")).rdd.getNumPartitions() == 1
    with open(path, "r+b") as f:
        f.truncate(os.path.getsize(path) - 1)
    with pytest.raises(ValueError):
        safetensors.header(path)
    (tmp_path / "i.json").write_text(json.dumps({"weight_map": {"a": "../model.safetensors"}}))
    with pytest.raises(ValueError):
        safetensors.manifest(str(tmp_path / "i.json"))


def test_serving_errors(spark):
    bodies = ["{", "[]", '{"model": 1}', '{"input": 3}', '{"input": [1]}', '{"input": []}', '{"input": ["a", "b", "c"]}', '{"input": "a"}', '{"input": ["a"]}']
    got = [r["error"] for r in serving.parse(spark.createDataFrame([(b,) for b in bodies], "body string"), max_batch=2).collect()]
    assert got == [serving.BAD_JSON, serving.BAD_JSON, serving.NO_INPUT, serving.BAD_INPUT, serving.BAD_INPUT, serving.EMPTY, "batch of 3 exceeds max-batch 2", None, None]


def test_sql_functions(spark):
    own = pipeline.Embedder.tiny("bert")
    pipeline.register(spark, own, "tiny")
    spark.createDataFrame([(1, "the others"), (2, None)], "k int, text string").createOrReplaceTempView("said")
    rows = spark.sql("SELECT k, t.pos, t.token_id, t.hidden, tiny_ids(text) AS ids, tiny(text) AS v FROM said, LATERAL tiny_tokens(text) t ORDER BY pos").collect()
    assert {r["k"] for r in rows} == {1} and [r["token_id"] for r in rows] == rows[0]["ids"] == own.encode("the others")
    assert np.allclose([r["hidden"] for r in rows], own.ready()[1].tokens(own.encode("the others")), atol=1e-6) and len(rows[0]["v"]) == 32


def test_request_bodies(spark):
    """The variant decides by type: nested inputs don't count, nulls are empty texts, long bodies are no matter."""
    long = "x" * 1_000_000
    bodies = ['{"meta": {"input": "a"}}', '{"input": null}', '{"input": [null, "b"]}', '{"input": ["a", 1]}', '{"input": {"a": "b"}}', "null", '"text"', "", None, json.dumps({"input": long}), json.dumps({"input": [long, "\\ \" é\n"]}), json.dumps({"input": [["a"]]})]
    rows = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    got = {r["k"]: (r["texts"], r["error"]) for r in serving.parse(rows).collect()}
    assert [got[k][1] for k in range(12)] == [serving.NO_INPUT, None, None, serving.BAD_INPUT, serving.BAD_INPUT, serving.NO_INPUT, serving.BAD_JSON, serving.BAD_JSON, serving.BAD_JSON, None, None, serving.BAD_INPUT]
    assert got[1][0] == [""] and got[2][0] == ["", "b"] and got[9][0] == [long] and got[10][0] == [long, '\\ " é\n']


@pytest.mark.parametrize("partitions", [8, 200])
def test_bench_stats_of_many_rows(spark, partitions):
    """Ranks over ranges equal a sorted list: ties, a null key, keys of very different size, missing values."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        n = 400_000
        key = F.when(F.col("id") % 10 < 7, "large").when(F.col("id") % 10 < 9, "even").when(F.col("id") % 1000 == 999, "few")
        value = F.when(F.col("id") % 97 == 5, F.lit(None)).otherwise(F.floor(F.pmod(F.xxhash64("id"), F.lit(500_000)) / 3).cast("double"))
        runs = spark.range(n).select(key.alias("key"), value.alias("sec"), F.lit("more").alias("note")).cache()
        own = {}
        for r in runs.collect():
            if r["sec"] is not None:
                own.setdefault(r["key"], []).append(r["sec"])
        got = {r["key"]: r for r in pipeline.bench_stats(runs, ["key"]).collect()}
        assert set(got) == set(own) == {"large", "even", "few", None}
        for k, values in own.items():
            values.sort()
            m = len(values)
            assert (got[k]["runs"], got[k]["median"], got[k]["p10"], got[k]["p90"]) == (m, values[m // 2], values[m // 10], values[9 * m // 10])
        ranked = pipeline.ordered(runs.filter("sec is not null"), ["key"], "sec")
        assert ranked.count() == sum(map(len, own.values())) == ranked.select("key", "rank").distinct().count()
        runs.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_streams_equal_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("1", '{"input": ["hello", "there"]}'), ("2", "{")], "request_id string, body string").write.json(src)
    rows, own = [], pipeline.Embedder.tiny("bert")
    q = serve_stream(spark.readStream.schema("request_id string, body string").json(src), own, "tiny", lambda df, n: rows.extend(df.collect()), str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    assert sorted((r["request_id"], r["status"]) for r in rows) == [("1", 200), ("2", 400)]
    texts = spark.readStream.schema("request_id string, body string").json(src)
    out = embed_stream(texts, own, "body").writeStream.format("memory").queryName("vectors").trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert spark.table("vectors").count() == 2


def test_endpoint(spark):
    import threading
    import urllib.error
    import urllib.request

    from textvec.streaming.endpoint import endpoint

    own = pipeline.Embedder.tiny("bert")
    server = endpoint(spark, own, "tiny", max_batch=2)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data=None if body is None else body.encode()), timeout=60) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert call("/health") == (200, {"status": "ok", "model": "tiny", "dim": own.width})
        status, answer = call("/v1/embeddings", json.dumps({"input": ["the others", "a"]}))
        assert status == 200 and [d["index"] for d in answer["data"]] == [0, 1] and len(answer["data"][0]["embedding"]) == own.width
        assert answer["usage"]["prompt_tokens"] == len(own.encode("the others")) + len(own.encode("a"))
        assert call("/v1/embeddings", "{")[0] == 400 and "max-batch" in call("/v1/embeddings", json.dumps({"input": ["a"] * 3}))[1]["error"]["message"]
        assert call("/other")[0] == 404
    finally:
        server.shutdown()
        server.server_close()

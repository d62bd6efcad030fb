"""Model folders written from closed-form weights under public tensor names, and loaded again."""

import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from textvec import cli
from textvec.operators import checkpoint, config, nn, pipeline, vocab
from textvec.sources import golden, hub, pack, safetensors

TYPES = {"bert": "bert", "distilbert": "distilbert", "roberta": "roberta", "mpnet": "mpnet", "modernbert": "modernbert", "qwen3": "qwen3", "gemma": "gemma3", "nomic": "nomic_bert"}


def folder_of(tmp_path, arch, prefix=""):
    """A folder with the tiny model of an architecture, in a checkpoint's own names."""
    kind = pipeline.TOKENIZER_OF[arch]
    spec = nn.tiny(arch, pipeline.tokenizer(kind)[1])
    values = nn.closed_form(spec)
    whole: dict[str, dict[int, np.ndarray]] = {}
    for name, value in values.items():
        if name in ("dense1", "dense2"):
            os.makedirs(tmp_path / f"{int(name[-1]) + 1}_Dense")
            safetensors.write(str(tmp_path / f"{int(name[-1]) + 1}_Dense" / "model.safetensors"), {"linear.weight": value})
            continue
        own, part, _ = checkpoint.checkpoint_name(spec, name)
        whole.setdefault(prefix + own, {})[part] = np.concatenate([value, value + 9]) if name == "type" else value
    safetensors.write(str(tmp_path / "model.safetensors"), {n: np.concatenate([v for _, v in sorted(parts.items())]) for n, parts in whole.items()})
    offset = spec.pad + 1 if arch in ("roberta", "mpnet") else 0
    doc = {"name": f"tiny-{arch}", "model_type": TYPES[arch], "hidden_size": spec.hidden, "num_hidden_layers": spec.layers, "num_attention_heads": spec.heads, "intermediate_size": spec.inter, "vocab_size": spec.vocab, "max_position_embeddings": spec.max_len + offset, "layer_norm_eps": spec.eps, "pooling": spec.pooling, "normalize": True, "do_lower_case": kind == "wordpiece"}
    doc |= {"roberta": {"pad_token_id": 1, "cls_token": "<s>", "sep_token": "</s>", "unk_token": "<unk>"}, "mpnet": {"pad_token_id": 1, "relative_attention_num_buckets": 32}, "nomic": {"head_dim": spec.dim_head, "rope_theta": spec.theta}}.get(arch, {})
    doc |= {"modernbert": {"global_attn_every_n_layers": spec.every, "local_attention": spec.window, "global_rope_theta": spec.theta, "local_rope_theta": spec.local_theta, "cls_token": "<s>", "sep_token": "</s>", "unk_token": "<unk>"}, "qwen3": {"head_dim": spec.head_dim, "num_key_value_heads": spec.kv_heads, "rope_theta": spec.theta, "sep_token": "</s>"}}.get(arch, {})
    if arch == "gemma":
        doc |= {"tokenizer": "gemma", "head_dim": spec.head_dim, "num_key_value_heads": spec.kv_heads, "sliding_window": spec.window, "sliding_window_pattern": spec.every, "query_pre_attn_scalar": spec.scalar, "global_rope_theta": spec.theta, "local_rope_theta": spec.local_theta, "dense_hidden": spec.dense}
    (tmp_path / "manifest.json").write_text(json.dumps(doc))
    if kind == "wordpiece":
        (tmp_path / "vocab.txt").write_text("\n".join(vocab.wordpiece_vocab()) + "\n")
    elif arch == "roberta":
        (tmp_path / "vocab.json").write_text(json.dumps(vocab.bpe_vocab()))
        (tmp_path / "merges.txt").write_text("#version: 0.2\n" + "".join(f"{a} {b}\n" for a, b in vocab.bpe_merges()))
    else:
        words, merges = vocab.gemma_vocab() if arch == "gemma" else (vocab.bpe_vocab(), vocab.bpe_merges())
        added = [] if arch == "gemma" else [{"content": c, "id": words[c], "lstrip": left, "rstrip": right} for c, left, right in vocab.ADDED]
        (tmp_path / "tokenizer.json").write_text(json.dumps({"model": {"type": "BPE", "vocab": words, "merges": [f"{a} {b}" for a, b in merges], "byte_fallback": arch == "gemma"}, "added_tokens": added, "normalizer": {"type": "NFC"} if arch == "qwen3" else None}))
    return str(tmp_path), doc


TEXTS = ["the reading of others", "", "Straße, naïve? 42", "a longer text " * 40]


@pytest.mark.parametrize("arch", sorted(TYPES))
def test_loaded_model_equals_the_tiny_one(spark, tmp_path, arch):
    folder, _ = folder_of(tmp_path, arch, "bert." if arch == "bert" else "")
    own, want = checkpoint.load(spark, folder), pipeline.Embedder.tiny(arch)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string")
    a = {r["k"]: r["embedding"] for r in pipeline.embed(rows, own).collect()}
    b = {r["k"]: r["embedding"] for r in pipeline.embed(rows, want).collect()}
    assert own.name == f"tiny-{arch}" and all(np.allclose(a[k], b[k], atol=1e-6) for k in b)
    ids = {r["k"]: r["ids"] for r in pipeline.tokenize_with(rows, own).collect()}
    assert ids == {k: want.encode(t) for k, t in enumerate(TEXTS)}


def test_load_refuses(spark, tmp_path):
    folder, doc = folder_of(tmp_path, "bert")
    lines = (tmp_path / "vocab.txt").read_text()
    (tmp_path / "vocab.txt").write_text(lines + "extra\n")
    with pytest.raises(ValueError, match="embedding rows"):
        checkpoint.load(spark, folder)
    (tmp_path / "vocab.txt").write_text(lines)
    (tmp_path / "manifest.json").write_text(json.dumps(doc | {"intermediate_size": 48}))
    with pytest.raises(ValueError, match="has shape"):
        checkpoint.load(spark, folder)
    (tmp_path / "manifest.json").write_text(json.dumps(doc | {"num_hidden_layers": 3}))
    with pytest.raises(ValueError, match="no tensor"):
        checkpoint.load(spark, folder)
    with pytest.raises(ValueError, match="pack"):
        checkpoint.load(spark, folder, nn.FULL, pack=str(tmp_path / "p"))
    with pytest.raises(ValueError, match="dim"):
        (tmp_path / "manifest.json").write_text(json.dumps(doc))
        checkpoint.load(spark, folder, dim=33)


def test_packs(spark, tmp_path):
    folder, _ = folder_of(tmp_path, "qwen3")
    where = str(tmp_path / "pack")
    one = checkpoint.load(spark, folder, pack=where)
    made = os.path.getmtime(where)
    two = checkpoint.load(spark, folder, pack=where)
    assert os.path.getmtime(where) == made and all((one.values[n] == two.values[n]).all() for n in one.values)
    assert pack.open_pack(spark, str(tmp_path / "none")) is None and pack.open_pack(spark, where, "other") is None
    bad = spark.read.parquet(where).withColumn("shape", F.array(F.lit(7)))
    bad.write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="doesn't fit its shape"):
        pack.open_pack(spark, str(tmp_path / "bad")).collect()
    os.makedirs(tmp_path / "broken")
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet|magic|footer"):
        pack.open_pack(spark, str(tmp_path / "broken"))


def test_golden_and_command_line(spark, tmp_path, capsys):
    folder, _ = folder_of(tmp_path, "distilbert")
    own = checkpoint.load(spark, folder)
    cases = [{"text": t, "input_ids": own.encode(t), "embedding": [float(x) for x in own.ready()[1].pooled(own.encode(t))]} for t in TEXTS]
    golden.write(str(tmp_path / "g.json"), "tiny", cases)
    assert golden.read(spark, str(tmp_path / "g.json")).count() == len(TEXTS)
    assert cli.main(["validate", "--model", folder, "--golden", str(tmp_path / "g.json")]) == 0
    cases[0]["embedding"][0] += 0.01
    golden.write(str(tmp_path / "h.json"), "tiny", cases)
    assert cli.main(["validate", "--model", folder, "--golden", str(tmp_path / "h.json")]) == 1
    golden.write(str(tmp_path / "e.json"), "tiny", [])
    assert cli.main(["validate", "--model", folder, "--golden", str(tmp_path / "e.json")]) == 1
    capsys.readouterr()
    assert cli.main(["embed", "--model", folder, "--full", "--dim", "16", "one text"]) == 0
    assert len(json.loads(capsys.readouterr().out)) == 16
    assert cli.main(["bench", "--model", folder, "--runs", "3", "--warmup", "0"]) == 0
    (tmp_path / "r.json").write_text(json.dumps({"request_id": "1", "body": json.dumps({"input": ["a", "b"]})}) + "\n" + json.dumps({"request_id": "2", "body": "{"}) + "\n")
    capsys.readouterr()
    assert cli.main(["serve", "--model", folder, "--requests", str(tmp_path / "r.json")]) == 0
    assert [json.loads(line)["status"] for line in capsys.readouterr().out.splitlines()] == [200, 400]
    assert cli.main(["embed", "--model", str(tmp_path / "nowhere"), "x"]) == 1


def test_errors_in_order_and_workers(spark):
    own = pipeline.Embedder.tiny("bert")
    rows = spark.range(40).select("id", F.lit("text").alias("text")).repartition(8)
    assert pipeline.embed(rows, own, workers=2).rdd.getNumPartitions() == 2
    out = spark.createDataFrame([(3, ("c",)), (1, (None,)), (2, ("b",))], "k int, result struct<error:string>")
    assert pipeline.first_error(out, "k") == "b" and pipeline.first_error(out.filter("k = 1"), "k") is None


def test_hub_rules():
    read = {"/h/token": " abc\n", "/home/.cache/huggingface/token": "def"}.get
    assert hub.token({"HF_TOKEN": " x ", "HOME": "/home"}, read) == "x" and hub.token({"HUGGING_FACE_HUB_TOKEN": "y"}, read) == "y"
    assert hub.token({"HF_HOME": "/h", "HOME": "/home"}, read) == "abc" and hub.token({"HOME": "/home"}, read) == "def" and hub.token({}, read) == ""
    assert hub.cache_dir({hub.CACHE: "/c", "HOME": "/home"}) == "/c" and hub.cache_dir({"HOME": "/home"}) == "/home/.cache/textvec" and hub.cache_dir({"XDG_CACHE_HOME": "/x"}) == "/x/textvec"
    with pytest.raises(ValueError):
        hub.cache_dir({})
    assert hub.files("qwen3", "", ["b.safetensors", "a.safetensors", "b.safetensors"]) == ["config.json", "tokenizer_config.json", "tokenizer.json", "modules.json", "1_Pooling/config.json", "model.safetensors.index.json", "a.safetensors", "b.safetensors"]
    assert "2_Dense/model.safetensors" in hub.files("gemma3_text", "") and hub.files("bert", "XLMRobertaTokenizerFast")[2] == "sentencepiece.bpe.model"
    with pytest.raises(ValueError):
        hub.files("t5", "")
    data = b"weights"
    assert hub.checksum_ok(data, f'"{hashlib.sha256(data).hexdigest()}"') and not hub.checksum_ok(data + b"x", hashlib.sha256(data).hexdigest())
    assert hub.checksum_ok(data, hashlib.sha1(b"blob 7\0weights").hexdigest()) and hub.checksum_ok(data, 'W/"other"')


def test_references(tmp_path):
    os.makedirs(tmp_path / "cache" / "org--name")
    os.makedirs(tmp_path / "models")
    cache = str(tmp_path / "cache")
    assert config.resolve(str(tmp_path)) == str(tmp_path) and config.resolve("org/name", cache) == config.resolve("hf:org/name", cache) == os.path.join(cache, "org--name")
    before = os.getcwd()
    os.chdir(tmp_path)
    try:
        with pytest.raises(FileNotFoundError, match="local path"):
            config.resolve("models/missing", cache)
        with pytest.raises(FileNotFoundError, match="cache"):
            config.resolve("hf:models/missing", cache)
        with pytest.raises(ValueError):
            config.resolve("../x/y", cache)
        (tmp_path / "file").write_text("")
        with pytest.raises(NotADirectoryError):
            config.resolve("file", cache)
    finally:
        os.chdir(before)

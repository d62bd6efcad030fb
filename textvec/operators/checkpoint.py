"""Checkpoints: tensor names of each architecture, tokenizers from a model's own files, and Embedder loading.

A folder holds manifest.json or a checkpoint's own configuration, tokenizer files and safetensors.
Tensors come through the `safetensors` source, by name, one partition each; with `pack` they are kept
as a Parquet pack with the fingerprint of the folder, and taken from there while that stays the same.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as patterns
from ..sources import pack as packs
from ..sources import safetensors
from . import config, nn, segment, vocab
from .pipeline import Embedder

#: Our names of architectures by the configuration's model types.
ARCH = {"": "bert", "bert": "bert", "distilbert": "distilbert", "roberta": "roberta", "mpnet": "mpnet", "modernbert": "modernbert", "qwen3": "qwen3", "gemma3": "gemma", "nomic_bert": "nomic"}

# Tensor names of public checkpoints (fixed values): those of a model, then of layer {k}.  A name with
# a slice takes rows of a fused tensor: 0/3 is the first third.
_BERT = {
    "embed": "embeddings.word_embeddings.weight", "position": "embeddings.position_embeddings.weight", "type": "embeddings.token_type_embeddings.weight",
    "embed_norm.g": "embeddings.LayerNorm.weight", "embed_norm.b": "embeddings.LayerNorm.bias", "relative": "encoder.relative_attention_bias.weight",
}
_BERT_LAYER = {
    "q": "encoder.layer.{k}.attention.self.query", "k": "encoder.layer.{k}.attention.self.key", "v": "encoder.layer.{k}.attention.self.value", "o": "encoder.layer.{k}.attention.output.dense",
    "attn_norm": "encoder.layer.{k}.attention.output.LayerNorm", "up": "encoder.layer.{k}.intermediate.dense", "down": "encoder.layer.{k}.output.dense", "mlp_norm": "encoder.layer.{k}.output.LayerNorm",
}
_MPNET_LAYER = _BERT_LAYER | {"q": "encoder.layer.{k}.attention.attn.q", "k": "encoder.layer.{k}.attention.attn.k", "v": "encoder.layer.{k}.attention.attn.v", "o": "encoder.layer.{k}.attention.attn.o", "attn_norm": "encoder.layer.{k}.attention.LayerNorm"}
_DISTIL_LAYER = {
    "q": "transformer.layer.{k}.attention.q_lin", "k": "transformer.layer.{k}.attention.k_lin", "v": "transformer.layer.{k}.attention.v_lin", "o": "transformer.layer.{k}.attention.out_lin",
    "attn_norm": "transformer.layer.{k}.sa_layer_norm", "up": "transformer.layer.{k}.ffn.lin1", "down": "transformer.layer.{k}.ffn.lin2", "mlp_norm": "transformer.layer.{k}.output_layer_norm",
}
_DECODER_LAYER = {
    "q": "layers.{k}.self_attn.q_proj", "k": "layers.{k}.self_attn.k_proj", "v": "layers.{k}.self_attn.v_proj", "o": "layers.{k}.self_attn.o_proj", "q_norm": "layers.{k}.self_attn.q_norm", "k_norm": "layers.{k}.self_attn.k_norm",
    "gate": "layers.{k}.mlp.gate_proj", "up": "layers.{k}.mlp.up_proj", "down": "layers.{k}.mlp.down_proj", "in_norm": "layers.{k}.input_layernorm", "pre_mlp_norm": "layers.{k}.post_attention_layernorm",
}
_GEMMA_LAYER = _DECODER_LAYER | {"post_norm": "layers.{k}.post_attention_layernorm", "pre_mlp_norm": "layers.{k}.pre_feedforward_layernorm", "post_mlp_norm": "layers.{k}.post_feedforward_layernorm"}
_MODERN_LAYER = {
    "q": "layers.{k}.attn.Wqkv 0/3", "k": "layers.{k}.attn.Wqkv 1/3", "v": "layers.{k}.attn.Wqkv 2/3", "o": "layers.{k}.attn.Wo", "in_norm": "layers.{k}.attn_norm",
    "gate": "layers.{k}.mlp.Wi 0/2", "up": "layers.{k}.mlp.Wi 1/2", "down": "layers.{k}.mlp.Wo", "pre_mlp_norm": "layers.{k}.mlp_norm",
}
_NOMIC_LAYER = {
    "q": "encoder.layers.{k}.attn.Wqkv 0/3", "k": "encoder.layers.{k}.attn.Wqkv 1/3", "v": "encoder.layers.{k}.attn.Wqkv 2/3", "o": "encoder.layers.{k}.attn.out_proj", "attn_norm": "encoder.layers.{k}.norm1",
    "up": "encoder.layers.{k}.mlp.fc11", "gate": "encoder.layers.{k}.mlp.fc12", "down": "encoder.layers.{k}.mlp.fc2", "mlp_norm": "encoder.layers.{k}.norm2",
}
NAMES = {
    "bert": (_BERT, _BERT_LAYER), "roberta": (_BERT, _BERT_LAYER), "mpnet": (_BERT, _MPNET_LAYER), "distilbert": (_BERT, _DISTIL_LAYER),
    "qwen3": ({"embed": "embed_tokens.weight", "final_norm.g": "norm.weight"}, _DECODER_LAYER), "gemma": ({"embed": "embed_tokens.weight", "final_norm.g": "norm.weight"}, _GEMMA_LAYER),
    "modernbert": ({"embed": "embeddings.tok_embeddings.weight", "embed_norm.g": "embeddings.norm.weight", "final_norm.g": "final_norm.weight"}, _MODERN_LAYER),
    "nomic": ({"embed": "embeddings.word_embeddings.weight", "type": "embeddings.token_type_embeddings.weight", "embed_norm.g": "emb_ln.weight", "embed_norm.b": "emb_ln.bias"}, _NOMIC_LAYER),
}
#: What a checkpoint may put in front of all names.
PREFIXES = ("", "bert.", "roberta.", "mpnet.", "distilbert.", "model.")


def spec_of(c: config.Config) -> nn.Spec:
    """The encoder's spec of a validated configuration."""
    arch = ARCH[c.model_type]
    own: dict = {"pad": c.pad_token_id} if arch in ("roberta", "mpnet") else {}
    if arch == "modernbert":
        own = {"every": c.global_attn_every_n_layers, "window": c.local_attention, "theta": c.global_rope_theta, "local_theta": c.local_rope_theta}
    elif arch == "qwen3":
        own = {"kv_heads": c.num_key_value_heads, "head_dim": c.head_dim, "theta": c.rope_theta}
    elif arch == "nomic":
        own = {"head_dim": c.head_dim, "theta": c.rope_theta}
    elif arch == "gemma":
        own = {"kv_heads": c.num_key_value_heads, "head_dim": c.head_dim, "every": c.sliding_window_pattern, "window": c.sliding_window, "theta": c.global_rope_theta, "local_theta": c.local_rope_theta, "scalar": c.query_pre_attn_scalar, "dense": c.dense_hidden}
    return nn.Spec(arch, c.vocab_size, c.hidden_size, c.num_hidden_layers, c.num_attention_heads, c.intermediate_size, c.max_seq_len, c.layer_norm_eps, c.pooling, c.normalize, **own)


def checkpoint_name(spec: nn.Spec, name: str) -> tuple[str, int, int]:
    """(tensor, part, parts) in a checkpoint for one of our tensors; parts over 1: rows of a fused one."""
    whole, layer = NAMES[spec.arch]
    if name in ("dense1", "dense2"):
        return f"{name[-1]}", 0, 1
    if not name.startswith("layer"):
        return whole[name], 0, 1
    k, own = name.removeprefix("layer").split(".", 1)
    base, _, kind = own.partition(".")
    text, _, slice_ = layer[base].format(k=k).partition(" ")
    part, parts = map(int, slice_.split("/")) if slice_ else (0, 1)
    return f"{text}.{'bias' if kind in ('b', 'bias') else 'weight'}", part, parts


def values_of(spec: nn.Spec, found: dict[str, np.ndarray], dense: list[np.ndarray] = ()) -> dict[str, np.ndarray]:
    """Our tensors from a checkpoint's; a missing one or a wrong shape is an error that names it."""
    prefix = next((p for p in PREFIXES if p + NAMES[spec.arch][0]["embed"] in found), None)
    if prefix is None:
        raise ValueError(f"no tensor {NAMES[spec.arch][0]['embed']}")
    out = {}
    for name, shape in nn.tensors(spec).items():
        own, part, parts = checkpoint_name(spec, name)
        if name in ("dense1", "dense2"):
            value = dense[int(name[-1]) - 1] if len(dense) == 2 else None
        else:
            value = found.get(prefix + own)
        if value is None:
            raise ValueError(f"no tensor {prefix + own}")
        if parts > 1:
            if value.shape[0] % parts:
                raise ValueError(f"tensor {prefix + own} of {value.shape[0]} rows isn't {parts} fused ones")
            rows = value.shape[0] // parts
            value = value[part * rows : (part + 1) * rows]
        if name == "type":
            value = value[:1]  # all tokens are of the first segment
        if tuple(value.shape) != shape:
            raise ValueError(f"tensor {prefix + own} has shape {list(value.shape)}, not {list(shape)}")
        out[name] = np.ascontiguousarray(value, dtype=np.float32)
    return out


def tokenizer_of(folder: str, c: config.Config):
    """The tokenizer that a configuration asks for, from the folder's files, and its vocabulary size."""
    path = lambda name: os.path.join(folder, name)
    if c.tokenizer == "gemma" or c.model_type in ("modernbert", "qwen3"):
        own = vocab.load_tokenizer_json(path("tokenizer.json"), need_bytes=c.tokenizer == "gemma")
        size = max(own.vocab.values()) + 1
        if c.tokenizer == "gemma":
            return segment.FallbackBPE(own.vocab, own.merges), size
        if c.model_type == "qwen3":
            return segment.ByteBPE(own.vocab, own.merges, own.added, prefix=None, suffix=c.sep_token, nfc=own.nfc, pattern=patterns.QWEN), size
        return segment.ByteBPE(own.vocab, own.merges, own.added, c.cls_token, c.sep_token, c.unk_token, own.nfc), size
    if c.tokenizer == "sentencepiece":
        with open(path("sentencepiece.bpe.model"), "rb") as f:
            model = vocab.parse_sentencepiece(f.read())
        own = segment.Unigram(model.pieces, vocab.decode_charsmap(model.charsmap))
        return own, own.size
    if c.model_type == "roberta":
        tokens, merges = vocab.load_bpe_files(path("vocab.json"), path("merges.txt"))
        added = [(t, tokens[t], t == "<mask>", False) for t in dict.fromkeys([c.cls_token, c.sep_token, c.unk_token, "<pad>", "<mask>"]) if t in tokens]
        return segment.ByteBPE(tokens, merges, added, c.cls_token, c.sep_token, c.unk_token), len(tokens)
    special = {k: v for k, v in (("cls", c.cls_token), ("sep", c.sep_token), ("unk", c.unk_token)) if v}
    tokens = vocab.load_vocab_txt(path("vocab.txt"), tuple(special.get(k, d) for k, d in (("unk", "[UNK]"), ("cls", "[CLS]"), ("sep", "[SEP]"))))
    return segment.WordPiece(tokens, c.do_lower_case, **special), len(tokens)


def tensors(spark: SparkSession, folder: str, pack: str | None = None) -> DataFrame:
    """(name, dtype, shape, values) of a model's safetensors; with `pack`, from a pack of the same files, built on first use."""
    scan = safetensors.read(spark, folder)
    if pack is None:
        return scan
    source = packs.fingerprint(spark, os.path.join(folder, "*.safetensors")).first()["source"]
    return packs.cached_pack(spark, pack, source, lambda: scan)


def load(spark: SparkSession, ref: str, mode: str = nn.FP32, dim: int = 0, pack: str | None = None) -> Embedder:
    """An Embedder of a model folder; everything that doesn't fit together is refused here, before any job.

    pack: where to keep the tensors as a pack (single precision only); dim: Matryoshka width, 0 for all.
    """
    if pack is not None and mode != nn.FP32:
        raise ValueError("a pack can't be combined with int8 modes")
    folder = config.resolve(ref)
    c = config.load(folder)
    spec = spec_of(c)
    own, size = tokenizer_of(folder, c)
    if not config.agrees(size, spec.vocab, c.tokenizer or c.model_type):
        raise ValueError(f"the tokenizer has {size} ids, the model {spec.vocab} embedding rows")
    array = lambda rows: {r["name"]: np.array(r["values"], np.float32).reshape(r["shape"]) for r in rows}
    found = array(tensors(spark, folder, pack).select("name", "shape", "values").toLocalIterator())
    dense = []
    if spec.dense:
        for k in (2, 3):
            one = array(safetensors.read(spark, os.path.join(folder, f"{k}_Dense")).filter(F.col("name") == "linear.weight").toLocalIterator())
            dense += list(one.values())
    return Embedder(spec, c.tokenizer or c.model_type, mode, dim, values_of(spec, found, dense), own=own, name=c.name)

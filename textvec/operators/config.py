"""Model configuration: validated, fail-closed, before any job starts.  Rules as Columns where they are data."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Model types that are supported (fixed values).
SUPPORTED = ("bert", "distilbert", "modernbert", "qwen3", "gemma3_text", "gemma3", "nomic_bert", "roberta", "xlm-roberta", "mpnet")


@dataclass
class Config:
    name: str = ""
    model_type: str = "bert"
    hidden_size: int = 0
    num_hidden_layers: int = 0
    num_attention_heads: int = 0
    intermediate_size: int = 0
    vocab_size: int = 0
    max_position_embeddings: int = 0
    layer_norm_eps: float = 0.0
    do_lower_case: bool = False
    cls_token: str = ""
    sep_token: str = ""
    unk_token: str = ""
    pooling: str = "mean"
    normalize: bool = True
    tokenizer: str = ""
    relative_attention_num_buckets: int = 0
    pad_token_id: int = 0
    global_attn_every_n_layers: int = 0
    local_attention: int = 0
    global_rope_theta: float = 0.0
    local_rope_theta: float = 0.0
    head_dim: int = 0
    num_key_value_heads: int = 0
    rope_theta: float = 0.0
    sliding_window: int = 0
    sliding_window_pattern: int = 0
    query_pre_attn_scalar: int = 0
    dense_hidden: int = 0

    @property
    def position_offset(self) -> int:
        return self.pad_token_id + 1 if self.model_type in ("mpnet", "roberta") else 0

    @property
    def max_seq_len(self) -> int:
        return self.max_position_embeddings - self.position_offset


SCHEMA = T.StructType([T.StructField(f.name, {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}[f.type]) for f in fields(Config)])


@dataclass(frozen=True)
class Rule:
    """What a configuration of some model types (empty: of all) must fulfil, and how it is told."""

    types: tuple[str, ...]
    holds: Callable[[Config], bool]
    message: str


def _positive(*names: str) -> Callable[[Config], bool]:
    return lambda c: all(getattr(c, n) > 0 for n in names)


def _member(name: str, *values) -> Callable[[Config], bool]:
    return lambda c: getattr(c, name) in values


_ROTARY = ("qwen3", "nomic_bert", "gemma3")
RULES = [
    Rule((), _member("model_type", "", "bert", "distilbert", "modernbert", "qwen3", "nomic_bert", "gemma3", "roberta", "mpnet"), "model_type {model_type!r} is not supported"),
    Rule((), _member("tokenizer", "", "sentencepiece", "gemma"), "tokenizer {tokenizer!r} is not supported"),
    Rule((), _member("pooling", "mean", "cls", "lasttoken"), "pooling {pooling!r} is not supported"),
    Rule((), _positive("hidden_size", "num_hidden_layers", "num_attention_heads", "intermediate_size", "vocab_size", "max_position_embeddings"), "architecture fields must be positive"),
    Rule((), lambda c: c.num_attention_heads > 0 and c.hidden_size % c.num_attention_heads == 0, "hidden_size must be divisible by num_attention_heads"),
    Rule(_ROTARY, lambda c: c.head_dim > 0 and c.head_dim % 2 == 0, "head_dim must be even and positive"),
    Rule(("qwen3", "gemma3"), lambda c: c.num_key_value_heads > 0 and c.num_attention_heads % c.num_key_value_heads == 0, "heads must be divisible by key-value heads"),
    Rule(("qwen3", "nomic_bert"), _positive("rope_theta"), "rope_theta must be positive"),
    Rule(("nomic_bert",), lambda c: c.head_dim * c.num_attention_heads == c.hidden_size, "head_dim times heads must be hidden_size"),
    Rule(("modernbert", "gemma3"), _positive("global_rope_theta", "local_rope_theta"), "rope thetas must be positive"),
    Rule(("modernbert",), lambda c: (c.hidden_size // max(1, c.num_attention_heads)) % 2 == 0, "the head dimension must be even"),
    Rule(("modernbert",), lambda c: c.local_attention >= 2 and c.local_attention % 2 == 0, "local_attention must be even and at least 2"),
    Rule(("modernbert",), _positive("global_attn_every_n_layers"), "global_attn_every_n_layers must be at least 1"),
    Rule(("gemma3",), _positive("sliding_window", "sliding_window_pattern"), "sliding_window and its pattern must be positive"),
    Rule(("gemma3",), _positive("query_pre_attn_scalar"), "query_pre_attn_scalar must be positive"),
    Rule(("gemma3",), _positive("dense_hidden"), "dense_hidden must be positive"),
    Rule(("roberta",), _positive("pad_token_id"), "pad_token_id must be at least 1"),
    Rule(("roberta",), _positive("max_seq_len"), "pad_token_id leaves no positions"),
    Rule(("mpnet",), _member("relative_attention_num_buckets", 32), "relative_attention_num_buckets must be 32"),
    Rule(("mpnet",), _member("pad_token_id", 1), "pad_token_id must be 1"),
]


def violated(c: Config) -> list[str]:
    """Every rule that the configuration breaks."""
    return [r.message.format(**vars(c)) for r in RULES if (not r.types or c.model_type in r.types) and not r.holds(c)]


def validated(c: Config) -> Config:
    if bad := violated(c):
        raise ValueError(f"{c.name or 'config'}: {'; '.join(bad)}")
    if c.layer_norm_eps == 0:
        c.layer_norm_eps = 1e-12
    return c


def from_manifest(doc: dict) -> Config:
    known = {f.name for f in fields(Config)}
    return validated(Config(**{k: v for k, v in doc.items() if k in known}))


def is_on(flag) -> bool:
    """A flag's value by its JSON type: a string is on but where it is empty or spells false."""
    if isinstance(flag, str):
        return flag not in ("", "false", "False")
    return isinstance(flag, (bool, int, float)) and flag != 0


_POOLING = {"pooling_mode_mean_tokens": "mean", "pooling_mode_cls_token": "cls", "pooling_mode_lasttoken": "lasttoken"}


def pooling_mode(doc: dict) -> str:
    """The one pooling mode that is on; any other pooling_mode_* key that is on is refused."""
    on = [k for k, v in doc.items() if k.startswith("pooling_mode_") and is_on(v)]
    if len(on) != 1 or on[0] not in _POOLING:
        raise ValueError(f"pooling {sorted(on)} is not exactly one of mean, cls, lasttoken")
    return _POOLING[on[0]]


# What a checkpoint's config.json may say, by model type: fields that must be given, that must be off or
# absent, that must not be given at all, and those with values that may be given (None: absent).
_GELU = {"hidden_act": (None, "", "gelu")}
NEEDED = {"distilbert": ("dim", "n_layers", "n_heads", "hidden_dim"), "roberta": ("pad_token_id",), "xlm-roberta": ("pad_token_id",), "mpnet": ("pad_token_id", "relative_attention_num_buckets")}
OFF = {
    "distilbert": ("sinusoidal_pos_embds",), "modernbert": ("norm_bias", "attention_bias", "mlp_bias"), "qwen3": ("attention_bias", "use_sliding_window", "sliding_window"),
    "gemma3": ("attention_bias", "attn_logit_softcapping", "final_logit_softcapping"),
    "nomic_bert": ("prenorm", "causal", "use_rms_norm", "rotary_emb_interleaved", "qkv_proj_bias", "mlp_fc1_bias", "mlp_fc2_bias"),
}
ABSENT = {"qwen3": ("rope_scaling",), "gemma3": ("rope_scaling",), "nomic_bert": ("rotary_scaling_factor",)}
VALUES = {
    "bert": _GELU, "roberta": _GELU, "xlm-roberta": _GELU, "mpnet": _GELU, "distilbert": {"activation": (None, "", "gelu")}, "modernbert": _GELU | {"hidden_activation": (None, "", "gelu")},
    "qwen3": {"hidden_act": (None, "", "silu")}, "gemma3": _GELU | {"hidden_activation": (None, "", "gelu_pytorch_tanh"), "use_bidirectional_attention": (True,)},
    "nomic_bert": {"rotary_emb_fraction": (None, 1), "activation_function": (None, "", "swiglu"), "hidden_act": (None, "", "silu")},
}
#: The names under which a model type gives its sizes, where it has its own.
SIZES = {"distilbert": {"hidden_size": "dim", "num_hidden_layers": "n_layers", "num_attention_heads": "n_heads", "intermediate_size": "hidden_dim"}}


def refusals(kind: str, hf: dict) -> list[str]:
    """Everything in a checkpoint's config.json that would change results or isn't there."""
    if kind not in SUPPORTED:
        return [f"model_type {kind!r} is not supported"]
    given = lambda k: hf.get(k) not in (None, False, 0)
    values = VALUES.get(kind, {}) | {"position_embedding_type": (None, "", "absolute")}
    out = [f"{kind} needs {k}" for k in NEEDED.get(kind, ()) if hf.get(k) is None]
    out += [f"{k} is not supported in {kind}" for k in OFF.get(kind, ()) if given(k)]
    out += [f"{k} is not supported in {kind}" for k in ABSENT.get(kind, ()) if hf.get(k) is not None]
    return out + [f"{k} {hf.get(k)!r} is not supported in {kind}" for k, allowed in values.items() if hf.get(k) not in allowed]


def _refuse(bad: bool, message: str) -> None:
    if bad:
        raise ValueError(message)


def derive(config: dict, tokenizer: dict, pooling: dict, modules: list[dict], dense: dict | None = None, has_sentencepiece: bool = False, name: str = "") -> Config:
    """A Config from a checkpoint's own JSON files; every knob that would change results is refused, not ignored."""
    kind = config.get("model_type", "")
    kind = "gemma3" if kind == "gemma3_text" else kind
    if bad := refusals(kind, config):
        raise ValueError(f"{name or 'config'}: {'; '.join(bad)}")
    hf = config | {ours: config[theirs] for ours, theirs in SIZES.get(kind, {}).items()}
    mode = pooling_mode(pooling)
    pieces = kind == "xlm-roberta" or kind == "bert" and ((tokenizer.get("tokenizer_class") or "").startswith("XLMRobertaTokenizer") or has_sentencepiece)
    lower = tokenizer.get("do_lower_case")
    if pieces:
        lower = False
    elif kind in ("roberta", "modernbert", "qwen3", "gemma3"):
        _refuse(bool(lower), f"do_lower_case on a {kind} model")
        lower = False
    else:
        _refuse(lower is None, "do_lower_case is not set")
    normalize = False
    for m in modules:
        own = m.get("type", "")
        normalize |= own.endswith("models.Normalize")
        known = own.endswith(("models.Normalize", "models.Transformer", "models.Pooling")) or own.endswith("models.Dense") and kind == "gemma3"
        _refuse(not known, f"module {own!r} is not supported")
    said = lambda v: v if isinstance(v, str) else (v or {}).get("content", "")
    c = Config(name, kind, *(int(hf.get(k) or 0) for k in ("hidden_size", "num_hidden_layers", "num_attention_heads", "intermediate_size", "vocab_size", "max_position_embeddings")))
    c.do_lower_case, c.pooling, c.normalize = bool(lower), mode, normalize
    c.cls_token, c.sep_token, c.unk_token = (said(tokenizer.get(k)) for k in ("cls_token", "sep_token", "unk_token"))
    if kind != "distilbert":
        c.layer_norm_eps = float(hf.get("layer_norm_eps") or 0)
    c.tokenizer = "sentencepiece" if pieces else ""
    if kind in ("mpnet", "roberta", "xlm-roberta"):
        c.pad_token_id = int(hf["pad_token_id"])
        c.relative_attention_num_buckets = int(hf.get("relative_attention_num_buckets") or 0) if kind == "mpnet" else 0
        c.model_type = "mpnet" if kind == "mpnet" else "roberta"
    elif kind == "modernbert":
        c.layer_norm_eps = float(hf.get("norm_eps") or c.layer_norm_eps)
        for k in ("global_attn_every_n_layers", "local_attention", "global_rope_theta", "local_rope_theta"):
            setattr(c, k, hf.get(k) or 0)
    elif kind in ("qwen3", "gemma3"):
        c.layer_norm_eps = float(hf.get("rms_norm_eps") or c.layer_norm_eps)
        c.head_dim, c.num_key_value_heads = int(hf.get("head_dim") or 0), int(hf.get("num_key_value_heads") or 0)
        if kind == "qwen3":
            c.rope_theta, c.cls_token, c.sep_token = float(hf.get("rope_theta") or 0), "", "<|endoftext|>"
        else:
            c.global_rope_theta, c.local_rope_theta = float(hf.get("rope_theta") or 0), float(hf.get("rope_local_base_freq") or 0)
            c.sliding_window = int(hf["sliding_window"]) // 2 + 1 if hf.get("sliding_window") is not None else 0
            c.sliding_window_pattern, c.query_pre_attn_scalar = int(hf.get("_sliding_window_pattern") or 0), int(hf.get("query_pre_attn_scalar") or 0)
            c.tokenizer, c.cls_token, c.sep_token = "gemma", "<bos>", "<eos>"
            c.dense_hidden = int((dense or {}).get("out_features") or 0)
    elif kind == "nomic_bert":
        c.head_dim = int(hf.get("head_dim") or 0)
        c.rope_theta = float((hf.get("rope_parameters") or {}).get("rope_theta") or hf.get("rotary_emb_base") or 0)
    return validated(c)


def load(folder: str) -> Config:
    """manifest.json if there is one, else derived from the checkpoint's files."""
    def read(*name: str, default=None):
        path = os.path.join(folder, *name)
        if default is not None and not os.path.exists(path):
            return default
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    if os.path.exists(os.path.join(folder, "manifest.json")):
        return from_manifest(read("manifest.json"))
    return derive(read("config.json"), read("tokenizer_config.json"), read("1_Pooling", "config.json"), read("modules.json"), read("2_Dense", "config.json", default={}), os.path.isfile(os.path.join(folder, "sentencepiece.bpe.model")), os.path.basename(folder.rstrip("/")))


def resolve(ref: str, cache: str | None = None) -> str:
    """The local folder of a reference: a folder, or a model id (org/name, or hf:org/name) that the cache holds.

    An org/name whose first part is a local folder is a missing local path, not a model id; with hf:
    it always is one.  There is no network source, so an id that the cache lacks is an error.
    """
    name = ref.removeprefix("hf:")
    if not ref.startswith("hf:"):
        if os.path.isdir(ref):
            return ref
        if os.path.exists(ref):
            raise NotADirectoryError(f"{ref} is no folder")
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*/[A-Za-z0-9._-]+", name) or ".." in name:
        raise ValueError(f"{ref!r} is neither a model folder nor a model id (org/name)")
    if not ref.startswith("hf:") and os.path.isdir(os.path.dirname(name)):
        raise FileNotFoundError(f"{name} doesn't exist, but {os.path.dirname(name)} does: taken for a local path; 'hf:{name}' means the model id")
    folder = os.path.join(cache, name.replace("/", "--")) if cache else ""
    if folder and os.path.isdir(folder):
        return folder
    raise FileNotFoundError(f"{name} isn't in the cache, and models aren't fetched; give a local folder")


def agrees(vocab: int, rows: int, kind: str) -> bool:
    """Whether a tokenizer and an embedding table can belong together: rows beyond the vocabulary are padding."""
    most = {"sentencepiece": 64, "gemma": 128, "modernbert": 128, "qwen3": 128, "nomic_bert": 128}.get(kind, 0)
    return 0 <= rows - vocab <= most


# Rules over columns of configurations or names.


def model_id_ok(ref: Column) -> Column:
    return ref.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]*/[A-Za-z0-9._-]+\z") & ~ref.contains("..")


def shard_name_ok(name: Column) -> Column:
    return ~name.isin("", ".", "..") & ~name.rlike(r"[/\\]")


def max_seq_len(model_type: Column, max_positions: Column, pad: Column) -> Column:
    return max_positions - F.when(model_type.isin("mpnet", "roberta"), pad + 1).otherwise(0)


def tokenizer_files(model_type: Column, tokenizer_class: Column) -> Column:
    """The files that a model's tokenizer needs, comma-joined, and '?' where a sentencepiece file is looked for first."""
    return (
        F.when((model_type == "xlm-roberta") | tokenizer_class.startswith("XLMRobertaTokenizer"), "sentencepiece.bpe.model")
        .when(model_type == "roberta", "vocab.json,merges.txt?")
        .when(model_type.isin("modernbert", "qwen3", "gemma3_text", "gemma3"), "tokenizer.json")
        .when(model_type == "nomic_bert", "vocab.txt")
        .otherwise("vocab.txt?")
    )


def pooling_of(doc: Column) -> Column:
    """pooling_mode over a JSON column: the mode, or null where it is refused.

    A flag is on by its JSON type: true, a number but 0, a string but "", "false" and "False"; so the string "0" is on.
    """
    flags = F.try_variant_get(F.try_parse_json(doc), "$", "map<string,variant>")
    kind = F.schema_of_variant
    text, number = (lambda v, t=t: F.try_variant_get(v, "$", t) for t in ("string", "double"))
    on = F.map_filter(flags, lambda k, v: k.startswith("pooling_mode_") & F.coalesce(F.when(kind(v) == "STRING", ~text(v).isin("", "false", "False")).when(kind(v).isin("BOOLEAN", "BIGINT", "DOUBLE") | kind(v).startswith("DECIMAL"), F.coalesce(number(v), F.try_variant_get(v, "$", "boolean").cast("double")) != 0), F.lit(False)))
    key = F.map_keys(on)[0]
    modes = F.create_map(*(F.lit(x) for kv in _POOLING.items() for x in kv))
    return F.when(F.size(on) == 1, F.element_at(modes, key))

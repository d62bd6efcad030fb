"""What a model folder must hold, in the order to get it in, and where caches and tokens are: rules only, no network."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Mapping

from ..operators.config import SUPPORTED

CACHE = "TEXTVEC_CACHE"


def cache_dir(env: Mapping[str, str]) -> str:
    """The cache's root: the variable's folder, else one in the user's cache folder."""
    if own := env.get(CACHE):
        return own
    base = env.get("XDG_CACHE_HOME") or (os.path.join(env["HOME"], ".cache") if env.get("HOME") else "")
    if not base:
        raise ValueError(f"no cache folder: set {CACHE}")
    return os.path.join(base, "textvec")


def model_dir(model_id: str, cache: str) -> str:
    return os.path.join(cache, model_id.replace("/", "--"))


def token(env: Mapping[str, str], read: Callable[[str], str | None]) -> str:
    """An access token: of two variables, then of two files; read() gives a file's text, or None. Empty: anonymous."""
    for name in ("HF_TOKEN", "HUGGING_FACE_HUB_TOKEN"):
        if own := env.get(name, "").strip():
            return own
    homes = [os.path.join(env["HF_HOME"], "token")] if env.get("HF_HOME") else []
    homes += [os.path.join(env["HOME"], ".cache", "huggingface", "token")] if env.get("HOME") else []
    return next((own for p in homes if (own := (read(p) or "").strip())), "")


def files(model_type: str, tokenizer_class: str, shards: list[str] | None = None, has_sentencepiece: bool = False) -> list[str]:
    """The files of a model in the order to get them: what decides first, what is large last."""
    if model_type not in SUPPORTED:
        raise ValueError(f"model_type {model_type!r} is not supported")
    if model_type == "xlm-roberta" or tokenizer_class.startswith("XLMRobertaTokenizer") or has_sentencepiece:
        words = ["sentencepiece.bpe.model"]
    elif model_type == "roberta":
        words = ["vocab.json", "merges.txt"]
    elif model_type in ("modernbert", "qwen3", "gemma3_text", "gemma3"):
        words = ["tokenizer.json"]
    else:
        words = ["vocab.txt"]
    head = [f"{k}_Dense/{name}" for k in (2, 3) for name in ("config.json", "model.safetensors")] if model_type.startswith("gemma3") else []
    weights = ["model.safetensors"] if shards is None else ["model.safetensors.index.json", *sorted(set(shards))]
    return ["config.json", "tokenizer_config.json", *words, "modules.json", "1_Pooling/config.json", *head, *weights]


def checksum_ok(data: bytes, etag: str) -> bool:
    """Whether data is what an entity tag names: SHA-256, or git's blob SHA-1; other tags name nothing."""
    tag = etag.strip().removeprefix("W/").strip('"').lower()
    if re.fullmatch("[0-9a-f]{64}", tag):
        return hashlib.sha256(data).hexdigest() == tag
    if re.fullmatch("[0-9a-f]{40}", tag):
        return hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest() == tag
    return True

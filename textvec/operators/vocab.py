"""Vocabularies: constant synthetic ones, and loaders for the file formats of public tokenizers."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field

SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
#: Frequent letter groups of European languages.
GROUPS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur the and ing ion ent ver der sch que des les est los del".split()
#: Added tokens: content, lstrip, rstrip.
ADDED = [("<mask>", True, False), ("<s>", False, False), ("</s>", False, True)]


def wordpiece_vocab() -> list[str]:
    """Specials, letters, digits and ASCII punctuation, then continuations and groups; id is the place."""
    letters, digits = [chr(c) for c in range(97, 123)], [str(d) for d in range(10)]
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    return [*SPECIALS, *letters, *digits, *marks, *("##" + x for x in letters + digits), *GROUPS, *("##" + g for g in GROUPS)]


def bpe_merges() -> list[tuple[str, str]]:
    """Ranked merges over printable bytes: pairs before the triples made of them."""
    out: dict[tuple[str, str], None] = {}
    for g in GROUPS:
        out.setdefault((g[0], g[1]))
    for g in GROUPS:
        if len(g) == 3:
            out.setdefault((g[:2], g[2]))
    for g in GROUPS:
        if len(g) == 2:
            out.setdefault(("Ġ", g))
    return list(out)


def bpe_vocab() -> dict[str, int]:
    from ..functions.text import byte_table

    tokens = ["<s>", "<pad>", "</s>", "<unk>", *byte_table()]
    tokens += [a + b for a, b in bpe_merges() if a + b not in tokens]
    return {t: k for k, t in enumerate(dict.fromkeys([*tokens, "<mask>"]))}


def gemma_vocab() -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Byte tokens, letters and the mark, with merges of whole strings."""
    chars = ["▁", *(chr(c) for c in range(33, 127)), *"äöüßéèêçñáíóúà", "\n"]
    merges = [(a, b) for a, b in bpe_merges() if a != "Ġ"] + [("▁", g) for g in GROUPS if len(g) == 2]
    tokens = ["<pad>", "<eos>", "<bos>", "<unk>", *(f"<0x{b:02X}>" for b in range(256)), *chars, *(a + b for a, b in merges)]
    return {t: k for k, t in enumerate(dict.fromkeys(tokens))}, merges


def unigram_pieces() -> list[tuple[str, float, int]]:
    """(piece, score, kind) with distinct scores; kinds: 1 normal, 2 unknown, 3 control."""
    texts = list(dict.fromkeys(["▁", *GROUPS, *("▁" + g for g in GROUPS), *(chr(c) for c in range(33, 127)), *"äöüßéèêçñáíóúà"]))
    return [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((t, -2.0 - 0.37 * (k % 41) - 0.011 * k + 0.9 * (len(t) - 1), 1) for k, t in enumerate(texts))]


# Loaders.


def load_vocab_txt(path: str, required: tuple[str, ...] = ("[UNK]", "[CLS]", "[SEP]")) -> dict[str, int]:
    """Token to line number; of repeated lines the last counts; missing specials are an error."""
    with open(path, encoding="utf-8") as f:
        vocab = {line.rstrip("\r\n"): k for k, line in enumerate(f)}
    if missing := [t for t in required if t not in vocab]:
        raise ValueError(f"{path}: no {', '.join(missing)}")
    return vocab


def load_bpe_files(vocab_path: str, merges_path: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    with open(vocab_path, encoding="utf-8") as f:
        vocab = json.load(f)
    merges = []
    with open(merges_path, encoding="utf-8") as f:
        for n, line in enumerate(f):
            line = line.rstrip("\r\n")
            if not line or n == 0 and line.startswith("#version"):
                continue
            parts = line.split(" ")
            if len(parts) != 2:
                raise ValueError(f"{merges_path}:{n + 1}: not a pair")
            merges.append((parts[0], parts[1]))
    return vocab, merges


@dataclass
class TokenizerJson:
    vocab: dict[str, int]
    merges: list[tuple[str, str]]
    added: list[tuple[str, int, bool, bool]] = field(default_factory=list)
    nfc: bool = False
    byte_fallback: bool = False


def parse_tokenizer_json(doc: dict, need_bytes: bool = False) -> TokenizerJson:
    model = doc.get("model") or {}
    if model.get("type", "BPE") != "BPE":
        raise ValueError(f"model type {model.get('type')!r} is not BPE")
    merges = []
    for m in model.get("merges", []):
        parts = m.split(" ") if isinstance(m, str) else list(m)
        if len(parts) != 2:
            raise ValueError(f"merge {m!r} is not a pair")
        merges.append((parts[0], parts[1]))
    vocab = dict(model.get("vocab") or {})
    added = [(a["content"], int(a["id"]), bool(a.get("lstrip")), bool(a.get("rstrip"))) for a in doc.get("added_tokens", [])]
    for content, number, _, _ in added:
        vocab.setdefault(content, number)
    norm = doc.get("normalizer") or {}
    kinds = [norm.get("type"), *(n.get("type") for n in norm.get("normalizers", []))]
    out = TokenizerJson(vocab, merges, added, "NFC" in kinds, bool(model.get("byte_fallback")))
    if need_bytes:
        if not out.byte_fallback:
            raise ValueError("byte_fallback is required")
        if missing := [b for b in range(256) if f"<0x{b:02X}>" not in vocab]:
            raise ValueError(f"no byte token for {missing[0]:#04x}")
    return out


def load_tokenizer_json(path: str, need_bytes: bool = False) -> TokenizerJson:
    with open(path, encoding="utf-8") as f:
        return parse_tokenizer_json(json.load(f), need_bytes)


def _fields(data: bytes):
    """(number, wire type, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            if at >= len(data) or shift > 63:
                raise ValueError("truncated or overlong varint")
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if not b & 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            value: int | bytes = varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        if isinstance(value, bytes) and at > len(data):
            raise ValueError("truncated field")
        yield number, kind, value


@dataclass
class SentencePieceModel:
    pieces: list[tuple[str, float, int]]
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def parse_sentencepiece(data: bytes) -> SentencePieceModel:
    """The pieces and the normaliser of a SentencePiece model file (proto2; absent flags are true)."""
    out = SentencePieceModel([])
    for number, _, value in _fields(data):
        if number == 1:
            text, score, kind = "", 0.0, 1
            for n, _, v in _fields(value):
                if n == 1:
                    text = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out.pieces.append((text, score, kind))
        elif number == 3:
            for n, _, v in _fields(value):
                if n == 2:
                    out.charsmap = v
                elif n == 3:
                    out.add_dummy_prefix = bool(v)
                elif n == 4:
                    out.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    out.escape_whitespaces = bool(v)
    return out


def decode_charsmap(blob: bytes) -> dict[bytes, bytes]:
    """Prefix rules of a compiled character map: a double-array trie and NUL-terminated replacements."""
    if not blob:
        return {}
    if len(blob) < 4 or (size := struct.unpack_from("<I", blob)[0]) % 4 or size > len(blob) - 4:
        raise ValueError("bad character map")
    units, texts = struct.unpack_from(f"<{size // 4}I", blob, 4), blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    out, todo = {}, [(b"", offset(units[0]))] if units else []
    while todo:
        prefix, base = todo.pop()
        for c in range(1, 256):
            at = base ^ c
            if at < len(units) and units[at] & 0x800000FF == c:
                node = at ^ offset(units[at])
                if units[at] >> 8 & 1 and node < len(units):
                    start = units[node] & 0x7FFFFFFF
                    out[prefix + bytes([c])] = texts[start : texts.index(b"\0", start)]
                todo.append((prefix + bytes([c]), node))
    return out

"""Segmentation: hand cases, and merges and best segmentations against plain definitions."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textvec.operators import segment, vocab
from textvec.operators.pipeline import tokenizer


def wp(words, **more):
    own = {w: k for k, w in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *words])}
    return segment.WordPiece(own, **more)


def test_wordpiece_cases():
    t = wp(["over", "##take", "##n", "lamp", "sea"])
    assert t.encode("sea lamp overtaken", 64) == [2, 8, 7, 4, 5, 6, 3]
    assert t.encode("z" * 300, 64) == t.encode("lampz", 64) == [2, 1, 3]
    assert t.encode("sea" * 33, 64)[1:-1] == [1] and wp(["s" * 100]).encode("s" * 100, 9) == [2, 4, 3]
    assert t.encode(" \n", 64) == t.encode("", 64) == [2, 3]
    assert t.encode("lamp sea lamp sea", 4) == [2, 7, 8, 3]
    assert t.encode("lamp", 0) == t.encode("lamp", 1) == [2, 3]


def test_wordpiece_accents_and_scripts():
    t = wp(["uber", "grun", "雪", "山", "£7", "£", "7"])
    assert t.encode("ÜBER grün", 9) == t.encode("U\u0308ber gru\u0308n", 9) == [2, 4, 5, 3]
    assert t.encode("山雪川7", 9) == [2, 7, 6, 1, 10, 3]
    assert t.encode("£7, £ 7", 9) == [2, 8, 1, 9, 10, 3]
    assert wp(["über"], lower=False).encode("über", 9) == [2, 4, 3]


@pytest.mark.parametrize("text", ["ca\x0bfe", "ca\x0cfe", "ca­fe", "ca​fe", "ca﻿fe", "cafe", "caf�e"])
def test_wordpiece_drops_controls(text):
    assert wp(["cafe"]).encode(text, 9) == [2, 4, 3]


def test_wordpiece_missing_special():
    with pytest.raises(ValueError):
        segment.WordPiece({"a": 0})


def rounds(symbols, ranks):
    parts = list(symbols)
    while True:
        found = [(ranks[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
        if not found:
            return parts
        _, k = min(found)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="thenrasiodg", max_size=90))
def test_merges_equal_rounds(word):
    own = segment.Merges(vocab.bpe_merges())
    want = rounds(word, own.ranks)
    assert own(list(word)) == own._long(list(word)) == want
    assert [p for part in own.cut(list(word)) for p in own(part)] == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab", max_size=40), st.permutations(["a b", "a a", "ab a", "aa a", "b a", "ab ab", "aa aa", "ba b", "aaa b", "b b"]))
def test_merges_of_any_order(word, merges):
    """Also where a merge makes a pair of lower rank than its own, and where places overlap."""
    own = segment.Merges([tuple(m.split()) for m in merges])
    want = rounds(word, own.ranks)
    assert own._short(list(word)) == want and (not word or own._long(list(word)) == want)


def test_long_word_is_fast():
    own = segment.Merges(vocab.bpe_merges())
    word = "".join(random.Random(1).choice("thenras") for _ in range(50_000))
    start = time.time()
    own(list(word))
    assert time.time() - start < 2


def test_framing():
    for kind, ends in (("bpe", (0, 2)), ("gemma", (2, 1)), ("sentencepiece", (0, 2))):
        own, _ = tokenizer(kind)
        for n in (2, 3, 8, 100):
            ids = own.encode("hello there, world", n)
            assert len(ids) <= n and (ids[0], ids[-1]) == ends
    ids = tokenizer("qwen")[0].encode("hello", 9)
    assert ids[-1] == 2 and ids[0] != 0


def test_added_tokens_absorb_space():
    own, _ = tokenizer("bpe")
    assert own.encode("a <mask> b", 99).count(own.vocab["<mask>"]) == 1
    assert own.encode("a  <mask>", 99) == own.encode("a<mask>", 99)


def test_unigram():
    own = segment.Unigram([("<unk>", 0, 2), ("▁a", -1, 1), ("b", -2, 1), ("▁ab", -2.5, 1)])
    assert [t for t, _ in own.segments(own.normalize(" ab  a "))] == ["▁ab", "▁a"]
    assert own.segments("xyz") == [("xyz", own.unk)]
    assert own.normalize("   ") == "" and own.encode("", 8) == [0, 2]
    assert [segment.Unigram.outer_id(k) for k in (0, 1, 2, 3)] == [3, 0, 2, 4]
    with pytest.raises(ValueError):
        segment.Unigram([("a", 0, 4)])


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab▁x", max_size=9), st.booleans())
def test_unigram_is_the_best_segmentation(text, inner):
    """Against all segmentations; pieces with a mark inside, too."""
    pieces = [("<unk>", 0, 2), ("a", -1.1, 1), ("b", -1.7, 1), ("▁", -0.9, 1), ("ab", -2.9, 1), ("▁ab", -3.05, 1), ("bab", -3.3, 1), ("aa", -1.95, 1)]
    own = segment.Unigram(pieces + ([("a▁b", -1.3, 1)] if inner else []))
    scores = {t: s for t, s, k in pieces + [("a▁b", -1.3, 1)] * inner if k == 1}

    def best(s):
        if not s:
            return 0.0
        every = [best(s[:-n]) + scores[s[-n:]] for n in range(1, len(s) + 1) if s[-n:] in scores]
        return max(every + ([best(s[:-1]) + own.unk_score] if s[-1] not in scores else []))

    got = own.segments(text)
    assert "".join(t for t, _ in got) == text
    assert abs(sum(scores[t] if k != own.unk else len(t) * own.unk_score for t, k in got) - best(text)) < 1e-9


def test_byte_fallback():
    own, _ = tokenizer("gemma")
    assert own.pieces("☃") == ["<0xE2>", "<0x98>", "<0x83>"]


def test_tokenizer_json():
    doc = {"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b", ["ab", "a"]]}, "added_tokens": [{"content": "<x>", "id": 9}], "normalizer": {"type": "NFC"}}
    got = vocab.parse_tokenizer_json(doc)
    assert got.merges == [("a", "b"), ("ab", "a")] and got.vocab["<x>"] == 9 and got.nfc
    with pytest.raises(ValueError):
        vocab.parse_tokenizer_json(doc, need_bytes=True)
    with pytest.raises(ValueError):
        vocab.parse_tokenizer_json({"model": {"merges": ["a b c"]}})


def test_sentencepiece_file():
    piece = b"\x0a\x02ab\x15" + b"\x00\x00\x80\xbf" + b"\x18\x01"
    got = vocab.parse_sentencepiece(b"\x0a" + bytes([len(piece)]) + piece + b"\x1a\x02\x18\x00")
    assert got.pieces == [("ab", -1.0, 1)] and not got.add_dummy_prefix and got.escape_whitespaces
    with pytest.raises(ValueError):
        vocab.parse_sentencepiece(b"\x0a\x7f")


def charsmap(rules):
    """A compiled character map: a double array over the rules' bytes, and their replacements."""
    trie: dict = {}
    for key in rules:
        node = trie
        for b in key:
            node = node.setdefault(b, {})
        node[0] = key
    texts, at = b"", {}
    for key, value in rules.items():
        at[key] = len(texts)
        texts += value + b"\0"
    units, taken = [0] * 4096, {0}

    def place(index, node):
        # an offset whose places for all children are free; below 2^21, so that it needs no extension bit
        offset = next(o for o in range(1, 4096) if all((index ^ o ^ c) < 4096 and (index ^ o ^ c) not in taken for c in node) and (index ^ o) < 4096)
        units[index] |= offset << 10 | (0x100 if 0 in node else 0)
        base = index ^ offset
        taken.update(base ^ c for c in node)
        for c, child in node.items():
            if c == 0:
                units[base] = 1 << 31 | at[child]
            else:
                units[base ^ c] |= c
                place(base ^ c, child)

    place(0, trie)
    blob = b"".join(u.to_bytes(4, "little") for u in units)
    return len(blob).to_bytes(4, "little") + blob + texts


def test_charsmap():
    """Longest rules win, unknown characters stay, and a model file's map drives its normaliser."""
    rules = {"A".encode(): b"a", "ﬁ".encode(): b"fi", "①".encode(): b"1", "①②".encode(): b"12", "　".encode(): b" "}
    got = vocab.decode_charsmap(charsmap(rules))
    assert got == rules and vocab.decode_charsmap(b"") == {}
    own = segment.Unigram([("<unk>", 0, 2), ("▁a", -1, 1), ("fi", -2, 1)], got)
    assert own.normalize("Aﬁ①②①　　é") == "▁afi121▁é"
    with pytest.raises(ValueError):
        vocab.decode_charsmap(b"\x05\0\0\0")


def test_word_dispatch_and_sizes():
    for kind, size in (("wordpiece", len(vocab.wordpiece_vocab())), ("bpe", len(vocab.bpe_vocab())), ("qwen", len(vocab.bpe_vocab())), ("gemma", len(vocab.gemma_vocab()[0])), ("sentencepiece", len(vocab.unigram_pieces()) + 2)):
        assert tokenizer(kind)[1] == size
    with pytest.raises(ValueError):
        tokenizer("words")


def test_vocabulary_files(tmp_path):
    (tmp_path / "vocab.txt").write_text("[UNK]\r\n[CLS]\n[SEP]\none\none\n")
    assert vocab.load_vocab_txt(str(tmp_path / "vocab.txt"))["one"] == 4
    (tmp_path / "short.txt").write_text("[UNK]\n")
    with pytest.raises(ValueError, match="CLS"):
        vocab.load_vocab_txt(str(tmp_path / "short.txt"))
    (tmp_path / "vocab.json").write_text('{"a": 0, "b": 1, "ab": 2}')
    (tmp_path / "merges.txt").write_text("#version: 0.2\na b\n\n# b\n")
    assert vocab.load_bpe_files(str(tmp_path / "vocab.json"), str(tmp_path / "merges.txt")) == ({"a": 0, "b": 1, "ab": 2}, [("a", "b"), ("#", "b")])
    (tmp_path / "bad.txt").write_text("a b c\n")
    with pytest.raises(ValueError, match="not a pair"):
        vocab.load_bpe_files(str(tmp_path / "vocab.json"), str(tmp_path / "bad.txt"))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aé é \tＡ界​­-_,.“”\x0b Ñß", max_size=30), st.booleans())
def test_basic_words_by_definition(text, lower):
    """One character after another, as the tokenizer is defined, against the table of translations."""
    import unicodedata

    own = segment.WordPiece({"[UNK]": 0, "[CLS]": 1, "[SEP]": 2}, lower=lower)
    said = unicodedata.normalize("NFD", text.lower()) if lower else text
    out = ""
    for c in said:
        kind = unicodedata.category(c)
        if c in "\t\n\r" or kind.startswith("Z"):
            out += " "
        elif kind in ("Cc", "Cf", "Co", "Cs") or c == "�" or lower and kind == "Mn":
            continue
        elif kind.startswith("P") or c in "$+<=>^`|~" or 0x4E00 <= ord(c) <= 0x9FFF:
            out += f" {c} "
        else:
            out += c
    assert own.words(text) == out.split()

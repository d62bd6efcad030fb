"""Sub-word segmentation cores: plain Python without Spark.

Texts are cut where no segment can cross, and each distinct piece is segmented once per worker.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import regex

from ..functions import text as patterns


#: Distinct words that a worker remembers before it starts anew.
KEPT = 200_000


def remembered(kept: dict, key: str, make: Callable[[str], list]) -> list:
    """What make(key) gives, made once."""
    out = kept.get(key)
    if out is None:
        if len(kept) >= KEPT:
            kept.clear()
        out = kept[key] = make(key)
    return out


class _Basic(dict):
    """For str.translate: what each character becomes before a text is split at white space."""

    alone = regex.compile("[" + patterns.PUNCT + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), patterns.CJK) + "]")

    def __init__(self, marks: bool):
        self.marks = marks

    def __missing__(self, point: int) -> str:
        c = chr(point)
        kind = unicodedata.category(c)
        if c in "\t\n\r" or kind[0] == "Z":
            out = " "
        elif c == "\ufffd" or kind in ("Cc", "Cf", "Co", "Cs") or (kind == "Mn" and not self.marks):
            out = ""
        else:
            out = f" {c} " if self.alone.match(c) else c
        self[point] = out
        return out


class WordPiece:
    """Greedy longest prefix; a word that doesn't split wholly, or is over `longest` characters, is unknown."""

    def __init__(self, vocab: dict[str, int], lower: bool = True, cls: str = "[CLS]", sep: str = "[SEP]", unk: str = "[UNK]", longest: int = 100):
        if missing := [t for t in (cls, sep, unk) if t not in vocab]:
            raise ValueError(f"vocabulary lacks {', '.join(missing)}")
        self.vocab, self.lower, self.longest = vocab, lower, longest
        self.cls, self.sep, self.unk = vocab[cls], vocab[sep], vocab[unk]
        self.most = max(map(len, vocab))
        self.basic = _Basic(marks=not lower)
        self._kept: dict[str, list[int]] = {}

    def words(self, text: str) -> list[str]:
        if self.lower:
            text = text.lower()
            if not text.isascii():
                text = unicodedata.normalize("NFD", text)
        return text.translate(self.basic).split()

    def word(self, word: str) -> list[int]:
        return remembered(self._kept, word, self._split)

    def _split(self, word: str) -> list[int]:
        if len(word) > self.longest:
            return [self.unk]
        out: list[int] = []
        rest, mark = word, ""
        while rest:
            n = next((n for n in range(min(len(rest), self.most), 0, -1) if mark + rest[:n] in self.vocab), 0)
            if not n:
                return [self.unk]
            out.append(self.vocab[mark + rest[:n]])
            rest, mark = rest[n:], "##"
        return out

    def encode(self, text: str, max_len: int) -> list[int]:
        """Framed ids; the last token always survives truncation, and 2 is the shortest."""
        max_len = max(2, max_len)
        out = [self.cls]
        for w in self.words(text):
            out += self.word(w)
            if len(out) >= max_len:
                break
        return [*out[: max_len - 1], self.sep]


class Merges:
    """A ranked merge table, applied to sequences of symbols: least rank first, leftmost first."""

    #: Symbols up to which a sequence is looked through anew after each merge.
    SHORT = 64

    def __init__(self, merges: list[tuple[str, str]]):
        self.ranks: dict[tuple[str, str], int] = {}
        for k, m in enumerate(merges):
            self.ranks.setdefault(m, k)
        #: Characters that some merge joins; between others no merge ever reaches.
        self.joints = {(a[-1], b[0]) for a, b in self.ranks}

    def __call__(self, symbols: list[str]) -> list[str]:
        return self._short(list(symbols)) if len(symbols) <= self.SHORT else self._long(symbols)

    def cut(self, symbols: list[str]) -> list[list[str]]:
        """The sequence in parts that merge each on its own."""
        ends = [k + 1 for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (a[-1], b[0]) not in self.joints]
        return [symbols[a:b] for a, b in zip([0, *ends], [*ends, len(symbols)], strict=True)]

    def _short(self, parts: list[str]) -> list[str]:
        none = len(self.ranks)
        while len(parts) > 1:
            found = [self.ranks.get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
            if (least := min(found)) == none:
                break
            k = found.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _long(self, symbols: list[str]) -> list[str]:
        """Rank by rank over arrays: all places of the least rank at once, as far as none of them makes a pair of lower rank."""
        names = list(dict.fromkeys(symbols))
        number = {x: k for k, x in enumerate(names)}
        ids = np.array([number[x] for x in symbols], dtype=np.int64)
        none = len(self.ranks)
        known: dict[tuple[int, int], int] = {}

        def ranked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            pairs, at = np.unique(left << 32 | right, return_inverse=True)
            own = []
            for pair in pairs.tolist():
                key = (pair >> 32, pair & 0xFFFFFFFF)
                if key not in known:
                    known[key] = self.ranks.get((names[key[0]], names[key[1]]), none)
                own.append(known[key])
            return np.array(own, dtype=np.int64)[at]

        rank = ranked(ids[:-1], ids[1:])
        while len(ids) > 1 and (least := int(rank.min())) < none:
            at = np.flatnonzero(rank == least)
            # of places that overlap (a run of one symbol) every other one, from the left
            run = np.cumsum(np.append(True, np.diff(at) > 1))
            at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
            joined = names[ids[at[0]]] + names[ids[at[0] + 1]]
            if joined not in number:
                number[joined] = len(names)
                names.append(joined)
            new, fresh, values, kept = self._joined(ids, at, number[joined], ranked)
            # pairs with a right neighbour that is itself joined later on
            between = ids[at[:-1] + 2]
            if len(at) > 1 and ((values < least).any() or (ranked(np.full(len(between), number[joined]), between) < least).any()):
                # one of them makes a pair of lower rank: only the leftmost is sure to be next
                new, fresh, values, kept = self._joined(ids, at[:1], number[joined], ranked)
            rank = np.append(rank, none)[kept][: len(new) - 1]
            rank[fresh] = values
            ids = new
        return [names[k] for k in ids.tolist()]

    @staticmethod
    def _joined(ids: np.ndarray, at: np.ndarray, symbol: int, ranked) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids with places `at` and the next ones joined; its new pairs, their ranks, and which old places are left."""
        new = ids.copy()
        new[at] = symbol
        kept = np.ones(len(ids), dtype=bool)
        kept[at + 1] = False
        new = new[kept]
        spots = at - np.arange(len(at))
        fresh = np.unique(np.concatenate([spots[spots > 0] - 1, spots[spots < len(new) - 1]]))
        return new, fresh, ranked(new[fresh], new[fresh + 1]), kept


class ByteBPE:
    """Byte-level BPE with added tokens and framing (RoBERTa, ModernBERT, Qwen)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: list[tuple[str, int, bool, bool]] = (), prefix: str | None = "<s>", suffix: str = "</s>", unk: str | None = None, nfc: bool = False, pattern: str = patterns.GPT2):
        self.vocab, self.merges = vocab, Merges(merges)
        self.table = patterns.byte_table()
        self.prefix = None if prefix is None else vocab[prefix]
        self.suffix = vocab[suffix]
        self.unk = vocab.get(unk) if unk else None
        self.nfc = nfc
        self.pattern = regex.compile(pattern)
        quoted = [(r"\s*" if left else "") + f"(?P<t{k}>{re.escape(c)})" + (r"\s*" if right else "") for k, (c, _, left, right) in enumerate(sorted(added, key=lambda a: -len(a[0])))]
        self.added = regex.compile("|".join(quoted)) if quoted else None
        self.added_ids = [a[1] for a in sorted(added, key=lambda a: -len(a[0]))]
        self._kept: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        return remembered(self._kept, word, self._merged)

    def _merged(self, word: str) -> list[int]:
        parts = self.merges([self.table[b] for b in word.encode("utf-8")])
        return [i for p in parts if (i := self.vocab.get(p, self.unk)) is not None]

    def _segment(self, text: str, budget: int, out: list[int]) -> None:
        for w in self.pattern.findall(text):
            if len(out) >= budget:
                return
            out += self.word(w)

    def encode(self, text: str, max_len: int) -> list[int]:
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        out = [] if self.prefix is None else [self.prefix]
        budget, at = max(1, max_len), 0
        for m in self.added.finditer(text) if self.added else ():
            self._segment(text[at : m.start()], budget, out)
            out.append(self.added_ids[int(m.lastgroup[1:])])
            at = m.end()
        self._segment(text[at:], budget, out)
        return [*out[: max(0, max_len - 1)], self.suffix]


class FallbackBPE:
    """BPE over the whole text with spaces as marks; unknown characters become byte tokens."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], bos: str = "<bos>", eos: str = "<eos>", unk: str = "<unk>"):
        self.vocab, self.merges = vocab, Merges(merges)
        self.bos, self.eos, self.unk = vocab[bos], vocab[eos], vocab[unk]
        self.bytes = [f"<0x{b:02X}>" for b in range(256)]
        self._kept: dict[str, list[str]] = {}

    def _symbols(self, text: str) -> list[str]:
        return [x for c in text for x in ((c,) if c in self.vocab else map(self.bytes.__getitem__, c.encode("utf-8")))]

    def pieces(self, text: str) -> list[str]:
        # no merge reaches over the end of such a part, so each distinct one is merged once
        parts = self.merges.cut(self._symbols(text.replace(" ", "▁")))
        return [p for part in parts for p in remembered(self._kept, "\x00".join(part), lambda key: self.merges(key.split("\x00")))]

    def encode(self, text: str, max_len: int) -> list[int]:
        ids = [self.vocab.get(p, self.unk) for p in self.pieces(text)] if text else []
        return [*[self.bos, *ids][: max(1, max_len - 1)], self.eos]


class Unigram:
    """Best-scoring segmentation; runs of unknown characters become one unknown token."""

    def __init__(self, pieces: list[tuple[str, float, int]], charsmap: dict[bytes, bytes] | None = None):
        if bad := [k for _, _, k in pieces if k not in (1, 2, 3)]:
            raise ValueError(f"piece type {bad[0]} is not supported")
        texts = [t for t, _, _ in pieces]
        if len(set(texts)) != len(texts):
            raise ValueError("repeated piece")
        self.ids = {t: k for k, (t, _, kind) in enumerate(pieces) if kind == 1}
        self.scores = [s for _, s, _ in pieces]
        self.unk = next(k for k, p in enumerate(pieces) if p[2] == 2)
        self.unk_score = min((s for _, s, kind in pieces if kind == 1), default=0.0) - 10.0
        self.size = len(pieces) + 2
        self.single = {t for t in self.ids if len(t) == 1}
        #: Pieces from their last character on; "" leads to the piece's number.
        self.tree: dict = {}
        for t, k in self.ids.items():
            node = self.tree
            for c in reversed(t):
                node = node.setdefault(c, {})
            node[""] = k
        self.by_word = not any("▁" in t[1:] for t in self.ids)
        self._kept: dict[str, list[tuple[str, int]]] = {}
        self.charsmap = charsmap or {}
        self.longest_rule = max(map(len, self.charsmap), default=0)

    def normalize(self, text: str) -> str:
        raw = text.encode("utf-8", "surrogateescape")
        if self.charsmap:
            out, at = [], 0
            while at < len(raw):
                for n in range(min(self.longest_rule, len(raw) - at), 0, -1):
                    if raw[at : at + n] in self.charsmap:
                        out.append(self.charsmap[raw[at : at + n]])
                        break
                else:
                    n = 1
                    while at + n < len(raw) and raw[at + n] & 0xC0 == 0x80:
                        n += 1
                    out.append(raw[at : at + n])
                at += n
            raw = b"".join(out)
        text = re.sub(" +", " ", raw.decode("utf-8", "replace").strip(" "))
        return "▁" + text.replace(" ", "▁") if text else ""

    def segments(self, s: str) -> list[tuple[str, int]]:
        """The pieces of best total score, with their numbers; ties go to the longer last piece."""
        # where no piece holds a mark but in front, every mark begins a piece
        words = [w for w in re.split("(?=▁)", s) if w] if self.by_word else [s] if s else []
        out: list[tuple[str, int]] = []
        for text, k in (x for w in words for x in remembered(self._kept, w, self._best)):
            if out and k == self.unk == out[-1][1]:
                text = out.pop()[0] + text
            out.append((text, k))
        return out

    def _best(self, s: str) -> list[tuple[str, int]]:
        # total[j], last[j]: best score of the first j characters, and their last piece
        total, last = [0.0], [0]
        size = [0]
        for end in range(1, len(s) + 1):
            # pieces that end here, from the shortest: down the tree of reversed pieces
            most, piece, length = -math.inf, self.unk, 1
            node, n = self.tree, 0
            if s[end - 1] not in self.single:
                most = total[end - 1] + self.unk_score
            while n < end and (node := node.get(s[end - 1 - n])) is not None:
                n += 1
                if (k := node.get("")) is not None and total[end - n] + self.scores[k] >= most:
                    most, piece, length = total[end - n] + self.scores[k], k, n
            total.append(most)
            last.append(piece)
            size.append(length)
        out, end = [], len(s)
        while end:
            out.append((s[end - size[end] : end], last[end]))
            end -= size[end]
        return out[::-1]

    @staticmethod
    def outer_id(k: int) -> int:
        """Ids with the framing tokens moved: 0 to 3, 1 to 0, 2 to 2, the rest one up."""
        return {0: 3, 1: 0, 2: 2}.get(k, k + 1)

    def encode(self, text: str, max_len: int) -> list[int]:
        raw = self.normalize(text).encode("utf-8")
        most = (max(0, max_len - 2) + 16) * max(1, max((len(t.encode()) for t in self.ids), default=1))
        cut = raw[:most].decode("utf-8", "ignore")
        ids = [self.outer_id(k) for _, k in self.segments(cut)]
        return [0, *ids[: max(0, max_len - 2)], 2]

"""Byte-level BPE encoding and decoding, by DuckDB recursive queries inside each partition.

A batch of documents is cut into pre-tokens by the vocabulary's pattern; its distinct pre-tokens
that the worker doesn't know yet become token-position rows (word, ord, id), one per byte.  A
recursive query joins neighbours with the merge table (left id, right id, merged id = rank) and in
each round contracts every word's leftmost pair of least rank, until no word has a pair that
merges; words that are done leave the recursion, and positions are renumbered as it goes, so that
neighbours meet by equality.  An ordered aggregation gives each word's ids.  The ids of each document
are then decoded as such: joined with the vocabulary and aggregated in their order, whatever they
were made from.

A pre-token that is a token of the vocabulary is that token, as in the tiktoken library.  A pre-token
of over `LONG` bytes (a run of so many letters without a space) would take a round for each byte,
each over all of its bytes; for them alone a heap contracts the same pairs in the same order.

Nulls count as empty: no tokens, no bytes.  Ties of rank go to the leftmost pair.  Repeated rows give
repeated results; an empty table gives none; texts of any length are read whole; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import base64
import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import KEPT_BY, arrow_map, digest, raw_bytes, tokenizer_path

#: Bytes of a pre-token up to which it goes through the recursive query.
LONG = 1024
#: Words that a worker remembers before it starts anew.
KEPT = 600_000
#: Rows that one recursive query makes at most, about: half the square of a word's bytes for each word.
ROWS = 3_000_000
#: Bytes of text handled at once.
PIECE = 4 << 20

_RECURSION = """
WITH RECURSIVE state(word, ord, id, round) AS (
    SELECT word, ord, id, 0 FROM start
  UNION ALL
    SELECT s.word, s.ord - CAST(s.ord > (b.best & 4294967295) AS INT), CASE WHEN s.ord = (b.best & 4294967295) THEN CAST(b.best >> 32 AS INT) ELSE s.id END, s.round + 1
    FROM state s
    JOIN (SELECT a.word, min((CAST(m.merged AS BIGINT) << 32) | a.ord) AS best
          FROM state a JOIN state n ON n.word = a.word AND n.ord = a.ord + 1 JOIN merges m ON m.l = a.id AND m.r = n.id
          GROUP BY a.word) b ON s.word = b.word
    WHERE s.ord <> (b.best & 4294967295) + 1
),
ends AS (SELECT word, max(round) AS round FROM state GROUP BY word)
SELECT word, list(id ORDER BY ord) AS ids FROM state JOIN ends USING (word, round) GROUP BY word
"""
_DECODE = "SELECT doc, string_agg(hex, '' ORDER BY pos) AS hex FROM ids JOIN vocabulary USING (id) GROUP BY doc"


class Codec:
    """Vocabulary, merge table and what the worker knows already; made once per worker."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: b for b, i in self.ranks.items()}
        #: Ids in decimal.
        self.said = list(map(str, range(max(self.tokens) + 1)))
        self.pattern = regex.compile(public_pattern())
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        merges = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        left, right, merged = (pa.array(x, pa.int32()) for x in zip(*merges, strict=True))
        self.merges = pa.table({"l": left, "r": right, "merged": merged})
        self.vocabulary = pa.table({"id": pa.array(list(self.tokens), pa.int32()), "hex": pa.array([b.hex() for b in self.tokens.values()], pa.string())})
        self._db = None
        self.forget_words()

    @property
    def db(self):
        """The task's database, with the tables of the vocabulary."""
        if self._db is None:
            import duckdb

            merges, vocabulary = self.merges, self.vocabulary  # noqa: F841
            self._db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "preserve_insertion_order": False})
            self._db.execute("CREATE TABLE merges AS SELECT * FROM merges")
            self._db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        return self._db

    def close(self) -> None:
        if self._db is not None:
            self._db.close()
            self._db = None

    def forget_words(self) -> None:
        """No word is known any more.  Of known words: their number, and where their ids stand."""
        self.words: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def by_heap(self, word: bytes) -> list[int]:
        """The same contraction order for one long word."""
        ids = self.first[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before, size = [*range(1, n), -1], list(range(-1, n - 1)), [1] * n
        rank = lambda i: self.ranks.get(word[i : i + size[i] + size[after[i]]]) if after[i] >= 0 else None
        heap = [(r, i, 2) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, total = heapq.heappop(heap)
            if not size[i] or after[i] < 0 or size[i] + size[after[i]] != total:
                continue
            gone = after[i]
            ids[i], size[i] = r, total
            after[i], size[gone] = after[gone], 0
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (own := rank(k)) is not None:
                    heapq.heappush(heap, (own, k, size[k] + size[after[k]]))
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words, and where each word's begin and how many they are."""
        known = np.array(list(map(self.ranks.get, words, itertools.repeat(-1))), dtype=np.int32)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        # a word that is a token is that token
        parts = [known[known >= 0]]
        starts, sizes = np.cumsum(known >= 0) - 1, (known >= 0).astype(np.int64)
        many = len(parts[0])
        for k in np.flatnonzero((known < 0) & (length > LONG)).tolist():
            parts.append(np.array(self.by_heap(words[k]), dtype=np.int32))
            starts[k], sizes[k] = many, len(parts[-1])
            many += len(parts[-1])
        rest = np.flatnonzero((known < 0) & (length <= LONG))
        # words of like length take as many rounds
        rest = rest[np.argsort(length[rest], kind="stable")]
        ends = np.cumsum(length[rest] * (length[rest] + 1) // 2)
        at = 0
        while at < len(rest):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROWS, side="right")))
            some = rest[at:to]
            own = length[some]
            data = np.frombuffer(b"".join([words[k] for k in some.tolist()]), dtype=np.uint8)
            start = pa.table({"word": np.repeat(some.astype(np.int32), own), "ord": (np.arange(len(data)) - np.repeat(np.cumsum(own) - own, own)).astype(np.int32), "id": self.first[data]})  # noqa: F841
            got = self.db.sql(_RECURSION).to_arrow_table()
            word, lists = np.asarray(got.column("word")), got.column("ids").combine_chunks()
            offsets = np.asarray(lists.offsets, dtype=np.int64)
            starts[word], sizes[word] = many + offsets[:-1] - offsets[0], np.diff(offsets)
            parts.append(np.asarray(lists.values, dtype=np.int32)[offsets[0] : offsets[-1]])
            many += len(parts[-1])
            at = to
        return np.concatenate(parts), starts, sizes

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of sequences of ids, one after another, of so many ids each: by ordered aggregation."""
        out = [b""] * len(counts)
        if len(ids):
            ids = pa.table({"doc": np.repeat(np.arange(len(counts), dtype=np.int32), counts), "pos": np.arange(len(ids), dtype=np.int32), "id": ids})  # noqa: F841
            got = self.db.sql(_DECODE).to_arrow_table()
            for k, text in zip(got.column("doc").to_pylist(), got.column("hex").to_pylist(), strict=True):
                out[k] = bytes.fromhex(text)
        return out

    def learn(self, words: set[str]) -> None:
        """Afterwards all of them are known."""
        if len(self.words) > KEPT:
            self.forget_words()
        if new := [w for w in words if w not in self.words]:
            ids, starts, sizes = self.encode([w.encode("utf-8") for w in new])
            self.starts = np.concatenate([self.starts, len(self.ids) + starts])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, ids])
            self.words.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after another, and their numbers."""
        cut = [self.pattern.findall(t) for t in texts]
        self.learn(set().union(*cut))
        many = np.array([len(ws) for ws in cut], dtype=np.int64)
        word = np.fromiter(map(self.words.__getitem__, itertools.chain.from_iterable(cut)), dtype=np.int64, count=int(many.sum()))
        sizes = self.sizes[word]
        total = np.append(0, np.cumsum(sizes))
        flat = self.ids[np.arange(total[-1]) + np.repeat(self.starts[word] - total[:-1], sizes)]
        ends = np.cumsum(many)
        return flat, total[ends] - total[ends - many]


def public_pattern() -> str:
    """The pre-token pattern that belongs to the public vocabularies."""
    import public_tokenizers

    return public_tokenizers.PATTERN


_codecs: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
        KEPT_BY["byte_bpe"] = _codecs.clear
    return _codecs[path]


def _close() -> None:
    """At the end of a task: vocabularies and words stay with the worker until another operator's task, databases don't."""
    for own in _codecs.values():
        own.close()


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, digests: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, and ids and decoded bytes of the whole text.

    digests: ids_sha256 and decoded_sha256 (of the ids joined by commas, and of the bytes) instead
    of ids (array<int>) and decoded (string).  One pass, no shuffle.
    """
    path = vocabulary or tokenizer_path("byte_bpe_multi_50k.tiktoken")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _codec(path)
        flat, counts = own.encode_texts([(raw or b"").decode("utf-8") for raw in raw_bytes(batch.column("text"))])
        decoded = own.decode(flat, counts)
        ends = np.cumsum(counts)
        n = pa.array(counts, pa.int64())
        if digests:
            said = list(map(own.said.__getitem__, flat.tolist()))
            ids = [digest(",".join(said[a:b]).encode()) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            out = [pa.array(ids, pa.string()), pa.array(list(map(digest, decoded)), pa.string())]
        else:
            out = [pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat, pa.int32())), pa.array([d.decode("utf-8") for d in decoded], pa.string())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), n, *out], names=["doc_id", "n_tokens", *names])

    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return arrow_map(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), run, f"doc_id long, n_tokens long, {kinds}", limit=PIECE, done=_close, owner="byte_bpe")

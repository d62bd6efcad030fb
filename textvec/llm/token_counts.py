"""Token counts by overlap resynchronisation.

Huge texts are encoded in overlapping chunks with offsets and spliced at a boundary that both
chunks prove stable: a place where both encodings begin a new pre-token, at least `GUARD`
characters before the end of the left chunk.  The byte-level pre-tokenizer reads left to right and
looks one character ahead at most, so from such a place on the right chunk's tokens are those of
the whole text, and up to it the left chunk's tokens are.  Where an overlap holds no such place (a
run of letters longer than the overlap), the overlap is widened, in the end to the whole rest.

Every other text is cut at boundaries that are stable without a look at the encodings: one space
between two characters that are not white space always begins a pre-token.  The same piece then
always has the same tokens, so each distinct piece is encoded once per worker and kept.

Nulls count as empty; an empty text has 0 tokens.  Repeated rows give repeated results; an empty table
gives none; of boundaries that both chunks hold the last counts, and any gives the same ids.  Only the
two named columns are read, whatever others there are.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, raw_bytes, tokenizer_path

#: Characters; longer texts go through overlapping chunks.
HUGE = 1 << 15
CHUNK, OVERLAP = 1 << 14, 256
#: More than the longest added token, and the one character of look-ahead.
GUARD = 32
#: Distinct pieces that a worker keeps before it starts anew.
KEPT = 300_000

_workers: dict = {}


def tokenizer(path: str):
    """The library's tokenizer, once per worker, on one thread."""
    if path not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        _workers[path] = own
    return _workers[path]


def _starts(encoding, base: int) -> np.ndarray:
    """Token index and place in the text of each token that begins a pre-token."""
    words, offsets = encoding.word_ids, encoding.offsets
    at = [(k, base + offsets[k][0]) for k in range(len(words)) if k == 0 or words[k] != words[k - 1]]
    return np.array(at, dtype=np.int64).reshape(-1, 2)


def resynchronised(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, guard: int = GUARD) -> list[int]:
    """The ids of the whole text, from encodings of overlapping chunks."""
    out: list[int] = []
    begin, stop = 0, min(len(text), chunk)
    left = encode(text[begin:stop])
    trusted = 0  # tokens of `left` before this one belong to the part that is out already
    while stop < len(text):
        mine, wide = _starts(left, begin), overlap
        while True:
            start = max(begin, stop - wide)
            end = min(len(text), start + wide + chunk)
            if start == begin:  # the overlap is the whole chunk: encode both together
                left, stop = encode(text[begin:end]), end
                break
            right = encode(text[start:end])
            theirs = _starts(right, start)
            both, a, b = np.intersect1d(mine[:, 1], theirs[:, 1], return_indices=True)
            # the first start of the right chunk is an artefact of the cut
            ok = (both > start) & (both <= stop - guard) & (mine[a, 0] >= trusted)
            if ok.any():
                k = int(np.flatnonzero(ok)[-1])
                out += left.ids[trusted : mine[a[k], 0]]
                trusted, left, begin, stop = int(theirs[b[k], 0]), right, start, end
                break
            wide *= 2
    return out + left.ids[trusted:]


_STABLE = re.compile(r"(?<=\S)(?= \S)")


def stable_pieces(text: str) -> list[str]:
    """The text cut before each space that stands between two characters that aren't white space."""
    return _STABLE.split(text)


def _counter(path: str, huge: int):
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = tokenizer(path)
        kept = _workers.setdefault((path, "kept"), {})
        encode = lambda t: own.encode(t, add_special_tokens=False)
        n_bytes, n_tokens, cut = [], [], []
        for raw in raw_bytes(batch.column("text")):
            n_bytes.append(len(raw or b""))
            text = (raw or b"").decode("utf-8")
            if len(text) > huge:
                cut.append(None)
                n_tokens.append(len(resynchronised(encode, text)))
            else:
                cut.append(stable_pieces(text) if text else [])
                n_tokens.append(0)
        if len(kept) > KEPT:
            kept.clear()
        new = list({p for c in cut if c for p in c if p not in kept})
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            kept.update(zip(some, (len(e) for e in own.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        for k, c in enumerate(cut):
            if c:
                n_tokens[k] = sum(map(kept.__getitem__, c))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return count


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, huge: int = HUGE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row: UTF-8 bytes, and tokens as the library counts them.

    No shuffle: one pass, column-pruned, with batches of bounded bytes.
    """
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")
    return arrow_map(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), _counter(path, huge), "doc_id long, n_bytes long, n_tokens long")

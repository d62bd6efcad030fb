"""Benchmark decontamination by latent semantic retrieval.

Documents are cut in passages of `2 * STRIDE` words, one every `STRIDE` words, and benchmark items
in even pieces of at most `PART` words, as long as a passage, so that an item of any length is found
by its pieces.  Passages and pieces are TF-IDF vectors over the benchmark's terms, with document
frequencies counted over the whole corpus; terms in over `OFTEN` of all documents weigh nothing,
unless nearly all of an item's words are such terms, and none weighs more than one in `RARE` of the
documents, so that a copy whose names are replaced is near by its other words.  A distributed
randomised SVD gives the latent space: each task applies A^T A to a fixed Gaussian test matrix for
its own passages, the sums over all documents are added up, and the driver solves the small Nystroem
eigenproblem (terms x rank, of bounded size).  The pieces count as much as all passages, so that the
space tells items apart.  All passages of all documents are then projected, and those that reach
`COVER` of a piece's length and whose cosine with it is `cosine`, or that reach `MOST` of it, become
candidates of its item.

A candidate is verified on the words around the passage: the longest common subsequence with the
item must cover `lcs` of the item, or, for paraphrases, `loose` of the item together with `answer`
of the item's answer (its last sentence).  Counts of shared words, of distinct ones and of rare ones
are tested first; they are upper bounds of the subsequence and lose nothing.

Benchmarks are taken in slices of `SLICE` items and `SLICE_WORDS` words, each broadcast, so the broadcast is bounded however
large the benchmark is.  Null and empty texts match nothing; null item ids are kept as null.  Words
compare by A-Z folded hashes of 64 bits.  Repeated rows give repeated matches of the same id, once.
Documents of any length are read whole; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches, stored, tidied
from .shingles import word_hashes

STRIDE, RANK, EXTRA = 16, 96, 16
#: Words in a piece of an item, at most: those of a passage.
PART = 2 * STRIDE
#: Terms in over OFTEN of all documents weigh nothing; those in under RARE weigh no more than at RARE.
OFTEN, RARE = 0.5, 0.02
#: A candidate passage reaches COVER of a piece's length and points towards it by COSINE, or reaches MOST of it.
COSINE, COVER, MOST, LCS, LOOSE, ANSWER = 0.25, 0.25, 0.5, 0.75, 0.6, 0.9
#: Items, and words of items, that share a space and a broadcast; an item over that has its own.
SLICE, SLICE_WORDS = 2000, 40_000
#: Leading bits of a word's hash that lead to the terms.
BITS = 18
#: Words of candidates' surroundings looked up at once.
LOOKED_UP = 4 << 20
#: Bytes of text hashed at once; the arrays take some 50 times as much.
PIECE = 1 << 20
MATCHES = "doc_id long, item_id long, lcs double, answer double, cosine double"


def places(a: list[int]) -> dict[int, int]:
    """A bit for each place of each word."""
    at: dict[int, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    return at


def lcs_length(a: list[int], b: list[int], at: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    at = places(a) if at is None else at
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if m := at.get(y, 0):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def answer_of(text: str) -> str:
    """The last sentence of an item."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p.strip()]
    return parts[-1] if parts else ""


class Items:
    """One slice of the benchmark: words, answers, and the terms in order of hash."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.ids, self.words, self.answers = [], [], []
        for k, text in rows:
            h, _ = word_hashes(pa.array([text, answer_of(text)]), fold=True)
            n = word_hashes(pa.array([text]), fold=True)[1][0]
            if n:
                self.ids.append(k)
                self.words.append(h[:n])
                self.answers.append(h[n:])
        every = np.concatenate(self.words) if self.words else np.empty(0, np.uint64)
        self.terms = np.unique(every)
        self.every = np.searchsorted(self.terms, every)
        #: Each item in pieces of at most PART words, as even as can be: the piece's item and first word in `every`.
        self.of, self.heads, at = [], [], 0
        for k, w in enumerate(self.words):
            many = -(-len(w) // PART)
            self.of += [k] * many
            self.heads += [at + len(w) * j // many for j in range(many)]
            at += len(w)
        #: Where the terms of each value of the leading BITS bits begin, whether there are any, and how many at most.
        first = np.searchsorted(self.terms >> np.uint64(64 - BITS), np.arange((1 << BITS) + 1, dtype=np.uint64))
        self.first, self.some, self.deep = first[:-1].astype(np.int32), first[1:] > first[:-1], int(np.diff(first).max())

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """Sum of the terms' rows over the words of each piece."""
        return np.add.reduceat(rows[self.every], self.heads, axis=0)

    def spread(self, rows: np.ndarray) -> np.ndarray:
        """The transpose of sums(): each piece's row added to its words' terms."""
        out = np.zeros((len(self.terms), rows.shape[1]))
        np.add.at(out, self.every, np.repeat(rows, np.diff([*self.heads, len(self.every)]), axis=0))
        return out

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The term number of each word, -1 for words of no item."""
        out = np.full(len(h), -1, dtype=np.int32)
        top = (h >> np.uint64(64 - BITS)).astype(np.int64)
        at = np.flatnonzero(self.some[top])
        k, own = self.first[top[at]], h[at]
        for _ in range(self.deep):
            good = self.terms[np.minimum(k, len(self.terms) - 1)] == own
            out[at[good]] = k[good]
            at, k, own = at[~good], k[~good] + 1, own[~good]
        return out


def _weighted(numbers: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words that weigh something: their term and block; and first block and number of blocks of each text."""
    many = -(-counts // STRIDE)
    first = np.cumsum(many) - many
    at = np.flatnonzero(numbers >= 0)
    at = at[idf[numbers[at]] > 0]
    ends = np.cumsum(counts)
    text = np.searchsorted(ends, at, side="right")
    block = first[text] + (at - (ends - counts)[text]) // STRIDE
    return numbers[at], block, first, many


def _block_sums(terms: np.ndarray, block: np.ndarray, rows: np.ndarray, at_once: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the terms' rows in each block that has any, and the blocks; a block has STRIDE words at most."""
    heads = np.flatnonzero(np.append(True, block[1:] != block[:-1])[: len(block)])
    size = np.diff(np.append(heads, len(block)))
    # those of most terms first, so that the ones that have another stand in front
    order = np.argsort(-size, kind="stable")
    out = np.empty((len(heads), rows.shape[1]), rows.dtype)
    for k in range(0, len(heads), at_once):
        own = order[k : k + at_once]
        at, left = heads[own], size[own]
        part = rows.take(terms[at], axis=0)
        for j in range(1, int(left[0])):
            more = at[left > j]
            part[: len(more)] += rows.take(terms[more + j], axis=0)
        out[own] = part
    return out, block[heads]


def _frequencies(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        total, n = np.zeros(len(items.terms), dtype=np.int64), 0
        for batch in pieces(batches, "text", PIECE):
            h, counts = word_hashes(batch.column("text"), fold=True)
            numbers = items.numbers(h)
            at = np.flatnonzero(numbers >= 0)
            text = np.searchsorted(np.cumsum(counts), at, side="right")
            step = max(1, (32 << 20) // max(1, len(items.terms)))
            for start in range(0, batch.num_rows, step):
                a, b = np.searchsorted(text, [start, start + step])
                seen = np.zeros((min(step, batch.num_rows - start), len(items.terms)), dtype=bool)
                seen[text[a:b] - start, numbers[at[a:b]]] = True
                total += seen.sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "sums"])

    return count


def _ranges(shared, idf_of):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, (idf, test) = shared.value, idf_of.value
        total, n = np.zeros((len(items.terms), test.shape[1])), 0
        scaled = (idf[:, None] * test).astype(np.float32)
        for batch in pieces(batches, "text", PIECE):
            h, counts = word_hashes(batch.column("text"), fold=True)
            terms, block, _, _ = _weighted(items.numbers(h), counts, idf)
            sums, blocks = _block_sums(terms, block, scaled)
            # A^T (A test): each word adds its block's row to its term
            order = np.argsort(terms, kind="stable")
            every, row = terms[order], np.searchsorted(blocks, block)[order]
            for start in range(0, len(every), 4096):
                own = every[start : start + 4096]
                heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                total[own[heads]] += idf[own[heads], None] * np.add.reduceat(sums.take(row[start : start + 4096], axis=0), heads, axis=0)
            n += len(blocks)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "sums"])

    return sketch


def _added(df: DataFrame, real: bool, parts: int = 16) -> tuple[int, np.ndarray | None]:
    """Sums over all tasks, first within `parts` groups on the executors, then of those on the driver."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for k, s in zip(batch.column("n").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                own = np.frombuffer(s, dtype=np.float64 if key[1].as_py() else np.int64)
                n, total = n + k, own.copy() if total is None else total + own
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "sums"])

    grouped = df.withColumn("part", F.spark_partition_id() % parts).withColumn("real", F.lit(real))
    n, total = 0, None
    for r in grouped.groupBy("part", "real").applyInArrow(add, "n long, sums binary").coalesce(parts).toLocalIterator():
        own = np.frombuffer(r["sums"], dtype=np.float64 if real else np.int64)
        n, total = n + r["n"], own.copy() if total is None else total + own
    return n, total


def latent_space(sketch: np.ndarray, test: np.ndarray, rank: int) -> np.ndarray:
    """Orthonormal basis (terms x rank) of the leading right singular space, from sketch = A^T A test."""
    q, _ = np.linalg.qr(sketch)
    small = q.T @ sketch
    core = small @ np.linalg.pinv(test.T @ sketch, rcond=1e-10) @ small.T
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    return q @ vectors[:, np.argsort(-values)[:rank]]


def weights_of(items: Items, n: int, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weight of each term, and which are rare; df: documents, of n, that hold it."""
    idf = np.where(df > 0, np.log(1 + np.minimum(n / np.maximum(df, 1), 1 / RARE)), 0.0)
    often = df > max(1, OFTEN * n)
    weights = np.where(often, 0.0, idf)
    # an item of frequent words only (or one that much of a corpus repeats) keeps its words' weight
    at = 0
    for w in items.words:
        own = np.unique(items.every[at : at + len(w)])
        at += len(w)
        if np.count_nonzero(weights[own]) < 0.25 * len(own):
            weights[own] = idf[own]
    return weights, df <= max(1, RARE * n)


def fitted_space(items: Items, idf: np.ndarray, test: np.ndarray, passages: int, sketch: np.ndarray, rank: int) -> np.ndarray:
    """The latent space of all passages and of the items' pieces, which count as much as these."""
    pieces_too = max(1.0, passages / len(items.of)) * idf[:, None] * items.spread(items.sums(idf[:, None] * test))
    return latent_space(sketch + pieces_too, test, rank)


def targets_of(items: Items, idf: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's direction in the space, and its length there."""
    own = items.sums(idf[:, None] * basis)
    lengths = np.maximum(1e-6, np.linalg.norm(own, axis=1))
    return (own / lengths[:, None]).astype(np.float32), lengths.astype(np.float32)


def _possible(items: Items, holds: np.ndarray, heavy: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray, least: float) -> np.ndarray:
    """Which areas may have a common subsequence of `least` of the item: upper bounds, so none is lost.

    It uses so many words of the item; and it lacks no more of the item's distinct words, or of
    its distinct rare ones, than it lacks words.
    """
    lacks = (1 - least) * sizes[item] + 1e-9
    distinct, rare = holds.sum(axis=1)[item] - lacks, heavy.sum(axis=1)[item] - lacks

    def enough(left: np.ndarray, table: np.ndarray, bound: np.ndarray, again) -> np.ndarray:
        """Of the areas `left`, those with so many words that the table has for their item, and that again() finds good."""
        has = table.any(axis=0)[numbers]  # the last column is for words of no item
        words, before = numbers[has], np.append(0, np.cumsum(has))
        left = left[before[end[left]] - before[begin[left]] >= bound[left]]
        ok = np.zeros(len(left), dtype=bool)
        heads, ends = before[begin[left]], np.cumsum(before[end[left]] - before[begin[left]])
        at = 0
        while at < len(left):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + LOOKED_UP, side="right")))
            wide = np.diff(ends[at:to], prepend=done)
            which = np.repeat(np.arange(to - at), wide)
            key = item[left[at:to]][which] * table.shape[1] + words[np.arange(len(which)) + np.repeat(heads[at:to] + done - (ends[at:to] - wide), wide)]
            hit = table.ravel()[key]
            which, key = which[hit], key[hit] % table.shape[1]
            ok[at:to] = np.bincount(which, minlength=to - at) >= bound[left[at:to]]
            if again is not None:
                good = ok[at:to][which]
                ok[at:to] &= again(left[at:to], which[good], key[good])
            at = to
        return left[ok]

    def apart(areas: np.ndarray, which: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Those with enough distinct words, and rare ones."""
        key = np.unique(which * holds.shape[1] + words)
        which, words = key // holds.shape[1], key % holds.shape[1]
        good = np.bincount(which, minlength=len(areas)) >= distinct[areas]
        return good & (np.bincount(which[heavy[item[areas[which]], words]], minlength=len(areas)) >= rare[areas])

    # rare words first, as there are few of them
    ok = np.zeros(len(item), dtype=bool)
    ok[enough(enough(np.arange(len(item)), heavy, rare, None), holds, sizes[item] - lacks, apart)] = True
    return ok


def _search(shared, space_of, cosine: float, lcs: float, loose: float, answer: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, (idf, rare, basis, targets, lengths) = shared.value, space_of.value
        rows = (idf[:, None] * basis).astype(np.float32)
        of, sizes = np.array(items.of), np.array([len(w) for w in items.words])
        holds = np.zeros((len(items.ids), len(items.terms) + 1), dtype=bool)  # the last column is for words of no item
        holds[np.repeat(np.arange(len(sizes)), sizes), items.every] = True
        heavy = holds & np.append(rare, False)
        least, bits = min(lcs, loose), {}
        for batch in pieces(batches, "text", PIECE):
            h, counts = word_hashes(batch.column("text"), fold=True)
            numbers = items.numbers(h)
            terms, block, first, many = _weighted(numbers, counts, idf)
            sums, blocks = _block_sums(terms, block, rows)
            if not len(blocks):
                continue
            text = np.searchsorted(first + many, blocks, side="right")
            # a passage is a block and the next one of the same text, where that has weight too
            follows = np.zeros(len(blocks), dtype=bool)
            follows[:-1] = (blocks[1:] == blocks[:-1] + 1) & (text[1:] == text[:-1])
            sums[:-1] += sums[1:] * follows[:-1, None]
            starts = (np.cumsum(counts) - counts)[text] + (blocks - first[text]) * STRIDE
            length = np.sqrt(np.einsum("ij,ij->i", sums, sums))
            found_at = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
            # a passage reaches no farther than its length; a little is left for rounding
            long = np.flatnonzero(length >= (1 - 1e-4) * COVER * lengths.min())
            for start in range(0, len(long), 4096):
                own = long[start : start + 4096]
                reach = (sums[own] @ targets.T).ravel()
                at = np.flatnonzero(reach.reshape(len(own), -1) >= COVER * lengths)
                reach, p, k = reach[at], own[at // len(of)], at % len(of)
                near = reach / np.maximum(length[p], 1e-12)
                good = (near >= cosine) | (reach >= MOST * lengths[k])
                found_at.append((p[good], of[k[good]], near[good]))
            p, k, near = (np.concatenate(x) for x in zip(*found_at, strict=True))
            # of several pieces of an item that meet a passage, the nearest
            order = np.lexsort((-near, k, p))
            p, k, near = p[order], k[order], near[order]
            once = np.append(True, (p[1:] != p[:-1]) | (k[1:] != k[:-1]))[: len(p)]
            p, k, near = p[once], k[once], near[once]
            # the words that a subsequence may use: the passage and an item's length on either side
            begin = np.maximum((np.cumsum(counts) - counts)[text[p]], starts[p] - sizes[k])
            end = np.minimum(np.cumsum(counts)[text[p]], starts[p] + 2 * STRIDE + sizes[k])
            ok = _possible(items, holds, heavy, sizes, numbers, k, begin, end, least)
            found = []
            for a, b, item, t, c in zip(begin[ok].tolist(), end[ok].tolist(), k[ok].tolist(), text[p[ok]].tolist(), near[ok].tolist(), strict=True):
                own = items.words[item].tolist()
                if item not in bits:
                    bits[item] = places(own)
                share = lcs_length(own, h[a:b][holds[item, numbers[a:b]]].tolist(), bits[item]) / sizes[item]
                if share >= least:
                    said = len(items.answers[item])
                    answered = lcs_length(items.answers[item].tolist(), h[a:b].tolist()) / said if said else 0.0
                    if share >= lcs or (share >= loose and answered >= answer):
                        found.append((t, items.ids[item], share, answered, c))
            if found:
                t, *rest = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(t, pa.int64())), pa.array(rest[0], pa.int64()), *(pa.array(r, pa.float64()) for r in rest[1:])], names=["doc_id", "item_id", "lcs", "answer", "cosine"])

    return search


def decontamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rank: int = RANK, cosine: float = COSINE, lcs: float = LCS, loose: float = LOOSE, answer: float = ANSWER) -> DataFrame:
    """(doc_id, item_id, lcs, answer, cosine): one row for each document and item that it contains."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).filter("text is not null")
    found = spark.createDataFrame([], MATCHES)
    rows = benchmark.select(benchmark[item_col].cast("long").alias("k"), benchmark[item_text_col].alias("t")).filter("t is not null").orderBy("k", "t").toLocalIterator()

    def slices() -> Iterator[Items]:
        some, size = [], 0
        for r in rows:
            more = len(r["t"].split())
            if some and (len(some) == SLICE or size + more > SLICE_WORDS):
                yield Items(some)
                some, size = [], 0
            some.append((r["k"], r["t"]))
            size += more
        yield Items(some)

    for items in slices():
        if not items.ids:
            continue
        shared = spark.sparkContext.broadcast(items)
        n, df = _added(docs.select("text").mapInArrow(tidied(_frequencies(shared)), "n long, sums binary"), False)
        if not n:
            continue
        idf, rare = weights_of(items, n, df)
        width = min(rank + EXTRA, len(items.terms))
        test = np.random.default_rng(11).normal(size=(len(items.terms), width))
        weights = spark.sparkContext.broadcast((idf, test))
        passages, sketch = _added(docs.select("text").mapInArrow(tidied(_ranges(shared, weights)), "n long, sums binary"), True)
        basis = fitted_space(items, idf, test, passages, sketch.reshape(len(items.terms), width), min(rank, width))
        targets, lengths = targets_of(items, idf, basis)
        space = spark.sparkContext.broadcast((idf, rare, basis, targets, lengths))
        found = found.unionByName(docs.mapInArrow(tidied(_search(shared, space, cosine, lcs, loose, answer)), MATCHES))
    best = found.groupBy("doc_id", "item_id").agg(F.max("lcs").alias("lcs"), F.max("answer").alias("answer"), F.max("cosine").alias("cosine"))
    return stored(best)

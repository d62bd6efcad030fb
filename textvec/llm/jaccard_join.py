"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of distinct word n-grams; two link where their Jaccard similarity reaches the
threshold.  Per set, tokens (n-gram hashes) are put in one global order, rare ones first: by a
count sketch of all documents (one row of counters, as many as the input's size asks for, between
two bounds), then by hash.  Any global order is right for prefix filtering; the sketch only keeps
frequent tokens out of prefixes.

A set x that must share `a_x = ceil(t |x|)` tokens with any partner may choose a prefix of
|x| - a_x + l tokens; a partner that chose l' shares at least min(l, l') tokens of the prefixes.  Each
set picks its own l from 1 to `MOST` by estimated cost: the postings that its prefix scans, plus the
candidates that remain, at most their sum / l, each to be verified at the cost of its size.  For a
pair (x, y) that must share a_xy >= a_x tokens, the same prefix counts as one of l + a_xy - a_x, so
the pair is verified only if it shares min(l_x + a_xy - a_x, l_y + a_xy - a_y) prefix tokens.

Equal sets form a class of which one takes part.  What is asked for is the components, not the
pairs, and a group of thousands of near copies holds millions of pairs, many of them just below the
threshold; as rows, candidates would grow with the square of the group.  So prefix buckets that a
group fills are verified in bulk: every set of a bucket (token, size band) is compared with two
pivots of it, and sets of similarity `LOOSE` with a common centre form a family.  A family can't
chain: whoever is farther from its centre leaves it, and after `FAMILY_ROUNDS` rounds is alone.
Within a family a set is its difference from the centre, a fraction of its tokens, and the sizes of
those differences and of their intersections give all Jaccard similarities exactly; pairs of blocks
of a family give a spanning forest of links by matrix products, never pairs.  Pairs of sets of
different families that share enough prefix tokens are made by a join on the token and verified one
by one.  No partner is capped or sampled, and no pair above the threshold is left out.

Null and empty texts have no set and link with nothing; rows with a null id likewise.  Repeated rows
of one id count once: the id links wherever one of its rows does.  Fewer than n words: the whole
sequence is the one n-gram.  Ties in the order of tokens are broken by hash, in families by the
smallest id; neither changes the result.  An empty table gives an empty result.  Texts of any length
are read whole.  Only the two named columns are read, whatever others there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, dropped, hinted, pieces, small_batches, stored, tidied
from .components import components, links_forest
from .shingles import inside, mixed, ngrams, word_hashes

#: Least and largest number of counters of the sketch, and bytes of input for each in between.
SKETCH, LARGEST_SKETCH, PER_COUNTER = 1 << 21, 1 << 24, 64
#: Bytes of text hashed at once; the arrays take some 50 times as much.
PIECE = 1 << 20
MOST = 4
#: Similarity to the centre, in per cent, that a family asks for, and how often those left out may found families.
LOOSE, FAMILY_ROUNDS = 40, 2
#: Sets in a prefix bucket up to which its pairs are made one by one, at most (FEW - 1) / 2 rows for each posting.
FEW = 6
#: Tokens, and sets, of one block of a family, about.
BLOCK, BLOCK_SETS = 200_000, 512
#: Bytes of ids up to which the documents to verify are broadcast to the scan of texts.
BROADCAST_ROWS = 2_000_000


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one after another, and the texts' offsets."""
    h, counts = word_hashes(column, fold=True)
    grams = ngrams(h, n)
    starts, text = inside(counts, n)
    own = grams[starts]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        begins = np.cumsum(counts) - counts
        whole = np.array([mixed(np.array([np.uint64(xxhash.xxh3_64_intdigest(h[begins[k] : begins[k] + counts[k]].tobytes()))]))[0] for k in short], dtype=np.uint64)
        own, text = np.concatenate([own, whole]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        own, text = own[order], text[order]
    ends = np.searchsorted(text, np.arange(len(counts) + 1))
    for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        own[a:b].sort()
    new = np.ones(len(own), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    return own[new], np.append(0, np.cumsum(new))[ends]


def needed(n, per_cent: int):
    """The least overlap of a set of n with any partner: ceil(t n)."""
    return -(-per_cent * n // 100)


def sketch_size(docs: DataFrame) -> int:
    """Counters for the size that Spark estimates for the input, a power of two; any number gives the same result."""
    estimate = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(LARGEST_SKETCH, max(SKETCH, 1 << (estimate // PER_COUNTER).bit_length()))


def _counter_of(tokens: np.ndarray, size: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


_SETS = "doc_id long, n long, key long, key2 long, row long, counters binary"


def _sets(n: int, size: int):
    """Size and 128-bit key of each set; at the task's end, its counts of tokens in rows of 4096 counters."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.uint32)
        names = ["doc_id", "n", "key", "key2", "row", "counters"]
        for batch in pieces(batches, "text", PIECE):
            own, offsets = shingle_sets(batch.column("text"), n)
            np.add.at(total, _counter_of(own, size), np.uint32(1))
            keys = [xxhash.xxh3_128_intdigest(own[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            low, high = pa.array([(k & (1 << 64) - 1) - (1 << 63) for k in keys], pa.int64()), pa.array([(k >> 64) - (1 << 63) for k in keys], pa.int64())
            nothing = [pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), low, high, *nothing], names=names)
        rows = total.reshape(-1, 4096)
        at = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(at), pa.int64())] * 4, pa.array(at, pa.int64()), pa.array([rows[k].tobytes() for k in at], pa.binary())], names=names)

    return scan


def _summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(4096, dtype=np.uint64)
    for batch in batches:
        for c in batch.column("counters").to_pylist():
            total += np.frombuffer(c, np.uint32)
    counters = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32).tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([counters], pa.binary())], names=["row", "counters"])


def frequency_sketch(rows: DataFrame, size: int) -> np.ndarray:
    """How often tokens occur over all documents, by the leading bits of their hash; uint32 of fixed size.

    Rows of counters are summed in two steps, each streaming its group, so memory is one row.
    """
    some = rows.withColumn("part", F.pmod(F.xxhash64("counters"), F.lit(16))).groupBy("row", "part").applyInArrow(_summed, "row long, counters binary")
    out = np.zeros((size // 4096, 4096), dtype=np.uint32)
    for r in some.groupBy("row").applyInArrow(_summed, "row long, counters binary").coalesce(8).toLocalIterator():
        out[r["row"]] = np.frombuffer(r["counters"], np.uint32)
    return out.reshape(-1)


def prefix_lengths(n: int, counts: np.ndarray, per_cent: int, most: int = MOST) -> tuple[int, int]:
    """(l, prefix length) of least estimated cost, for a set whose tokens' counts are in order."""
    base = n - needed(n, per_cent)
    best, out = None, (1, base + 1)
    scanned = float(counts[:base].sum())
    for ell in range(1, most + 1):
        if base + ell > n:
            break
        scanned += float(counts[base + ell - 1])
        cost = scanned + scanned / ell * min(1.0, n / 64)
        if best is None or cost < best:
            best, out = cost, (ell, base + ell)
    return out


def _postings(n: int, per_cent: int, shared):
    least = next(k for k in range(1, 10_000) if 100 * k // per_cent > k)  # smaller sets link with equal ones only

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        sketch = shared.value
        own, offsets = shingle_sets(batch.column("text"), n)
        counts = sketch[_counter_of(own, len(sketch))].astype(np.int64)
        noise = int(sketch.mean())
        docs, tokens, sizes, ells, places = [], [], [], [], []
        for k, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
            size = int(b - a)
            if size < least:
                continue
            order = np.lexsort((own[a:b], counts[a:b]))
            ell, length = prefix_lengths(size, np.maximum(1, counts[a:b][order] - noise), per_cent)
            docs.append(np.full(length, k))
            tokens.append(own[a:b][order[:length]])
            sizes.append(np.full(length, size))
            ells.append(np.full(length, ell))
            places.append(np.arange(length))
        flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        ids = batch.column("doc_id").take(pa.array(flat(docs, np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(flat(tokens, np.uint64).view(np.int64)), ids, pa.array(flat(sizes, np.int32)), pa.array(flat(ells, np.int8)), pa.array(flat(places, np.int32))], names=["token", "id", "n", "ell", "at"])

    return scan


def _set_rows(n: int):
    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, offsets = shingle_sets(batch.column("text"), n)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())], names=["id", "tokens"])

    return scan


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size of intersection and union of each pair."""
    for batch in batches:
        inter, union = [], []
        for x, y in zip(batch.column("tokens").to_pylist(), batch.column("tokens2").to_pylist(), strict=True):
            # both are sorted and distinct
            both = np.frombuffer(x + y, np.uint64).copy()
            both.sort(kind="stable")
            same = int((both[1:] == both[:-1]).sum())
            inter.append(same)
            union.append(len(both) - same)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(inter, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "inter", "union"])


class _Verifier:
    """Sets of the documents concerned only, computed from their texts, and the pairs' similarities."""

    def __init__(self, docs: DataFrame, n: int):
        self.docs, self.n = docs, n

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, tokens) of the ids: the texts are scanned with the ids broadcast where these are proven few, else shuffled."""
        docs = self.docs.join(hinted(stored(ids), BROADCAST_ROWS), F.col("doc_id") == F.col("id")).select("doc_id", "text")
        return stored(arrow_map(docs, _set_rows(self.n), "id long, tokens binary", limit=PIECE).dropDuplicates(["id"]))

    def measured(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(a, b, inter, union) of the pairs, and the sets of all their ids."""
        pairs = stored(pairs)
        sets = self.sets(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
        joined = pairs.join(sets.withColumnRenamed("id", "a"), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tokens2")), "b")
        return stored(joined.select("a", "b", "tokens", "tokens2").mapInArrow(tidied(_measure), "a long, b long, inter long, union long")), sets


def _differences(loose: int):
    """Of each set and its family's centre: the set's size and the tokens that one of both lacks, if they are alike enough."""

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sizes, delta = [], [], []
            for k, (x, c) in enumerate(zip(batch.column("tokens").to_pylist(), batch.column("centre").to_pylist(), strict=True)):
                both = np.sort(np.frombuffer(x + c, np.uint64))
                twice = np.flatnonzero(both[1:] == both[:-1])
                if 100 * len(twice) >= loose * (len(both) - len(twice)):
                    alone = np.ones(len(both), dtype=bool)
                    alone[twice] = alone[twice + 1] = False
                    keep.append(k)
                    sizes.append(len(x) // 8)
                    delta.append(both[alone].tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("family").take(at), pa.array(sizes, pa.int64()), pa.array(delta, pa.binary())], names=["id", "family", "n", "delta"])

    return differ


def families_of(edges: DataFrame, sets: DataFrame, loose: int = LOOSE, rounds: int = FAMILY_ROUNDS) -> DataFrame:
    """(id, family, n, delta) of the sets that a loose link (a, b) ties to the centre of a family, its smallest id."""
    open_, out = edges, None
    for k in range(rounds):
        tied = components(open_).withColumnRenamed("component", "family")
        centres = sets.select(F.col("id").alias("family"), F.col("tokens").alias("centre"))
        own = stored(tied.join(sets, "id").join(centres, "family").select("id", "family", "tokens", "centre").mapInArrow(tidied(_differences(loose)), "id long, family long, n long, delta binary"))
        out = own if out is None else out.unionByName(own)
        if k + 1 < rounds:
            taken = stored(own.select("id"))
            for c in ("a", "b"):
                open_ = open_.join(hinted(taken), F.col(c) == F.col("id"), "left_anti")
            open_ = stored(open_)
            if open_.isEmpty():
                break
    return stored(out)


def _block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The sets of one block of a family in one row."""
    delta = table["delta"].to_pylist()
    return pa.table({"family": [key[0].as_py()], "part": [key[1].as_py()], "ids": [np.asarray(table["id"], np.int64).tobytes()], "n": [np.asarray(table["n"], np.int64).tobytes()], "sizes": [np.array([len(t) // 8 for t in delta], np.int64).tobytes()], "delta": [b"".join(delta)]}, schema=pa.schema([("family", pa.int64()), ("part", pa.int64()), *((c, pa.binary()) for c in ("ids", "n", "sizes", "delta"))]))


def overlaps(x: np.ndarray, rows: np.ndarray, y: np.ndarray, columns: np.ndarray, n: int, m: int, cells: int = 8 << 20) -> np.ndarray:
    """Sizes of intersection [n, m] of two blocks of sets, given as tokens and the set of each.

    Only tokens that both blocks hold count; the product runs over so many of them at a time that
    the matrices stay within `cells`.
    """
    common = np.intersect1d(x, y)
    keep, keep2 = np.isin(x, common), np.isin(y, common)
    at, at2 = np.searchsorted(common, x[keep]), np.searchsorted(common, y[keep2])
    rows, columns = rows[keep], columns[keep2]
    order, order2 = np.argsort(at, kind="stable"), np.argsort(at2, kind="stable")
    at, rows, at2, columns = at[order], rows[order], at2[order2], columns[order2]
    out = np.zeros((n, m), dtype=np.float32)
    step = max(1, cells // max(n, m, 1))
    for start in range(0, len(common), step):
        a, b = np.searchsorted(at, [start, start + step])
        c, d = np.searchsorted(at2, [start, start + step])
        left, right = np.zeros((n, step), np.float32), np.zeros((m, step), np.float32)
        left[rows[a:b], at[a:b] - start] = 1
        right[columns[c:d], at2[c:d] - start] = 1
        out += left @ right.T
    return out


def _compare(per_cent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, n, size = (np.frombuffer(r[c], np.int64) for c in ("ids", "n", "sizes"))
                ids2, n2, size2 = (np.frombuffer(r[c + "2"], np.int64) for c in ("ids", "n", "sizes"))
                x, y = np.frombuffer(r["delta"], np.uint64), np.frombuffer(r["delta2"], np.uint64)
                both = np.rint(overlaps(x, np.repeat(np.arange(len(ids)), size), y, np.repeat(np.arange(len(ids2)), size2), len(ids), len(ids2))).astype(np.int64)
                # tokens that one of both lacks, from what each has apart from the centre
                apart = size[:, None] + size2[None, :] - 2 * both
                same = (n[:, None] + n2[None, :] - apart) // 2
                links = 100 * same >= per_cent * (same + apart)
                if r["part"] == r["part2"]:
                    np.fill_diagonal(links, False)
                i, j = links_forest(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), pa.array(ids2[j], pa.int64())], names=["a", "b"])

    return compare


def family_links(families: DataFrame, per_cent: int, tasks: int) -> DataFrame:
    """A spanning forest of the links within each family (id, family, n, delta), from all pairs of its sets."""
    sizes = stored(families.groupBy("family").agg(F.greatest(F.ceil(F.sum(F.length("delta") / 8) / BLOCK), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).cast("long").alias("parts"), F.count(F.lit(1)).alias("members")).filter("members > 1"))
    dealt = families.join(sizes, "family").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    blocks = stored(dealt.groupBy("family", "part").applyInArrow(_block, "family long, part long, ids binary, n binary, sizes binary, delta binary"))
    names = [c for c in blocks.columns if c != "family"]
    other = blocks.select("family", *(F.col(c).alias(c + "2") for c in names))
    # a block against itself needs no join, but to be dealt out by number: products cost, not bytes
    alone = blocks.select("*", *(F.col(c).alias(c + "2") for c in names if c == "part")).repartition(tasks, "family", "part")
    alone = alone.select("*", *(F.col(c).alias(c + "2") for c in names if c != "part"))
    # each other pair is a row of its own, however many blocks a family has
    keys = stored(blocks.select("family", "part").join(other.select("family", "part2"), "family").filter("part < part2"))
    pairs = keys.join(blocks, ["family", "part"]).join(other, ["family", "part2"])
    schema = "a long, b long"
    return stored(alone.mapInArrow(tidied(_compare(per_cent)), schema).unionByName(pairs.mapInArrow(tidied(_compare(per_cent)), schema)))


def _sizes_fit(per_cent: int):
    return (F.col("n") * 100 >= F.col("n2") * per_cent) & (F.col("n2") * 100 >= F.col("n") * per_cent)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, per_cent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id: smallest id reachable by links, itself included."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    size = sketch_size(docs)
    scanned = stored(docs.mapInArrow(tidied(_sets(n, size)), _SETS))
    sets = scanned.filter("row is null").select("doc_id", "n", "key", "key2")
    linkable = sets.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = stored(linkable.groupBy("key", "key2").agg(F.min("doc_id").alias("least")))
    shared = spark.sparkContext.broadcast(frequency_sketch(scanned.filter("row is not null").select("row", "counters"), size))
    every = arrow_map(docs.filter("doc_id is not null"), _postings(n, per_cent, shared), "token long, id long, n int, ell byte, at int", limit=PIECE)
    # only one document of each class takes part
    whole = stored(every.join(classes.select(F.col("least").alias("id")).distinct(), "id", "left_semi").distinct())
    seen = stored(whole.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("token"))
    postings = stored(whole.join(seen, "token"))
    dropped(whole, seen)
    verifier = _Verifier(docs, n)
    # near copies meet through two pivots of each bucket: the least set, and one by hash
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / per_cent))
    of = lambda order: F.min_by(F.struct(F.col("id").alias("id2"), F.col("n").alias("n2")), order)
    pivots = stored(postings.groupBy("token", band.alias("band")).agg(F.count(F.lit(1)).alias("held"), F.array(of(F.struct("n", "id")), of(F.struct(F.xxhash64("id").alias("h"), F.col("id")))).alias("pivots")).filter(F.col("held") > FEW).drop("held"))
    stars = postings.withColumn("band", band).join(pivots, ["token", "band"]).select("id", "n", F.explode("pivots").alias("p")).select("id", "n", "p.*").filter("id <> id2").filter(_sizes_fit(per_cent))
    pairs = stars.groupBy(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.max(F.greatest("n", "n2")).alias("big"))
    # a hint only: near copies share more than one prefix token, and what this leaves out waits for the exact step
    measured, of_pairs = verifier.measured(pairs.filter((F.col("shared") > 1) | (F.col("big") < 40)).select("a", "b"))
    families = families_of(measured.filter(100 * F.col("inter") >= LOOSE * F.col("union")).select("a", "b"), of_pairs)
    links = family_links(families, per_cent, max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    families = families.select("id", "family")
    dropped(of_pairs, pivots)
    # exact for the rest: pairs of different families that share as many prefix tokens as they must
    labelled = postings.join(families, "id", "left").withColumn("family", F.coalesce("family", "id"))
    several = stored(labelled.groupBy("token").agg(F.min("family").alias("c1"), F.max("family").alias("c2")).filter("c1 <> c2").select("token"))
    open_ = stored(labelled.join(several, "token"))
    dropped(postings)
    other = open_.select("token", *(F.col(c).alias(c + "2") for c in ("id", "n", "ell", "at", "family")))
    overlap = F.ceil(F.lit(per_cent) * (F.col("n") + F.col("n2")) / F.lit(100 + per_cent))
    alike = (F.col("id") < F.col("id2")) & (F.col("family") != F.col("family2")) & _sizes_fit(per_cent) & (F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) >= overlap - F.least("at", "at2"))
    must = F.least(F.col("ell") + overlap - F.ceil(F.col("n") * per_cent / 100), F.col("ell2") + overlap - F.ceil(F.col("n2") * per_cent / 100))
    pairs = open_.join(other, "token").filter(alike).groupBy(F.col("id").alias("a"), F.col("id2").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.first(must).alias("must")).filter("shared >= must").select("a", "b")
    rest, of_rest = verifier.measured(pairs)
    dropped(open_, of_rest)
    links = links.unionByName(rest.filter(100 * F.col("inter") >= per_cent * F.col("union")).select("a", "b"))
    found = components(links).select(F.col("id").alias("least"), "component")
    of_class = stored(classes.join(found, "least", "left").select("key", "key2", F.coalesce("component", "least").alias("component")))
    out = sets.join(of_class, ["key", "key2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))

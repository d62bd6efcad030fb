"""Embedding near-dedup by an inverted multi-index.

Vectors are scaled to length 1 and cut in two halves, each with a codebook of its own; a vector's
cell is its pair of nearest codewords.  From each cell that holds vectors, multi-sequence traversal
visits cells in order of summed codeword distances, as many as bring the recall to its target:
`recall` of the links among the sampled vectors, and `turned` of copies of sampled vectors turned
by the threshold's angle, the farthest that a link can be, whatever links the sample holds.  Two cells
are compared if either visits the other, so each pair is met once, and every pair found is verified
in double precision.

Equal vectors form a class that is compared once; links count all of its members.  Neighbouring
cells are packed into blocks of about `block` vectors, and a cell that holds more (a third of all
rows, say) is cut into many.  A block meets the cells that it must be compared with one after another
in a task's stream, so memory is the block and one cell's part; of a cell only that is shipped, once
for each block.  A block with many cells to meet is dealt to many tasks.  Each gives sums of links and
a spanning forest, never pairs.

The codebooks are fitted on at most `sample` vectors, those of least hash of their values; all vectors
are indexed.  Codewords grow with the vectors, so that a cell holds `PER_CELL` of them on average, up
to `MOST_CODEWORDS` in each half; beyond PER_CELL * MOST_CODEWORDS^2 vectors (168 million) cells grow.
Traversal runs on the executors; what the driver holds (codebooks, counts of cells) is bounded by
codewords squared.

Vectors of different lengths link with nothing of each other; each length has an index of its own.
Vectors that are null, zero, or hold nulls or non-finite components link with nothing, and so do rows
with null ids.  Each row counts as a vector, also where rows repeat an id: every such row gets the
result of its own vector.  Ties at the threshold count as links; of components that tie for the
smallest id, both carry it.  An empty table gives an empty result.  Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, small_batches, stored, tidied
from .components import components, links_forest

THRESHOLD, RECALL, TURNED, SAMPLE, BLOCK = 0.9, 0.999, 0.995, 16_384, 3072
#: Vectors that a cell shall hold on average, and the most codewords of a half.
PER_CELL, MOST_CODEWORDS = 160, 1024
#: Cells that a block meets in one task, about.
MEETS = 256


def units(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(kind):
    """Of each row: a 128-bit key of its vector and its values, null where it links with nothing."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, key2, raw = [], [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                x = np.array(v, dtype=kind) if i is not None and v and None not in v else None
                if x is not None and np.isfinite(x).all() and x.any():
                    d = xxhash.xxh3_128_intdigest((x + 0.0).tobytes())
                    key.append((d & (1 << 64) - 1) - (1 << 63))
                    key2.append((d >> 64) - (1 << 63))
                    raw.append(x.tobytes())
                else:
                    key.append(None)
                    key2.append(None)
                    raw.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(key, pa.int64()), pa.array(key2, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "key", "key2", "raw"])

    return keys


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means of the rows, from a spread of them; deterministic."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    own = np.unique(x, axis=0)
    k = min(k, len(own))
    words = own[np.linspace(0, len(own) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, words)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)[:, None]
        words = np.where(n > 0, sums / np.maximum(n, 1), words)
    return words


def nearest(x: np.ndarray, words: np.ndarray, rows: int = 4096) -> np.ndarray:
    length = (words**2).sum(1)[None, :]
    return np.concatenate([np.argmin(length - 2 * x[k : k + rows] @ words.T, axis=1) for k in range(0, max(1, len(x)), rows)])


def multi_sequence(first: np.ndarray, second: np.ndarray, most: int, filled: np.ndarray) -> list[tuple[int, int]]:
    """The filled cells (i, j) in order of first[i] + second[j], at most so many."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out = [(float(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}, []
    while heap and len(out) < most:
        _, i, j = heapq.heappop(heap)
        cell = (int(a[i]), int(b[j]))
        if filled[cell]:
            out.append(cell)
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (float(first[a[p]] + second[b[q]]), p, q))
    return out


class MultiIndex:
    """Two codebooks and how many cells to visit."""

    def __init__(self, sample: np.ndarray, codewords: int, filled=None):
        half = (sample.shape[1] + 1) // 2
        self.half = half
        self.words = [codebook(sample[:, :half], codewords), codebook(sample[:, half:], codewords)]
        self.apart = [((w[:, None, :] - w[None, :, :]) ** 2).sum(-1) for w in self.words]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.stack([nearest(x[:, : self.half], self.words[0]), nearest(x[:, self.half :], self.words[1])], axis=1)

    def visits(self, sample: np.ndarray, threshold: float, recall: float, turned: float, filled: np.ndarray, most: int = 1000) -> int:
        """Cells to visit so that the targets are reached: on links among the sample, and on turned copies."""
        x = sample[np.linspace(0, len(sample) - 1, min(most, len(sample))).astype(int)]
        near = x @ sample.T
        found = np.argwhere((near >= threshold) & (near < 1 - 1e-12))
        rng = np.random.default_rng(7)
        turn = rng.normal(size=x.shape)
        turn -= (turn * x).sum(1, keepdims=True) * x
        turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-12)
        angle = np.arccos(threshold)
        out = 1
        for a, b, target in ((x[found[:, 0]], sample[found[:, 1]], recall), (x, np.cos(angle) * x + np.sin(angle) * turn, turned)):
            if len(a):
                out = max(out, int(np.quantile(self._ranks(self.cells(a), self.cells(b), filled), target, method="higher")))
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray, filled: np.ndarray) -> np.ndarray:
        """How many cells must be visited until the pair meets, in the better of both directions."""
        out = np.ones(len(a), dtype=np.int64)
        for k in np.flatnonzero((a != b).any(axis=1)):
            both = []
            for p, q in ((a[k], b[k]), (b[k], a[k])):
                d = self.apart[0][p[0]][:, None] + self.apart[1][p[1]][None, :]
                both.append(int((filled & (d <= d[q[0], q[1]] + 1e-12)).sum()))
            out[k] = max(1, min(both))
        return out


def _forest(n: int, parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join a[k] and b[k] in the forest `parent`, for all k; roots are the smallest."""
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)


def _packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One block in one row, in order of cell."""
    table = table.sort_by([("cell", "ascending"), ("node", "ascending")])
    return pa.table({"block": [key[0].as_py()], **{name: [np.asarray(table[of], np.int64).tobytes()] for name, of in (("cells", "cell"), ("ids", "node"), ("many", "many"))}, "raw": [b"".join(table["raw"].to_pylist())]}, schema=pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("cells", "ids", "many", "raw"))]))


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The part of each cell that a block holds, one row each."""
    for batch in batches:
        for r in batch.to_pylist():
            cells = np.frombuffer(r["cells"], np.int64)
            width = len(r["raw"]) // len(cells)
            heads = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
            tails = np.append(heads[1:], len(cells))
            cut = lambda data, size: pa.array([data[a * size : b * size] for a, b in zip(heads.tolist(), tails.tolist(), strict=True)], pa.binary())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(cells[heads]), pa.array(np.full(len(heads), r["block"])), cut(r["ids"], 8), cut(r["many"], 8), cut(r["raw"], width)], names=["cell2", "block2", "ids", "many", "raw"])


def _traversed(shared, visits: int):
    """(cell, cell2) of the cells that each cell visits."""

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart, filled = shared.value
        k2 = filled.shape[1]
        for batch in batches:
            for c in batch.column("cell").to_pylist():
                near = [p * k2 + q for p, q in multi_sequence(apart[0][c // k2], apart[1][c % k2], visits, filled)]
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(near), pa.int64()), pa.array(near, pa.int64())], names=["cell", "cell2"])

    return traverse


def _compare(threshold: float, kind, rows: int = 256):
    """Links of a block and the cells that follow it in the stream: for each vector that has any, their number and the smallest node reached."""

    def unpack(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(r["ids"], np.int64)
        return ids, np.frombuffer(r["many"], np.int64), units(np.frombuffer(r["raw"], kind).reshape(len(ids), -1))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = m = x = cells = None
        for r in (r for batch in batches for r in batch.to_pylist()):
            if r["cells"] is not None:
                a, m, x = unpack(r)
                cells = np.frombuffer(r["cells"], np.int64)
                continue
            b, m2, y = unpack(r)
            same = r["block"] == r["block2"]
            ids = np.unique(np.concatenate([a, b]))
            at, at2 = np.searchsorted(ids, a), np.searchsorted(ids, b)
            total, parent = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
            for cell in r["meets"]:
                first, end = np.searchsorted(cells, [cell, cell + 1])
                itself = same and cell == r["cell2"]
                for p in range(first, end, rows):
                    q = min(end, p + rows)
                    links = x[p:q] @ y.T >= threshold
                    if itself:
                        links &= a[p:q, None] != b[None, :]
                    i, j = np.nonzero(links)
                    if len(i):
                        np.add.at(total, at[p + i], m2[j])
                        if not itself:
                            np.add.at(total, at2[j], m[p + i])
                        # one link for each row and each column, and those that these don't imply
                        roots = links_forest(links)
                        _forest(len(ids), parent, at[p + roots[0]], at2[roots[1]])
            for k in range(len(parent)):
                parent[k] = parent[parent[k]]
            hit = np.flatnonzero(total)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit], pa.int64()), pa.array(total[hit], pa.int64()), pa.array(ids[parent[hit]], pa.int64())], names=["id", "n", "root"])

    return compare


def blocks_of(counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: neighbours share one until it is full, a cell over that is cut."""
    first, parts = np.zeros(len(counts), dtype=np.int64), np.maximum(1, -(-counts // block))
    at, room = -1, 0
    for k, (n, many) in enumerate(zip(counts.tolist(), parts.tolist(), strict=True)):
        if n > room:
            first[k] = at + 1
            at, room = at + many, block - n if many == 1 else 0
        else:
            first[k] = at
            room -= n
    return first, parts


def links_of(classes: DataFrame, dim: int, kind, total: int, threshold: float, recall: float, turned: float, sample: int, block: int) -> DataFrame:
    """(id, n, root) of the classes (node, key, many, raw) of vectors of `dim` bytes: sums of links and a spanning forest, in parts."""
    spark = classes.sparkSession
    few = classes.filter(F.col("key").cast("double") <= (2.0**64 * min(1.0, 1.2 * sample / max(1, total)) - 2.0**63)).orderBy("key").limit(sample).select("raw").collect()
    x = units(np.array([np.frombuffer(r["raw"], kind) for r in few]).reshape(len(few), -1)) if few else np.zeros((0, dim))
    if len(x) < 2:
        x = units(np.array([np.frombuffer(r["raw"], kind) for r in classes.select("raw").limit(2).collect()]))
    own = MultiIndex(x, int(max(1, min(MOST_CODEWORDS, (total / PER_CELL) ** 0.5))))
    k2 = len(own.words[1])
    shared = spark.sparkContext.broadcast(own)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = shared.value.cells(units(np.array([np.frombuffer(u, kind) for u in batch.column("raw").to_pylist()])))
                yield pa.RecordBatch.from_arrays([pa.array(c[:, 0] * k2 + c[:, 1], pa.int64()), *(batch.column(n) for n in ("node", "many", "raw"))], names=["cell", "node", "many", "raw"])

    placed = stored(classes.select("node", "many", "raw").mapInArrow(tidied(cells), "cell long, node long, many long, raw binary"))
    held = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy("cell").toPandas()
    number, counts = held["cell"].to_numpy(), held["n"].to_numpy()
    filled = np.zeros((len(own.words[0]), k2), dtype=bool)
    filled.reshape(-1)[number] = True
    visits = own.visits(x, threshold, recall, turned, filled)
    first, parts = blocks_of(counts, block)
    where = stored(spark.createDataFrame(pd.DataFrame({"cell": number, "first": first, "parts": parts})))
    index = spark.sparkContext.broadcast((own.apart, filled))
    # cells are dealt out, as traversal costs and cells are few bytes
    seen = where.select("cell").repartition(max(8, min(1024, len(number) // 32)), "cell").mapInArrow(_traversed(index, visits), "cell long, cell2 long")
    pairs = seen.select(F.least("cell", "cell2").alias("cell"), F.greatest("cell", "cell2").alias("cell2")).distinct()
    both = pairs.join(where, "cell").join(where.select(F.col("cell").alias("cell2"), F.col("first").alias("first2"), F.col("parts").alias("parts2")), "cell2")
    p = F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("block")
    q = F.explode(F.sequence("first2", F.col("first2") + F.col("parts2") - 1)).alias("block2")
    plan = both.select("cell", "cell2", p, "first2", "parts2").select("cell", "cell2", "block", q).filter("cell <> cell2 or block <= block2")
    plan = stored(plan.groupBy("block", "cell2", "block2").agg(F.collect_list("cell").alias("meets")))
    slices = plan.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / MEETS).cast("long").alias("slices"))
    plan = stored(plan.join(slices, "block").withColumn("slice", F.pmod(F.xxhash64("cell2", "block2"), F.col("slices"))).drop("slices"))
    packed = placed.join(where, "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts"))).drop("first", "parts")
    blocks = stored(packed.groupBy("block").applyInArrow(_packed, "block long, cells binary, ids binary, many binary, raw binary"))
    chunks = stored(blocks.mapInArrow(_by_cell, "cell2 long, block2 long, ids binary, many binary, raw binary"))
    nothing = [F.lit(None).cast("array<long>").alias("meets"), F.lit(None).cast("long").alias("cell2"), F.lit(None).cast("long").alias("block2")]
    heads = plan.select("block", "slice").distinct().join(blocks, "block").select("block", "slice", "cells", "ids", "many", "raw", *nothing)
    rest = plan.join(chunks, ["cell2", "block2"]).select("block", "slice", F.lit(None).cast("binary").alias("cells"), "ids", "many", "raw", "meets", "cell2", "block2")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * len(number) * visits // (MEETS * 8) // max(1, block // PER_CELL))
    stream = heads.unionByName(rest).repartition(tasks, "block", "slice").sortWithinPartitions("block", "slice", F.col("cells").isNull())
    out = stored(stream.mapInArrow(tidied(_compare(threshold, kind)), "id long, n long, root long"))
    dropped(placed, blocks, chunks, plan)
    return out


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, turned: float = TURNED, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    small_batches(vectors.sparkSession)
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    vectors = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<float>" if single else "array<double>").alias("vector"))
    keyed = stored(vectors.mapInArrow(tidied(_keys(kind)), "vec_id long, key long, key2 long, raw binary"))
    classes = keyed.filter("raw is not null").groupBy("key", "key2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("many"), F.first("raw").alias("raw"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    lengths = [(r["dim"], r["n"]) for r in classes.groupBy(F.length("raw").alias("dim")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy("dim").toLocalIterator()]
    found = None
    for dim, n in lengths:
        own = links_of(classes.filter(F.length("raw") == dim).select("node", "key", "many", "raw"), dim // kind().itemsize, kind, n, threshold, recall, turned, sample, block)
        found = own if found is None else found.unionByName(own)
    nodes = classes.select("key", "key2", "node", "least", "many")
    if found is None:
        nodes = nodes.withColumn("n", F.lit(0).cast("long")).withColumn("component_id", F.col("least"))
    else:
        links = found.groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n"))
        joined = stored(nodes.join(links, "node", "left").join(components(found.select("id", "root")).withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")))
        smallest = stored(joined.groupBy("component").agg(F.min("least").alias("component_id")))
        nodes = joined.join(smallest, "component")
    nodes = stored(nodes.select("key", "key2", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).cast("long").alias("n_links"), "component_id"))
    out = keyed.select("vec_id", "key", "key2").join(nodes, ["key", "key2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

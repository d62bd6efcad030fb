"""Substring dedup by repeated-phrase automata.

A window of `window` consecutive words is removed from a document where the same window starts in
a document of smaller id.  All windows of all documents are judged, but few are ever shuffled:

1. Each document's phrases of `PHRASE` words are winnowed: of each window, the phrase of least hash
   is its anchor, so equal windows have equal anchors.  Only distinct anchors are shuffled.  Documents
   with the same words form a class; one of smallest id stands for it, and the others lose every
   word that lies in a window (all of them).
2. Recurring passages are confirmed: windows whose anchor occurs in two classes are counted by a
   128-bit hash, and those of two documents belong to the document of smallest id.  Its runs of such
   windows are passages; their words, and where their anchors stand in them, are all that goes on.
3. Passages are sharded by their document, in shards of bounded bytes.  Each shard's phrases are
   compiled to an Aho-Corasick automaton, and every document that has a window in common with a
   passage of the shard is streamed through it.  The automaton alone says where phrases stand.  From
   each place, document and passage are compared word by word in both directions; a common run of
   `window` words or more is removed.

What is removed is so proven on the words themselves; hashes only say what to look at.  Shards go
where their documents are in parts of bounded bytes, so a passage that a third of all documents share
is compiled in as many tasks as its documents fill.  The shuffles before carry hashes, not text.
Aggregates combine before they shuffle; joins on an anchor or window that many documents share have
one row per key on the other side and can be split.

Nulls and texts under `window` words lose nothing.  Rows with a null id lose nothing and take
nothing from others.  Rows of the same id never take from each other; a row that repeats another
wholly has the same result.  Texts of any length are read whole.  An empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, digest, dropped, raw_bytes, stored, tidy
from .shingles import inside, mixed, ngrams, sliding_min, word_hashes

WINDOW, PHRASE = 50, 8
#: Bytes of text hashed at once; the arrays take some 50 times as much.
PIECE = 1 << 19
#: Bytes up to which the lists of concerned documents are broadcast.
BROADCAST_BYTES = 48 << 20
#: Bytes of the passages of one automaton, and words of the documents that meet it in one task, about.
SHARD, PACK = 2 << 20, 400_000
#: Tasks of that step at most, whatever the number of parts; more parts then share a task, one after another.
MOST_TASKS = 50_000


#: Makes a second, independent hash of each word.
_SECOND = np.uint64(0xA0761D6478BD642F)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _scan(window: int, phrase: int):
    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("text")
        h, counts = word_hashes(column)
        anchors = sliding_min(ngrams(h, phrase), window - phrase + 1)
        starts, text = inside(counts, window)
        own = anchors[starts]
        order = np.lexsort((own, text))
        own, text = own[order], text[order]
        new = np.ones(len(own), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
        own, text = own[new], text[new]
        offsets = np.searchsorted(text, np.arange(len(counts) + 1)).astype(np.int32)
        whole, key, key2 = [], [], []
        for raw in raw_bytes(column):
            words = b" ".join((raw or b"").split())
            whole.append(digest(words))
            k = xxhash.xxh3_128_intdigest(words)
            key.append((k & (1 << 64) - 1) - (1 << 63))
            key2.append((k >> 64) - (1 << 63))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(counts), pa.array(whole, pa.string()), pa.array(key, pa.int64()), pa.array(key2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(own)))], names=["doc_id", "row", "n_words", "whole", "key", "key2", "anchors"])

    return scan


def _candidates(window: int, phrase: int):
    """Hash and place of each window whose anchor recurs."""

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, counts = word_hashes(batch.column("text"))
        anchors = sliding_min(ngrams(h, phrase), window - phrase + 1)
        whole = ngrams(h, window)
        other = ngrams(mixed(h ^ _SECOND), window)
        starts, text = inside(counts, window)
        lists = batch.column("recurring")
        # per document: is the window's anchor one of its own recurring ones
        ends = np.searchsorted(text, np.arange(len(counts) + 1))
        good = np.zeros(len(starts), dtype=bool)
        for d in range(len(counts)):
            a, b = ends[d], ends[d + 1]
            good[a:b] = np.isin(_signed(anchors[starts[a:b]]), np.asarray(lists[d].values, dtype=np.int64))
        starts, text = starts[good], text[good]
        at = pa.array(text, pa.int64())
        spots = starts - (np.cumsum(counts) - counts)[text]
        return pa.RecordBatch.from_arrays([pa.array(_signed(whole[starts])), pa.array(_signed(other[starts])), batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(spots, pa.int32()), pa.array(counts[text], pa.int32())], names=["w", "w2", "doc_id", "row", "spot", "n"])

    return find


def _runs(batches):
    """Of each document's recurring windows: runs of those that it owns, and whose the others are."""
    for batch in batches:
        own, others = [], []
        for doc, spots in zip(batch.column("doc_id").to_pylist(), batch.column("spots"), strict=True):
            spot, least = (np.asarray(x) for x in spots.values.flatten())
            x = np.unique(spot[least == doc])
            heads = np.flatnonzero(np.append(True, np.diff(x) > 1)[: len(x)])
            tails = np.append(heads[1:], len(x))[: len(heads)] - 1
            own.append(np.stack([x[heads], x[tails] + 1], axis=1).ravel() if len(x) else x)
            others.append(np.unique(least[least < doc]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("n"), pa.array(own, pa.list_(pa.int32())), pa.array(others, pa.list_(pa.int64()))], names=["doc_id", "row", "n", "own", "owners"])


def _passages(window: int, phrase: int):
    """The words of each run of windows that a document owns, and the places of its anchors in them."""

    def passages(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, counts = word_hashes(batch.column("text"))
        grams = ngrams(h, phrase)
        anchors = sliding_min(grams, window - phrase + 1)
        begins = np.cumsum(counts) - counts
        ids, texts, places = [], [], []
        for doc, raw, begin, runs in zip(batch.column("doc_id").to_pylist(), raw_bytes(batch.column("text")), begins.tolist(), batch.column("own").to_pylist(), strict=True):
            words = (raw or b"").split()
            for a, b in zip(runs[::2], runs[1::2], strict=True):
                inner = grams[begin + a : begin + b + window - phrase]
                ids.append(doc)
                texts.append(b" ".join(words[a : b + window - 1]).decode("utf-8"))
                places.append(np.flatnonzero(np.isin(inner, anchors[begin + a : begin + b])))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(places, pa.list_(pa.int32()))], names=["owner", "passage", "places"])

    return passages


class Shard:
    """The automaton of a shard's phrases: passages as (owner, words, places of phrases)."""

    def __init__(self, passages: list[tuple[int, list[str], list[int]]], phrase: int):
        self.passages = passages
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, words, places) in enumerate(passages):
            for at in places:
                found.setdefault(" ".join(words[at : at + phrase]), []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for text, where in found.items():
            # a space at both ends, so that words match as wholes
            self.automaton.add_word(f" {text} ", (len(text) + 2, where))
        if found:
            self.automaton.make_automaton()

    def repeats(self, doc: int, words: list[str], window: int) -> list[int]:
        """Starts and ends of the runs of `window` words or more that the document shares with passages of smaller ids."""
        if not len(self.automaton):
            return []
        text = " " + " ".join(words) + " "
        begins = np.cumsum([0, *(len(w) + 1 for w in words)])
        hits = [(last - size + 1, where) for last, (size, where) in self.automaton.iter(text)]
        out: list[tuple[int, int]] = []
        seen: dict[tuple[int, int], int] = {}
        for spot, (_, where) in zip(np.searchsorted(begins, [h[0] for h in hits]).tolist(), hits, strict=True):
            for k, at in where:
                owner, said, _ = self.passages[k]
                if owner >= doc or seen.get((k, spot - at), -1) > spot:
                    continue
                start, end = common_run(words, spot, said, at)
                seen[k, spot - at] = end
                if end - start >= window:
                    out.append((start, end))
        merged: list[int] = []
        for start, end in sorted(out):
            if merged and start <= merged[-1]:
                merged[-1] = max(merged[-1], end)
            else:
                merged += [start, end]
        return merged


def common_run(x: list[str], i: int, y: list[str], j: int, step: int = 64) -> tuple[int, int]:
    """Start and end in x of the longest run of equal words through x[i] and y[j]."""
    end, most = 0, min(len(x) - i, len(y) - j)
    while end < most and x[i + end : i + end + step] == y[j + end : j + end + step]:
        end = min(most, end + step)
    while end < most and x[i + end] == y[j + end]:
        end += 1
    back, most = 0, min(i, j)
    while back < most and x[max(0, i - back - step) : i - back][-min(step, most - back) :] == y[max(0, j - back - step) : j - back][-min(step, most - back) :]:
        back = min(most, back + step)
    while back < most and x[i - back - 1] == y[j - back - 1]:
        back += 1
    return i - back, i + end


def _located(window: int, phrase: int):
    """One part of a shard: its passages and some documents, the documents streamed through the automaton."""

    def locate(table: pa.Table) -> pa.Table:
        texts, places = table["text"].to_pylist(), table["places"].to_pylist()
        ids, rows = table["doc_id"].to_pylist(), table["row"].to_pylist()
        shard = Shard([(ids[k], texts[k].split(" "), p) for k, p in enumerate(places) if p is not None], phrase)
        docs = [k for k, p in enumerate(places) if p is None]
        spans = [shard.repeats(ids[k], [w.decode("utf-8") for w in texts[k].encode("utf-8").split()], window) for k in docs]
        del shard, texts
        tidy()
        return pa.table({"doc_id": pa.array([ids[k] for k in docs], pa.int64()), "row": pa.array([rows[k] for k in docs], pa.int64()), "spans": pa.array(spans, pa.list_(pa.int32()))})

    return locate


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    kept, removed = [], []
    for raw, spans in zip(raw_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
        words = (raw or b"").split()
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(gone, spans[::2], 1)
        np.add.at(gone, spans[1::2], -1)
        gone = np.cumsum(gone[:-1]) > 0
        removed.append(int(gone.sum()))
        kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode("utf-8"))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(removed, pa.int64()), pa.array([digest(k.encode()) for k in kept], pa.string()), pa.array(kept, pa.string())], names=["doc_id", "row", "n_removed", "kept_sha256", "kept"])


def _keyed(docs: DataFrame, few: DataFrame, size: int, most: int) -> DataFrame:
    """The texts of the documents in `few`: broadcast where the lists' size is proven small, else shuffled."""
    return docs.join(F.broadcast(few) if size <= most else few, ["doc_id", "row"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE, texts: bool = False, broadcast_bytes: int = BROADCAST_BYTES, shard: int = SHARD, pack: int = PACK) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row; with texts also `kept`, the words that are left (null: unchanged)."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).withColumn("row", F.xxhash64("text"))
    meta = stored(arrow_map(docs, _scan(window, phrase), "doc_id long, row long, n_words long, whole string, key long, key2 long, anchors array<long>", limit=PIECE))
    classes = meta.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= window)).groupBy("key", "key2").agg(F.min("doc_id").alias("least"))
    # stored, so that the join sees two plain shuffles and can split a class that holds a third of all rows
    meta2 = meta.join(stored(classes), ["key", "key2"], "left")
    own = stored(meta2.filter(F.col("doc_id") == F.col("least")).select("doc_id", "row", "key", "key2", F.explode("anchors").alias("anchor")).distinct())
    of = F.struct("key", "key2")
    recurring = own.groupBy("anchor").agg(F.min(of).alias("a"), F.max(of).alias("b")).filter("a <> b").select("anchor")
    lists = stored(own.join(stored(recurring), "anchor").groupBy("doc_id", "row").agg(F.collect_list("anchor").alias("recurring")))
    dropped(own)
    size = lists.agg(F.sum(8 * F.size("recurring") + 64)).first()[0] or 0
    windows = stored(arrow_map(_keyed(docs, lists, size, broadcast_bytes), _candidates(window, phrase), "w long, w2 long, doc_id long, row long, spot int, n int", limit=PIECE))
    # confirmed: windows of two documents, with the document that owns them
    least = windows.groupBy("w", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("w", "w2", "least")
    spots = windows.join(stored(least), ["w", "w2"]).groupBy("doc_id", "row").agg(F.collect_list(F.struct("spot", "least")).alias("spots"), F.max("n").alias("n"))
    runs = stored(spots.mapInArrow(_runs, "doc_id long, row long, n int, own array<int>, owners array<long>"))
    dropped(windows, lists)
    owned = runs.filter(F.size("own") > 0).select("doc_id", "row", "own")
    size = owned.agg(F.sum(4 * F.size("own") + 64)).first()[0] or 0
    passages = stored(arrow_map(_keyed(docs, owned, size, broadcast_bytes), _passages(window, phrase), "owner long, passage string, places array<int>", limit=PIECE))
    shards = -(-(passages.agg(F.sum(F.length("passage"))).first()[0] or 1) // shard)
    of_owner = lambda c: F.pmod(F.xxhash64(c), F.lit(shards))
    # which documents meet which shards, dealt in parts
    meets = stored(runs.filter(F.size("owners") > 0).select("doc_id", "row", "n", F.explode(F.array_distinct(F.transform("owners", of_owner))).alias("shard")))
    parts = stored(meets.groupBy("shard").agg(F.ceil(F.sum("n") / pack).cast("long").alias("parts")))
    routed = stored(meets.join(parts, "shard").select("doc_id", "row", "shard", F.pmod(F.xxhash64("doc_id", "row"), F.col("parts")).alias("part")))
    size = routed.count() * 40
    texts_of = _keyed(docs, routed, size, broadcast_bytes).select("shard", "part", "doc_id", "row", F.lit(None).cast("array<int>").alias("places"), "text")
    copies = passages.withColumn("shard", of_owner("owner")).join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("owner").alias("doc_id"), F.lit(0).cast("long").alias("row"), "places", F.col("passage").alias("text"))
    # as many tasks as there are parts, so that none meets several large ones
    groups = parts.agg(F.sum("parts")).first()[0] or 1
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * groups, MOST_TASKS))
    located = texts_of.unionByName(copies).repartition(tasks, "shard", "part").groupBy("shard", "part").applyInArrow(_located(window, phrase), "doc_id long, row long, spans array<int>")
    spans = stored(located.filter(F.size("spans") > 0).groupBy("doc_id", "row").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    dropped(passages, runs)
    size = spans.agg(F.sum(4 * F.size("spans") + 64)).first()[0] or 0
    cut = arrow_map(_keyed(docs, spans, size, broadcast_bytes), _cut, "doc_id long, row long, n_removed long, kept_sha256 string, kept string", limit=PIECE)
    if not texts:
        cut = cut.drop("kept")
    cut = cut.withColumnRenamed("n_removed", "r").withColumnRenamed("kept_sha256", "s").dropDuplicates(["doc_id", "row"])
    copy = F.col("doc_id") > F.col("least")
    out = meta2.drop("anchors", "key2").join(cut, ["doc_id", "row"], "left")
    nothing = digest(b"")
    columns = ["doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("r", F.lit(0))).cast("long").alias("n_removed"), F.when(copy, F.lit(nothing)).otherwise(F.coalesce("s", "whole")).alias("kept_sha256")]
    return out.select(*columns, *([F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")] if texts else []))

"""Personal data: base patterns, and bootstrapped contextual extraction beyond them.

The base patterns (email, ip, card, phone) give seed entities; long tokens that mix letters and digits
are seeds of a kind of their own (secret), reported only where the contexts confirm them.  The words
around seeds are lexical
patterns: the word before, the two words before, the words before and after (lower case, digits all
alike, punctuation at the ends of words left out).  Then Spark iterates.  A pattern that `support`
distinct values of a kind stand in, and whose known values are `FLOOR` of all its values by a sketch
of their number (common words, after which anything may stand, aren't), extracts all its instances from all texts, whatever they look
like: names and handles as well as numbers.  On the graph of patterns and distinct values a pattern's
score for a kind is the confidence of its values of that kind over all its values, plus one; a
value's confidence is the noisy-or of its patterns' scores (seeds keep 1).  Values that reach
`accept` bring the other patterns that they stand in into the next round.  In the end an instance
that isn't a base seed is reported as `<kind>_like` where its value reaches `accept` and its own pattern
scores `precise` at least and rests on `support` distinct values.

Scores are per distinct value, so copies of a document don't vouch for a pattern.  Every scan reads
whole texts and looks at every word; which patterns or values are wanted is broadcast as a bitmap of
fixed size, followed by an exact join.  Pairs are distinct before each shuffle, so a hot pattern or
value is one row per task and pair.

Nulls count as empty texts, and these have no spans.  Rows are told apart by id and text hash, so
repeated ids keep their own spans; repeated rows give repeated results.  Of kinds that tie for a
span, the last in the alphabet names it.  An empty table gives an empty result.  Columns other than
the two named ones, whatever their names, are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_map, bitmap, in_bitmap, stored
from .shingles import mixed, span_hashes, text_buffer, word_spans

#: Order of the kinds in digests (fixed by the query's contract).
KINDS = ("email", "ip", "card", "phone")

#: An email right of its at sign; its characters left of it.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: A match never begins inside a run of digits, so none is looked at from within.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What a secret looks like: so many characters, of them so many letters and digits each.
SECRET, LETTERS = re.compile(rb"[0-9A-Za-z_+/=-]{32,}"), 6
ROUNDS, ACCEPT, PRECISE, SUPPORT = 2, 0.8, 0.6, 3
#: Share of known values among a pattern's distinct values from which its instances are extracted; far below PRECISE.
FLOOR = 0.1
#: Steps of the graph's scores in each round.
STEPS = 3
#: Bytes of text looked at at once; the arrays take some 50 times as much.
PIECE = 1 << 20
#: Bytes of a value at least.
SHORTEST = 3

#: Bytes between words, besides white space: those that separate a key from its value, and brackets.
_BETWEEN = np.zeros(256, dtype=bool)
_BETWEEN[list(b" \t\n\x0b\x0c\r=:\"'()<>[]{},;|")] = True
#: Bytes that a word may begin or end with: letters, digits, everything beyond ASCII.
_CORE = np.array([chr(b).isalnum() or b > 127 for b in range(128)] + [True] * 128)
#: Contexts compare in lower case, with all digits alike.
_SAID = np.array([57 if 48 <= b <= 57 else LOWER[b] for b in range(256)], dtype=np.uint8)
_TAGS = np.array([0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping emails, each looked for from its at sign."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each base match that passes its test, by start, then kind."""
    out = [("email", *span) for span in emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


class Batch:
    """The words of a batch of texts: their places in its bytes, and what contexts see of them."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_buffer(column)
        starts, ends, counts = word_spans(self.data, self.offsets, _BETWEEN)
        if len(starts):
            # without punctuation at either end, unless there is nothing else
            core = np.flatnonzero(_CORE[self.data])
            a, b = np.searchsorted(core, starts), np.searchsorted(core, ends) - 1
            full = a <= b
            if full.any():
                starts[full], ends[full] = core[a[full]], core[b[full]] + 1
        self.starts, self.ends = starts, ends
        self.last = np.cumsum(counts)
        self.first = self.last - counts
        self.text = np.repeat(np.arange(len(counts)), counts)
        self.said = span_hashes(_SAID[self.data], starts, ends)
        self._values = None

    @property
    def values(self) -> np.ndarray:
        if self._values is None:
            self._values = span_hashes(self.data, self.starts, self.ends)
        return self._values

    def patterns(self, a: np.ndarray, b: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The three contexts [3, n] of what reaches from word a to word b of a text, 0 where the text ends before."""
        out = np.zeros((3, len(a)), dtype=np.uint64)
        if not len(a):
            return out
        one, two, then = a - 1 >= self.first[text], a - 2 >= self.first[text], b + 1 < self.last[text]
        word = lambda k: self.said[np.clip(k, 0, len(self.said) - 1)]
        before = word(a - 1)
        out[0] = np.where(one, mixed(before ^ _TAGS[0]), 0)
        out[1] = np.where(two, mixed(mixed(word(a - 2) ^ _TAGS[1]) + before), 0)
        out[2] = np.where(one & then, mixed(mixed(before ^ _TAGS[2]) + word(b + 1)), 0)
        return out

    def base(self, column: pa.Array) -> list[tuple[int, np.ndarray, list[tuple[str, int, int]]]]:
        """(text, byte place of each character, spans) of the texts that have base spans."""
        out = []
        # an email has an at sign, every other kind four digits at least
        digits = np.append(0, np.cumsum((self.data >= 48) & (self.data <= 57)))[self.offsets]
        at_signs = np.append(0, np.cumsum(self.data == 64))[self.offsets]
        for k in np.flatnonzero((np.diff(digits) >= 4) | (np.diff(at_signs) > 0)).tolist():
            if spans := base_spans(column[k].as_py()):
                own = self.data[self.offsets[k] : self.offsets[k + 1]]
                out.append((k, np.append(np.flatnonzero((own & 0xC0) != 0x80), len(own)) + self.offsets[k], spans))
        return out

    def free(self, column: pa.Array) -> np.ndarray:
        """Which words may be instances: no part of a base span, and long enough."""
        ok = self.ends - self.starts >= SHORTEST
        for _, at, spans in self.base(column):
            for _, a, b in spans:
                ok[np.searchsorted(self.ends, at[a], side="right") : np.searchsorted(self.starts, at[b])] = False
        return ok


_KIND = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SEED = pa.struct([("kind", pa.string()), ("value", pa.int64()), ("patterns", pa.list_(pa.int64()))])
SCAN = "doc_id long, row long, base array<struct<kind:string,start:long,end:long>>, seeds array<struct<kind:string,value:long,patterns:array<long>>>"


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Base spans, and the value and patterns of each."""
    column = batch.column("text")
    own = Batch(column)
    base: list[list] = [[] for _ in range(batch.num_rows)]
    seeds: list[list] = [[] for _ in range(batch.num_rows)]
    for k, at, spans in own.base(column):
        starts, ends = at[[a for _, a, _ in spans]], at[[b for _, _, b in spans]]
        a, b = np.searchsorted(own.ends, starts, side="right"), np.searchsorted(own.starts, ends) - 1
        patterns = own.patterns(a, np.maximum(a, b), np.full(len(spans), k)).view(np.int64).T
        values = span_hashes(own.data, starts, ends).view(np.int64).tolist()
        base[k] = [{"kind": kind, "start": x, "end": y} for kind, x, y in spans]
        seeds[k] = [{"kind": kind, "value": v, "patterns": ps[ps != 0].tolist()} for (kind, _, _), v, ps in zip(spans, values, patterns, strict=True)]
    long = np.flatnonzero((own.ends - own.starts >= 32) & own.free(column))
    patterns = own.patterns(long, long, own.text[long]).view(np.int64).T
    for k, word, v, ps in zip(own.text[long].tolist(), long.tolist(), own.values[long].view(np.int64).tolist(), patterns, strict=True):
        token = own.data[own.starts[word] : own.ends[word]].tobytes()
        digits = sum(48 <= b <= 57 for b in token)
        if SECRET.fullmatch(token) and digits >= LETTERS and len(token) - digits >= LETTERS:
            seeds[k].append({"kind": "secret", "value": v, "patterns": ps[ps != 0].tolist()})
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(base, pa.list_(_KIND)), pa.array(seeds, pa.list_(_SEED))], names=["doc_id", "row", "base", "seeds"])


def _pairs(patterns, values):
    """Distinct (pattern, value) of the instances whose pattern, or whose value, is wanted."""

    def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("text")
        own = Batch(column)
        at = np.flatnonzero(own.free(column))
        if values is not None:
            at = at[in_bitmap(values.value, own.values[at])]
        found = own.patterns(at, at, own.text[at])
        good = found != 0
        if patterns is not None:
            good &= in_bitmap(patterns.value, found)
        _, k = np.nonzero(good)
        both = np.unique(np.stack([found[good], own.values[at[k]]], axis=1), axis=0).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["pattern", "value"])

    return pairs


def _spans(patterns, values):
    """Places, in code points, of the instances whose pattern and value are both wanted."""

    def spans(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("text")
        own = Batch(column)
        at = np.flatnonzero(own.free(column))
        at = at[in_bitmap(values.value, own.values[at])]
        found = own.patterns(at, at, own.text[at])
        which, k = np.nonzero((found != 0) & in_bitmap(patterns.value, found))
        word = at[k]
        # characters before each byte of the batch, less those before the text
        lead = np.append(0, np.cumsum((own.data & 0xC0) != 0x80))
        begin = lead[own.offsets[own.text[word]]]
        rows = pa.array(own.text[word], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("row").take(rows), pa.array(lead[own.starts[word]] - begin), pa.array(lead[own.ends[word]] - begin), pa.array(own.values[word].view(np.int64)), pa.array(found[which, k].view(np.int64))], names=["doc_id", "row", "start", "end", "value", "pattern"])

    return spans


def pattern_scores(edges: DataFrame, seeds: DataFrame, steps: int = STEPS, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Scores of (pattern, kind) and confidences of (value, kind), from edges (pattern, value) and seeds (value, kind)."""
    sizes = stored(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))
    seeds = stored(seeds.select("value", "kind").distinct().withColumn("confidence", F.lit(1.0)))
    others = stored(edges.join(seeds.select("value").distinct(), "value", "left_anti"))
    confidence = seeds
    for _ in range(steps):
        sums = edges.join(confidence, "value").groupBy("pattern", "kind").agg(F.sum("confidence").alias("s"), F.sum((F.col("confidence") > 0.5).cast("int")).alias("support"))
        scores = stored(sums.join(sizes, "pattern").withColumn("score", F.col("s") / (F.col("n") + 1)).select("pattern", "kind", "score", "support"))
        new = others.join(scores.filter(F.col("support") >= support), "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("confidence"))
        confidence = stored(seeds.unionByName(new))
    return scores, confidence


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, accept: float = ACCEPT, precise: float = PRECISE, support: int = SUPPORT) -> DataFrame:
    """One row per document: doc_id, base and added spans as arrays of (kind, start, end), in code points."""
    wanted = docs.sparkSession.sparkContext.broadcast
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).withColumn("row", F.xxhash64("text"))
    scan = stored(arrow_map(docs, _scan, SCAN, limit=PIECE))
    seeds = stored(scan.select(F.explode("seeds").alias("s")).select("s.kind", "s.value", F.explode("s.patterns").alias("pattern")).distinct())
    often = lambda known: known.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support).select("pattern").distinct()
    texts = docs.filter("text is not null").select("text")
    scores = sure = edges = None

    def worth(new: DataFrame, known: DataFrame) -> DataFrame:
        """The patterns whose known values are FLOOR of all: counted by sketches, which combine before they shuffle."""
        others = arrow_map(texts, _pairs(wanted(bitmap(new)), None), "pattern long, value long", limit=PIECE).groupBy("pattern").agg(F.approx_count_distinct("value", 0.2).alias("n"))
        own = known.join(new, "pattern").groupBy("pattern").agg(F.count_distinct("value").alias("s"))
        return stored(own.join(others, "pattern", "left").filter(F.col("s") >= FLOOR * (F.col("s") + F.coalesce("n", F.lit(0)))).select("pattern"))

    seen = stored(often(seeds))
    new = worth(seen, seeds)
    for k in range(rounds):
        found = arrow_map(texts, _pairs(wanted(bitmap(new)), None), "pattern long, value long", limit=PIECE).distinct().join(new, "pattern")
        edges = stored(found.unionByName(seeds.join(new, "pattern").select("pattern", "value")).unionByName(edges if edges is not None else found.limit(0)).distinct())
        scores, confidence = pattern_scores(edges, seeds, support=support)
        sure = stored(confidence.join(seeds.filter(F.col("kind").isin(*KINDS)).select("value").distinct(), "value", "left_anti").filter(F.col("confidence") >= accept))
        if k + 1 == rounds or sure.isEmpty():
            break
        around = arrow_map(texts, _pairs(None, wanted(bitmap(sure.select("value")))), "pattern long, value long", limit=PIECE).distinct()
        known = around.join(sure.select("value", "kind"), "value").select("kind", "value", "pattern").unionByName(seeds.select("kind", "value", "pattern")).distinct()
        known = stored(known)
        more = stored(often(known).join(seen, "pattern", "left_anti"))
        seen = stored(seen.unionByName(more))
        new = worth(more, known)
        if new.isEmpty():
            break
    good = stored(scores.filter((F.col("score") >= precise) & (F.col("support") >= support)).select("pattern", F.col("kind").alias("k")))
    sure = sure.select("value", F.col("kind").alias("like"), "confidence")
    places = arrow_map(docs.filter("text is not null"), _spans(wanted(bitmap(good.select("pattern"))), wanted(bitmap(sure.select("value")))), "doc_id long, row long, start long, end long, value long, pattern long", limit=PIECE)
    best = places.join(good, "pattern").join(sure, "value").filter("k = like").groupBy("doc_id", "row", "start", "end").agg(F.max_by(F.concat("like", F.lit("_like")), F.struct("confidence", "like")).alias("kind"))
    added = best.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))
    out = scan.join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    return out.select("doc_id", "base", F.transform(F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("added"))

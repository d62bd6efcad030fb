"""Language ID by language-bitmask n-gram filters.

One Bloom filter per language, bit-sliced: all share the hash positions, and the words at a position
have one bit per language, 64 to a word.  ANDing the words at an n-gram's positions gives, in one look-up, the set
of all languages whose filter contains it.  The bits of each language are counted over the text's
n-grams (a popcount per slice), the count is corrected for the filter's false positives
(c' = (c - f n) / (1 - f), f measured from the filter's fill), and the language with the largest
corrected count, relative to its count on its own training text, decides.

A filter holds the character n-grams that are typical of its language: those whose frequency there
is at least `TYPICAL` of their largest frequency in any language.  The filters are fitted on at
most `per_language` distinct labelled texts of each language, those of smallest hash; the bound
is a documented parameter, and prediction covers all rows and whole texts.  Executors count the
n-grams of each language, choose the typical ones, set the bits and calibrate; the driver gets the
filters alone, 8 MB for every 64 languages, and one row per language.

Null texts and texts without a letter are `und` with score 0.  Rows with null language never train.
With no training rows, as in an empty table, every text is `und`.  Ties go to the language first in
the alphabet.  Repeated rows give repeated results, and train once.  Texts of any length are read
whole.  Columns in `keep` are carried along; one named like a result's column gets `_in` appended.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, hinted, stored

SIZES = (2, 3, 4)
#: Positions in the filter, a power of two; 8 bytes each for every 64 languages.
POSITIONS = 1 << 20
HASHES = 2
TYPICAL = 0.4
#: n-grams rarer than this in a language's training text aren't added.
MIN_COUNT = 3
PER_LANGUAGE = 1500
#: Bytes of training text whose n-grams are counted at once.
PIECE = 1 << 20
#: Positions of the filters in one row on their way to the driver.
ROW = 4096
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)

_LETTER = regex.compile(r"\p{L}")


def ngram_hashes(text: str, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """A 64-bit hash for each n-gram of the folded text; runs of anything but letters become one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    plain = (points < 65) | ((points > 90) & (points < 97)) | ((points > 122) & (points < 192)) | ((points >= 0x2000) & (points < 0x2C00)) | ((points >= 0x3000) & (points < 0x3040))
    points = np.where(plain, np.uint32(32), points)
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    own = np.empty(int(keep.sum()) + 2, dtype=np.uint64)
    own[0] = own[-1] = 32
    own[1:-1] = points[keep]
    out = []
    for n in sizes:
        if len(own) >= n:
            h = np.full(len(own) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ own[k : len(own) - n + 1 + k]) * _MIX[k % 4]
                h ^= h >> np.uint64(29)
            out.append(h)
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _places(h: np.ndarray, k: int, positions: int) -> np.ndarray:
    return ((h >> np.uint64(20 * k)) & np.uint64(positions - 1)).astype(np.int64)


class Filters:
    """Bit-sliced filters: words[position, l // 64] has bit l % 64 set if language l has an n-gram there."""

    def __init__(self, languages: list[str], words: np.ndarray, hashes: int = HASHES):
        self.languages, self.words, self.hashes = languages, words, hashes
        fill = np.array([np.count_nonzero(words[:, k // 64] & np.uint64(1 << k % 64)) / len(words) for k in range(len(languages))])
        #: Of n-grams that weren't added, the share that a filter still contains.
        self.false = fill**hashes
        self.usual = np.ones(len(languages))

    def masks(self, h: np.ndarray) -> np.ndarray:
        out = self.words[_places(h, 0, len(self.words))]
        for k in range(1, self.hashes):
            out = out & self.words[_places(h, k, len(self.words))]
        return out

    def counts(self, text: str) -> np.ndarray:
        """The share of the text's n-grams that each language contains, corrected for false positives."""
        h = ngram_hashes(text)
        if not len(h):
            return np.zeros(len(self.languages))
        masks = self.masks(h)
        raw = np.zeros(len(self.languages))
        for j in range(masks.shape[1]):
            sets, times = np.unique(masks[:, j], return_counts=True) if len(masks) > 64 else (masks[:, j], np.ones(len(masks)))
            for k in range(64 * j, min(64 * j + 64, len(raw))):
                raw[k] = times[(sets & np.uint64(1 << k % 64)) != 0].sum()
        return np.maximum(0, (raw / len(h) - self.false) / (1 - self.false))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0
        own = self.counts(text) / self.usual
        best = int(np.argmax(own))
        total = own.sum()
        return self.languages[best], float(own[best] / total) if total > 0 else 1.0 / len(self.languages)


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, gram, c): how often each n-gram stands in a batch's texts of a language."""
    by: dict[str, list[np.ndarray]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        by.setdefault(lang, []).append(ngram_hashes(text))
    langs, grams, counts = [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for lang, found in by.items():
        g, c = np.unique(np.concatenate(found), return_counts=True)
        langs += [lang] * len(g)
        grams.append(g)
        counts.append(c)
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(counts))], names=["lang", "gram", "c"])


def typical_ngrams(train: DataFrame, typical: float = TYPICAL, min_count: int = MIN_COUNT) -> tuple[list[str], DataFrame]:
    """The languages, and (language number, gram) of the n-grams that their filters hold."""
    counts = stored(arrow_map(train, _counted, "lang string, gram long, c long", limit=PIECE).groupBy("lang", "gram").agg(F.sum("c").alias("c")))
    totals = sorted((r["lang"], r["total"]) for r in counts.groupBy("lang").agg(F.sum("c").alias("total")).collect())
    languages = [lang for lang, _ in totals]
    if not languages:
        return [], counts.select(F.lit(0).alias("l"), "gram")
    numbers = train.sparkSession.createDataFrame([(lang, k, float(n)) for k, (lang, n) in enumerate(totals)], "lang string, l int, total double")
    shares = counts.join(F.broadcast(numbers), "lang").select("gram", F.struct("l", "c", (F.col("c") / F.col("total")).alias("share")).alias("own"))
    # as many entries of a gram as there are languages, at most
    of = shares.groupBy("gram").agg(F.max("own.share").alias("most"), F.collect_list("own").alias("owns"))
    good = of.select("gram", F.explode(F.filter("owns", lambda o: (o["share"] >= F.lit(typical) * F.col("most")) & (o["c"] >= min_count))).alias("own"))
    return languages, good.select("own.l", "gram")


def _rows_of_words(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    words = np.zeros(ROW, dtype=np.int64)
    words[np.asarray(table["place"]) % ROW] = np.asarray(table["word"])
    return pa.table({"row": [key[0].as_py()], "slice": [key[1].as_py()], "words": [words.tobytes()]}, schema=pa.schema([("row", pa.int64()), ("slice", pa.int32()), ("words", pa.binary())]))


def fitted(train: DataFrame, positions: int = POSITIONS, typical: float = TYPICAL, min_count: int = MIN_COUNT) -> Filters:
    """Filters of a frame (lang, text) of bounded size."""
    train = stored(train)
    languages, grams = typical_ngrams(train, typical, min_count)
    words = np.zeros((positions, max(1, -(-len(languages) // 64))), dtype=np.uint64)
    if not languages:
        return Filters([], words)
    place = lambda k: F.shiftrightunsigned("gram", 20 * k).bitwiseAND(F.lit(positions - 1).cast("long"))
    bits = grams.select("l", F.explode(F.array(*(place(k) for k in range(HASHES)))).alias("place"))
    bits = bits.groupBy("place", F.floor(F.col("l") / 64).cast("int").alias("slice")).agg(F.bit_or(F.expr("shiftleft(1L, l % 64)")).alias("word"))
    rows = bits.groupBy(F.floor(F.col("place") / ROW).alias("row"), "slice").applyInArrow(_rows_of_words, "row long, slice int, words binary")
    for r in rows.collect():
        words[r["row"] * ROW : (r["row"] + 1) * ROW, r["slice"]] = np.frombuffer(r["words"], np.uint64)
    out = Filters(languages, words)
    # how much of a language's own text its filter contains, on average
    shared = train.sparkSession.sparkContext.broadcast((languages, words))
    kept: dict = {}

    def own_share(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "own" not in kept:
            kept["own"] = Filters(*shared.value)
        own = kept["own"]
        said = batch.column("lang").to_pylist()
        share = [float(own.counts(t)[own.languages.index(lang)]) for lang, t in zip(said, batch.column("text").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(said, pa.string()), pa.array(share, pa.float64())], names=["lang", "share"])

    means = {r["lang"]: r["mean"] for r in arrow_map(train, own_share, "lang string, share double").groupBy("lang").agg(F.avg("share").alias("mean")).collect()}
    # rounded, as sums depend on the order of rows
    out.usual = np.maximum(np.round([means[lang] for lang in languages], 9), 1e-6)
    return out


def fit(texts: list[tuple[str, str]], **more) -> Filters:
    """Filters of (language, text) pairs."""
    return fitted(SparkSession.getActiveSession().createDataFrame(texts, "lang string, text string"), **more)


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, text): at most per_language distinct texts of each language, those of smallest hash.

    Copies count once: hashes are ranked, without the texts, and each one chosen brings one text.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    hashes = stored(rows.select("lang", "h").distinct())
    # the least hashes of a language are below this bound whatever the size, so few rows are ranked
    cuts = hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    cut = F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(1.5 * per_language + 50) / F.col("n")) - F.lit(2.0**63)
    few = hashes.join(cuts.select(F.col("lang").alias("l"), cut.alias("cut")), F.col("lang") == F.col("l")).filter(F.col("h").cast("double") <= F.col("cut"))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    chosen = stored(ranked.filter(F.col("rank") <= per_language).select(F.col("lang").alias("l"), F.col("h").alias("h2")))
    out = rows.join(hinted(chosen), (F.col("lang") == F.col("l")) & (F.col("h") == F.col("h2")))
    return out.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def language_id(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, evidence) of every row, plus the columns named in `keep`.

    score: the predicted language's part of the corrected counts; evidence: its corrected share of
    the text's n-grams, relative to training text of its language (about 1 for ordinary text).
    """
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.words, filters.usual))
    own_names = ["doc_id", "lang_pred", "score", "evidence"]
    names = [f"{c}_in" if c in own_names else c for c in keep]
    schema = "doc_id long, lang_pred string, score double, evidence double" + "".join(f", `{n}` {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))
    kept: dict = {}

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "own" not in kept:
            languages, words, usual = shared.value
            kept["own"] = Filters(languages, words)
            kept["own"].usual = usual
        own, out = kept["own"], []
        for text in batch.column("__text").to_pylist():
            if not text or not own.languages or not _LETTER.search(text):
                out.append(("und", 0.0, 0.0))
                continue
            c = own.counts(text) / own.usual
            best, total = int(np.argmax(c)), float(c.sum())
            out.append((own.languages[best], float(c[best]) / total if total > 0 else 1.0 / len(c), float(c[best])))
        lang, score, evidence = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(evidence, pa.float64()), *(batch.column(n) for n in names)], names=[*own_names, *names])

    return arrow_map(docs.select(docs[id_col].cast("long").alias("__id"), docs[text_col].alias("__text"), *(docs[c].alias(n) for n, c in zip(names, keep, strict=True))), predict, schema, by="__text", limit=2 << 20)

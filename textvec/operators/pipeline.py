"""tokenize, embed, embed_tokens and their checks, as DataFrame transforms.

Row-preserving steps are scalar Arrow UDF columns, so filters and column pruning pass below them to
the scan; only embed_tokens changes the number of rows, by posexplode above such a column.  An
encoder is broadcast once and prepared once per Python worker; texts of an Arrow batch that have
equally many tokens are encoded together.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import vec
from ..sources.shared import stored
from . import nn, segment, vocab
from .config import agrees

_IDS = T.ArrayType(T.LongType())
_VECTOR = T.ArrayType(T.FloatType())
_workers: dict[str, tuple] = {}


def tokenizer(kind: str):
    """A tokenizer over the synthetic vocabularies, with its vocabulary size."""
    if kind == "wordpiece":
        own = {t: k for k, t in enumerate(vocab.wordpiece_vocab())}
        return segment.WordPiece(own), len(own)
    if kind in ("bpe", "qwen"):
        own = vocab.bpe_vocab()
        added = [(c, own[c], left, right) for c, left, right in vocab.ADDED]
        if kind == "qwen":
            return segment.ByteBPE(own, vocab.bpe_merges(), added, prefix=None, nfc=True, pattern=segment.patterns.QWEN), len(own)
        return segment.ByteBPE(own, vocab.bpe_merges(), added), len(own)
    if kind == "gemma":
        own, merges = vocab.gemma_vocab()
        return segment.FallbackBPE(own, merges), len(own)
    if kind == "sentencepiece":
        own = segment.Unigram(vocab.unigram_pieces())
        return own, own.size
    raise ValueError(f"tokenizer {kind!r} is not supported")


#: The tokenizer of each architecture.
TOKENIZER_OF = {"bert": "wordpiece", "distilbert": "wordpiece", "mpnet": "wordpiece", "nomic": "wordpiece", "roberta": "bpe", "modernbert": "bpe", "qwen3": "qwen", "gemma": "gemma"}


@dataclass
class Embedder:
    """A frozen model: spec, tokenizer kind, numeric mode and output width."""

    spec: nn.Spec
    kind: str
    mode: str = nn.FP32
    dim: int = 0
    values: dict[str, np.ndarray] | None = None
    key: str = field(default_factory=lambda: uuid.uuid4().hex)
    #: A tokenizer of its own, in place of the synthetic one of its kind; the model's name.
    own: object = None
    name: str = ""

    def __post_init__(self):
        size = tokenizer(self.kind)[1] if self.own is None else self.spec.vocab
        if not agrees(size, self.spec.vocab, {"gemma": "gemma", "sentencepiece": "sentencepiece"}.get(self.kind, self.spec.arch)):
            raise ValueError(f"a vocabulary of {size} doesn't fit a table of {self.spec.vocab}")
        encoder = nn.Encoder(self.spec, self.values, self.mode, self.dim)
        self.width, self.mode_active = encoder.dim, encoder.mode_active

    @classmethod
    def tiny(cls, arch: str, **more) -> Embedder:
        kind = more.pop("kind", TOKENIZER_OF[arch])
        own = {k: more.pop(k) for k in ("mode", "dim") if k in more}
        return cls(nn.tiny(arch, tokenizer(kind)[1], **more), kind, **own)

    def ready(self) -> tuple:
        if self.key not in _workers:
            _workers[self.key] = (tokenizer(self.kind)[0] if self.own is None else self.own, nn.Encoder(self.spec, self.values, self.mode, self.dim))
        return _workers[self.key]

    def encode(self, text: str) -> list[int]:
        return self.ready()[0].encode(text, self.spec.max_len)


def ids_udf(df: DataFrame, kind: str, max_len: int):
    """Token ids of a text column; null stays null."""

    @F.pandas_udf(_IDS)
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = tokenizer(kind)[0]
        for texts in batches:
            yield texts.map(lambda t: own.encode(t, max_len), na_action="ignore")

    return ids


def tokenize(df: DataFrame, kind: str = "wordpiece", max_len: int = 64, text_col: str = "text", out: str = "ids") -> DataFrame:
    return df.withColumn(out, ids_udf(df, kind, max_len)(text_col))


def tokenize_with(df: DataFrame, embedder: Embedder, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Token ids of a model's own tokenizer, as embed() sees them."""
    return df.withColumn(out, _embed_udf(df, embedder, _IDS, lambda enc, ids: ids)(text_col))


def _embed_udf(df: DataFrame, embedder: Embedder, kind, run):
    shared = df.sparkSession.sparkContext.broadcast(embedder)

    @F.pandas_udf(kind)
    def embed_(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        tok, enc = own.ready()
        for texts in batches:
            out = np.full(len(texts), None, dtype=object)
            said = np.flatnonzero(texts.notna())
            for k, result in zip(said, run(enc, [tok.encode(t, own.spec.max_len) for t in texts.iloc[said]]), strict=True):
                out[k] = result
            yield pd.Series(out)

    return embed_


def embed(df: DataFrame, embedder: Embedder, text_col: str = "text", out: str = "embedding", workers: int = 0) -> DataFrame:
    """One vector per row; a null text has a null vector, an empty one that of the framing tokens.

    workers: at most so many tasks encode at once; 0 for as many as there are partitions.
    """
    if workers < 0:
        raise ValueError("workers can't be negative")
    df = df.coalesce(workers) if workers else df
    return df.withColumn(out, _embed_udf(df, embedder, _VECTOR, lambda enc, ids: enc.all_pooled(ids))(text_col))


def embed_once(df: DataFrame, embedder: Embedder, text_col: str = "text", out: str = "embedding") -> DataFrame:
    """embed() with each distinct text encoded once: worth its shuffle where texts repeat."""
    once = embed(df.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("__text")).distinct(), embedder, "__text", out)
    return df.join(once, df[text_col] == once["__text"], "left").drop("__text")


def embed_tokens(df: DataFrame, embedder: Embedder, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, token_id, hidden): full width, whatever the embedder's dim."""
    kind = T.ArrayType(T.StructType([T.StructField("token_id", T.LongType()), T.StructField("hidden", _VECTOR)]))

    def run(enc, sequences):
        for ids, states in zip(sequences, enc.all_tokens(sequences), strict=True):
            yield [{"token_id": i, "hidden": h} for i, h in zip(ids, states, strict=True)]

    rows = df.select(id_col, _embed_udf(df, embedder, kind, run)(text_col).alias("tokens"))
    return rows.select(id_col, F.posexplode("tokens").alias("pos", "t")).select(id_col, F.col("pos").cast("long").alias("pos"), "t.token_id", "t.hidden")


def try_embed(df: DataFrame, embedder: Embedder, text_col: str = "text", out: str = "result") -> DataFrame:
    """struct<embedding, error>: a failing text fails its row, not the job."""
    kind = T.StructType([T.StructField("embedding", _VECTOR), T.StructField("error", T.StringType())])
    shared = df.sparkSession.sparkContext.broadcast(embedder)

    @F.pandas_udf(kind)
    def embed_(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        tok, enc = own.ready()
        rows = []
        for t in texts:
            try:
                rows.append((None if t is None else enc.pooled(tok.encode(t, own.spec.max_len)), None))
            except ValueError as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["embedding", "error"])

    return df.withColumn(out, embed_(text_col))


def first_error(results: DataFrame, order_col: str, result_col: str = "result") -> str | None:
    """The message of the first failing row in order, as a call over a list of texts reports it; None without one."""
    error = F.col(result_col).getField("error")
    row = results.filter(error.isNotNull()).agg(F.min_by(error, order_col).alias("error")).first()
    return row["error"]


def register(spark, embedder: Embedder, name: str = "embed") -> None:
    """SQL functions <name>(text) and <name>_ids(text), and the table function <name>_tokens(text)."""
    some = spark.range(0)
    spark.udf.register(name, _embed_udf(some, embedder, _VECTOR, lambda enc, ids: enc.all_pooled(ids)))
    spark.udf.register(name + "_ids", _embed_udf(some, embedder, _IDS, lambda enc, ids: ids))
    shared = spark.sparkContext.broadcast(embedder)

    class Tokens:
        def eval(self, text: str):
            own = shared.value
            tok, enc = own.ready()
            if text is not None:
                ids = tok.encode(text, own.spec.max_len)
                for pos, (i, h) in enumerate(zip(ids, enc.tokens(ids), strict=True)):
                    yield pos, i, h.tolist()

    spark.udtf.register(name + "_tokens", F.udtf(Tokens, returnType="pos int, token_id bigint, hidden array<float>"))


# Checks and figures.


def drift(want: str, got: str) -> list:
    """max_abs, mean_abs and cosine of two vector columns."""
    a, b = vec.doubles(F.col(want)), vec.doubles(F.col(got))
    gap = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return [F.array_max(gap).alias("max_abs"), (vec.total(gap) / F.size(gap)).alias("mean_abs"), vec.cosine(a, b).alias("cosine")]


def validate(golden: DataFrame, got: DataFrame, key: str, tolerance: float = 1e-4) -> DataFrame:
    """(key, ids_equal, max_abs, mean_abs, cosine, passed) of columns input_ids and embedding on both sides."""
    a = golden.select(key, F.col("input_ids").alias("want_ids"), F.col("embedding").alias("want"))
    b = got.select(key, F.col("input_ids").alias("got_ids"), F.col("embedding").alias("got"))
    out = a.join(b, key, "left").withColumn("ids_equal", F.col("want_ids").eqNullSafe(F.col("got_ids"))).select(key, "ids_equal", *drift("want", "got"))
    return out.withColumn("passed", F.coalesce(F.col("ids_equal") & (F.col("max_abs") <= tolerance), F.lit(False)))


def ordered(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with `rank` from 0 within keys in order of value, and `n` rows of the key; no task sees a whole key.

    Rows are dealt by ranges of (keys, value), a row number breaking ties, and written with the number
    of their range, so that counts of each range and key (few rows) give offsets for the same ranges.
    """
    ranges = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*[F.col(k) for k in keys], F.col(value), F.col("__tie"))
    dealt = stored(ranges.withColumn("__part", F.spark_partition_id()))
    ranked = dealt.withColumn("__rn", F.row_number().over(Window.partitionBy("__part", *keys).orderBy(value, "__tie")))
    counts = dealt.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys)
    offsets = counts.withColumn("__before", F.sum("__n").over(w.orderBy("__part")) - F.col("__n")).withColumn("n", F.sum("__n").over(w))
    offsets = offsets.select(F.col("__part").alias("__p"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__before", "n")
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return ranked.join(offsets, same).withColumn("rank", F.col("__rn") - 1 + F.col("__before")).select(*df.columns, "n", "rank")


def bench_stats(runs: DataFrame, keys: list[str], value: str = "sec") -> DataFrame:
    """median, p10 and p90 by index (n/2, n/10, 9n/10 of the sorted runs), and their spread in per cent.

    Runs without a value don't count; runs whose key is null form a key of their own.
    """
    runs = runs.select(*keys, value).filter(F.col(value).isNotNull())
    at = lambda k: F.floor(F.col("n") * k / 10).cast("long")
    picked = ordered(runs, keys, value).filter((F.col("rank") == at(5)) | (F.col("rank") == at(1)) | (F.col("rank") == at(9)))
    out = picked.groupBy(*keys).agg(F.max("n").alias("runs"), *(F.max(F.when(F.col("rank") == at(k), F.col(value))).alias(name) for k, name in ((5, "median"), (1, "p10"), (9, "p90"))))
    return out.withColumn("spread", 100 * (F.col("p90") - F.col("p10")) / F.col("median"))


def ab_compare(runs: DataFrame, value: str = "sec") -> DataFrame:
    """Two engines A and B, both orders: ratio of medians for each order, and drift over 10 % flagged."""
    stats = bench_stats(runs, ["engine", "order"], value)
    wide = stats.groupBy("order").pivot("engine", ["A", "B"]).agg(F.first("median"))
    wide = wide.withColumn("ratio", F.col("A") / F.col("B"))
    every = wide.groupBy().agg(F.max("ratio").alias("hi"), F.min("ratio").alias("lo"))
    return wide.join(F.broadcast(every), F.lit(True)).withColumn("drifts", F.col("hi") / F.col("lo") > 1.1).drop("hi", "lo")


def ab_verdict(runs: DataFrame, value: str = "sec") -> DataFrame:
    """One row over both orders: medians and their ratio, spreads, and what to distrust.

    parity: the medians differ by less than the larger spread; unstable_a, unstable_b: an engine's
    medians of the two orders differ by over 10 %.
    """
    one = lambda stats, column: stats.groupBy().agg(*(F.max(F.when(F.col("engine") == e, F.col(c))).alias(f"{n}_{e.lower()}") for e in "AB" for n, c in column))
    both = one(bench_stats(runs, ["engine"], value), [("median", "median"), ("spread", "spread")])
    orders = bench_stats(runs, ["engine", "order"], value).groupBy("engine").agg((F.max("median") / F.min("median") - 1 > 0.1).alias("unstable"))
    out = both.join(F.broadcast(one(orders, [("unstable", "unstable")])), F.lit(True)).withColumn("ratio", F.col("median_a") / F.col("median_b"))
    return out.withColumn("parity", 100 * F.abs(F.col("ratio") - 1) < F.greatest("spread_a", "spread_b"))

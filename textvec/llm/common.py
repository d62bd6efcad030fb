"""Small helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import os
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import dropped, fresh_path, shared_folder, stored

__all__ = ["KEPT_BY", "arrow_map", "bitmap", "digest", "dropped", "fresh_path", "hinted", "in_bitmap", "pieces", "raw_bytes", "shared_folder", "small_batches", "small_enough", "stored", "table", "tidied", "tidy", "tokenizer_path"]

#: A-Z to a-z, everything else unchanged.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.cast(column, pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the named column has about `limit` bytes in each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most, on both sides of the pipe, where the session has Spark's default of 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") in ("67108864b", "64MB", "64m"):
        spark.conf.set(key, "8m")


def tidy() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


#: What a worker keeps from task to task, by owner, and how to forget it.
KEPT_BY: dict[str, Callable[[], None]] = {}


def forget_others(owner: str | None) -> None:
    """Forget what all owners but this one keep in this worker."""
    for name in [n for n in KEPT_BY if n != owner]:
        KEPT_BY.pop(name)()


def tidied(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], done: Callable[[], None] | None = None, owner: str | None = None) -> Callable:
    """fn for mapInArrow, giving its memory back at the end of each task: workers live on, and others need the room.

    What `owner` keeps in the worker stays for its next task, and goes with the first task of another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(owner)
        try:
            yield from fn(batches)
        finally:
            if done is not None:
                done()
            tidy()

    return run


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, by: str = "text", limit: int = 8 << 20, done: Callable[[], None] | None = None, owner: str | None = None) -> DataFrame:
    """mapInArrow with batches of bounded bytes; done() is called at the end of each task."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, by, limit):
            out = fn(piece)
            if out is not None:
                yield out

    return df.mapInArrow(tidied(run, done, owner), schema)


def bitmap(df: DataFrame, bits: int = 26) -> np.ndarray:
    """2^bits bits, those set that the low bits of a column of hashes name: of fixed size, however many there are.

    Executors make the words; the driver gets at most 2^bits / 8 bytes.
    """
    place = df.select(F.col(df.columns[0]).cast("long").bitwiseAND(F.lit((1 << bits) - 1).cast("long")).alias("p"))
    words = place.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("word"))

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        row = np.zeros(4096, dtype=np.int64)
        row[np.asarray(table["at"]) % 4096] = np.asarray(table["word"])
        return pa.table({"row": [key[0].as_py()], "words": [row.tobytes()]}, schema=pa.schema([("row", pa.int64()), ("words", pa.binary())]))

    out = np.zeros((max(1, (1 << bits) // (64 * 4096)), 4096), dtype=np.uint64)
    for r in words.groupBy(F.shiftright("at", 12).alias("row")).applyInArrow(packed, "row long, words binary").collect():
        out[r["row"]] = np.frombuffer(r["words"], np.uint64)
    return out.reshape(-1)


def in_bitmap(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in a bitmap; of others next to none are."""
    place = h & np.uint64(len(words) * 64 - 1)
    return words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) != 0


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def letters_folded(column) -> F.Column:
    """A-Z to a-z only, as LOWER does, JVM-side."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """df, of a few short columns, with a broadcast hint where it has at most so many rows."""
    return F.broadcast(df) if small_enough(df, rows) else df


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is; TEXTVEC_TOKENIZERS names another folder."""
    if folder := os.environ.get("TEXTVEC_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


WORD = re.compile(rb"[^\x20\x09-\x0D]+")

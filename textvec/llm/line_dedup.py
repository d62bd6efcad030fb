"""Line dedup by site-relative frequency.

For each host (here `source`), the pages that contain a line are divided by the pages of the host;
lines above `ratio` are boilerplate of that host and are dropped from its pages.  Lines are what
stands between line feeds; blank lines are kept and never counted; a line counts once per page.
Rows with a null host form a host of their own; null texts stay null, with no lines, and empty texts
stay empty.  Repeated rows count as pages of their own.  A line just at the ratio stays.  An empty
table gives an empty result.  Texts of any length are read whole.  Other columns are carried through
unchanged; one that is named n_lines or n_dropped already gets `_in` appended.

With `distinct`, pages of a host that hold the same lines count once, and `least` such pages are
needed: a document's copies don't make its lines boilerplate, and are left to a stage for copies.

All of it is DataFrame expressions.  Pages are exploded to (host, 64-bit line hash), which Spark
aggregates before it shuffles, so a hot host or line arrives as one row from each task; only the
hashes above the ratio (at most lines-per-page / ratio for each host) meet the pages again.  They
are broadcast behind a check of their number, else joined by host, split where a host is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_enough, stored

RATIO = 0.1
#: Hosts with fewer pages have no boilerplate, as every line would be one.
MIN_PAGES = 10
#: Distinct pages that a boilerplate line must be on where copies count once.
LEAST = 5
#: Boilerplate lines up to which they are broadcast (16 bytes and the host's name each).
BROADCAST_ROWS = 500_000


def unused(name: str, df: DataFrame) -> str:
    """The name, with underscores in front until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _lines(text):
    return F.filter(F.array_distinct(F.split(text, "\n")), lambda x: ~x.rlike(r"\A[ \t\r\f\x0b]*\z"))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct: bool = False, least: int = 1) -> DataFrame:
    """(host, line hash, pages, host_pages) of each line above the ratio.

    A page adds one row per distinct line and one for itself, so one aggregation counts both.
    """
    pages = docs.select(F.col(host_col).alias("host"), F.coalesce(F.transform(_lines(F.col(text_col)), lambda x: F.xxhash64(x)), F.array().cast("array<bigint>")).alias("lines"))
    if distinct:
        pages = pages.groupBy("host", F.xxhash64(F.array_sort("lines")).alias("page")).agg(F.first("lines").alias("lines"))
    one = pages.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "lines")).alias("line"))
    # counted without the host total first: a line on one page only can't be boilerplate of a host of min_pages / ratio
    counts = one.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("line").isNull() | (F.col("pages") > F.lit(ratio * min_pages)))
    counts = stored(counts)
    totals = counts.filter("line is null").select(F.col("host").alias("h"), F.col("pages").alias("host_pages"))
    return counts.filter("line is not null").join(totals, F.col("host").eqNullSafe(F.col("h"))).drop("h").filter((F.col("host_pages") >= min_pages) & (F.col("pages") > F.col("host_pages") * F.lit(ratio)) & (F.col("pages") >= least))


def line_dedup(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_rows: int = BROADCAST_ROWS, distinct: bool = False, least: int = 1) -> DataFrame:
    """The documents with boilerplate lines dropped from the text, plus n_lines and n_dropped (lines, repeats included)."""
    lines = stored(boilerplate(docs, host_col, text_col, ratio, min_pages, distinct, least).select("host", "line"))
    small = small_enough(lines, broadcast_rows)
    for name in {"n_lines", "n_dropped"} & set(docs.columns):
        docs = docs.withColumnRenamed(name, unused(f"{name}_in", docs))
    host, bad, kept = (unused(name, docs) for name in ("host", "bad", "kept"))
    lists = lines.groupBy(F.col("host").alias(host)).agg(F.collect_set("line").alias(bad))
    docs = docs.join(F.broadcast(lists) if small else lists, F.col(host_col).eqNullSafe(F.col(host)), "left")
    split = F.split(F.col(text_col), "\n")
    keep = lambda x: ~F.array_contains(F.col(bad), F.xxhash64(x)) | x.rlike(r"\A[ \t\r\f\x0b]*\z")
    docs = docs.withColumn(kept, F.when(F.col(bad).isNull(), split).otherwise(F.filter(split, keep)))
    out = docs.withColumn("n_lines", F.coalesce(F.size(F.filter(split, lambda x: ~x.rlike(r"\A[ \t\r\f\x0b]*\z"))), F.lit(0)).cast("long"))
    out = out.withColumn("n_dropped", F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(split) - F.size(kept)).cast("long"))
    return out.withColumn(text_col, F.when(F.col("n_dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col))).drop(kept, bad, host)

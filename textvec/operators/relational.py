"""Pooling, matrix products and attention as joins, groupings and windows.

Token vectors are rows (sid, pos, v array<double>): one row per token.  Attention is a self-join on
the sequence, a softmax over a window, and a grouping; the mask is the join predicate, so masked
pairs are never made.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vec


def exploded(df: DataFrame, column: str, *keys: str, value: str = "value") -> DataFrame:
    """One row per component: keys, pos, value."""
    return df.select(*keys, F.posexplode(column).alias("pos", value))


def mean_pool(tokens: DataFrame, key: str = "sid", column: str = "v") -> DataFrame:
    """(key, pos, value): the average of the rows, partial sums before the shuffle."""
    return exploded(tokens, column, key).groupBy(key, "pos").agg(F.avg("value").alias("value"))


def cls_pool(tokens: DataFrame, key: str = "sid", column: str = "v") -> DataFrame:
    return tokens.groupBy(key).agg(F.min_by(column, "pos").alias("v"))


def last_pool(tokens: DataFrame, key: str = "sid", column: str = "v") -> DataFrame:
    return tokens.groupBy(key).agg(F.max_by(column, "pos").alias("v"))


def matmul(rows: DataFrame, weights: DataFrame, key: str = "vec_id") -> DataFrame:
    """C = A W^T: rows (key, i, x) joined with weights (o, i, w) on i, summed by (key, o).

    The weights are a model's, of fixed size, and are broadcast, so the only shuffle is the sum's,
    after partial aggregation.
    """
    return rows.join(F.broadcast(weights), "i").groupBy(key, "o").agg(F.sum(F.col("x") * F.col("w")).alias("value"))


def heads(tokens: DataFrame, n: int, dim: int, column: str = "v", keys: tuple[str, ...] = ("sid", "pos")) -> DataFrame:
    """One row per head: keys, head, and its slice of the vector."""
    parts = F.array(*(F.struct(F.lit(h).alias("head"), F.slice(column, h * dim + 1, dim).alias(column)) for h in range(n)))
    return tokens.select(*keys, F.explode(parts).alias("h")).select(*keys, "h.*")


def attention(q: DataFrame, k: DataFrame, dim: int, mask: Callable[[Column, Column], Column] | None = None, bias: Callable[[Column, Column], Column] | None = None, group: int = 1, scale: float | None = None) -> DataFrame:
    """softmax(q k^T scale + bias) v for each (sid, head).

    q: (sid, pos, head, v); k: (sid, pos, head, v, u), u being the value vector.  mask(i, j) keeps a
    pair of query and key position; group query heads share one key head.
    """
    right = k.select(F.col("sid").alias("ks"), F.col("pos").alias("j"), F.col("head").alias("kh"), F.col("v").alias("kv"), F.col("u").alias("ku"))
    left = q.withColumn("kv_head", F.floor(F.col("head") / group).cast("int"))
    on = (F.col("sid") == F.col("ks")) & (F.col("kv_head") == F.col("kh"))
    if mask is not None:
        on = on & mask(F.col("pos"), F.col("j"))
    score = vec.dot(F.col("v"), F.col("kv")) * F.lit(dim**-0.5 if scale is None else scale)
    if bias is not None:
        score = score + bias(F.col("pos"), F.col("j"))
    w = Window.partitionBy("sid", "pos", "head")
    pairs = left.join(right, on).withColumn("s", score)
    pairs = pairs.withColumn("e", F.exp(F.col("s") - F.max("s").over(w))).withColumn("a", F.col("e") / F.sum("e").over(w))
    return pairs.select("sid", "pos", "head", "a", F.posexplode("ku").alias("d", "x")).groupBy("sid", "pos", "head", "d").agg(F.sum(F.col("a") * F.col("x")).alias("value"))


def softmax_rows(scores: DataFrame, *keys: str, column: str = "s") -> DataFrame:
    """Softmax in long form, over a window."""
    w = Window.partitionBy(*keys)
    return scores.withColumn("e", F.exp(F.col(column) - F.max(column).over(w))).withColumn("a", F.col("e") / F.sum("e").over(w)).drop("e")


def _named(names: list[str], columns: list[Column]) -> list[Column]:
    return [c.alias(n) for n, c in zip(names, columns, strict=True)]


def _added(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _solid(c: Column) -> Column:
    """A column that is never null, so that the code made for it checks nothing."""
    return F.coalesce(c, F.lit(float("nan")))


def bert_states(ids: DataFrame, spec, values: dict) -> DataFrame:
    """Hidden states (sid, pos, v) of a small BERT over token rows (sid, pos, id), in double precision, by joins and windows alone.

    (sid, pos) names a row; rows without a sid, or with an id that isn't in the token table, have no states.

    The tables of tokens and positions are joined, broadcast; the other weights are constants of the
    plan, so this is for widths of a few dozen at most.  Components are columns of their own, so that
    sums and products are compiled.  A window brings the keys and values of a sequence to each of its
    tokens; pairs of query and key exist between an explode and the sum over it, in no sort or shuffle.
    Windows and groupings are by sid at the front: rows that come dealt out by sid aren't shuffled.
    """
    width, dim = spec.hidden, spec.dim_head
    x, q, k, v, u = ([f"{c}{i}" for i in range(n)] for c, n in (("x", width), ("q", width), ("k", width), ("v", width), ("u", spec.inter)))
    e, at = ["sid", "pos"], [f"at{i}" for i in range(width)]
    tops, ps = [f"top{h}" for h in range(spec.heads)], [f"p{h}" for h in range(spec.heads)]

    def table(key: str, kind: str, names: list[str], rows) -> DataFrame:
        schema = f"{key} {kind} NOT NULL, " + ", ".join(f"{n} double NOT NULL" for n in names)
        return F.broadcast(ids.sparkSession.createDataFrame([(i, *map(float, row)) for i, row in enumerate(rows)], schema))

    def dense(names: list[str], name: str) -> list[Column]:
        return [_added(F.col(c) * float(w) for c, w in zip(names, row, strict=True)) + float(b) for row, b in zip(values[name], values[name + ".bias"], strict=True)]

    def apart(df: DataFrame, names: list[str], columns: list[Column]) -> DataFrame:
        """A projection of its own, as a lambda keeps it out of whole-stage code: methods of more than 8,000 bytes aren't compiled by the JVM."""
        return df.select(*e, *_named(names, [_solid(vec.let(columns[0], lambda c: c)), *columns[1:]]))

    def normed(df: DataFrame, columns: list[Column], name: str) -> DataFrame:
        """(sid, pos, x...): what several columns need is a column before them."""
        df = apart(df, x, columns)
        df = df.select("*", _solid(_added(map(F.col, x)) / width).alias("mean"))
        df = df.select(*e, *((F.col(c) - F.col("mean")).alias(c) for c in x))
        df = df.select("*", F.sqrt(_solid(_added(F.col(c) * F.col(c) for c in x) / width) + spec.eps).alias("scale"))
        return df.select(*e, *((_solid(F.col(c) / F.col("scale")) * float(g) + float(b)).alias(c) for c, g, b in zip(x, values[name + ".g"], values[name + ".b"], strict=True)))

    def score(h: int) -> Callable[[Column], Column]:
        return lambda key: _added(F.col(q[i]) * key[k[i]] for i in range(h * dim, h * dim + dim)) * dim**-0.5

    whole = Window.partitionBy("sid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = ids.filter("sid is not null").join(table("id", "long", x, values["embed"]), "id").join(table("pos", "int", at, values["position"]), "pos", "left")
    df = df.withColumn(at[0], F.coalesce(at[0], F.raise_error(F.concat(F.lit("there is no position "), "pos"))))
    df = normed(df, [F.col(a) + _solid(F.col(b)) + float(t) for a, b, t in zip(x, at, values["type"][0], strict=True)], "embed_norm")
    for n in range(spec.layers):
        p = f"layer{n}."
        df = apart(df, [*x, *q, *k, *v], [*map(F.col, x), *(c for kind in "qkv" for c in dense(x, p + kind))])
        df = df.select(*e, *x, *q, F.struct(*k, *v).alias("key"))
        df = df.select(*e, *x, *q, F.collect_list("key").over(whole).alias("keys"))
        df = df.select("*", *(F.array_max(F.transform("keys", score(h))).alias(t) for h, t in enumerate(tops)))
        df = df.select(*e, *x, *q, *tops, F.explode("keys").alias("key"))
        df = df.select(*e, *x, *(F.exp(score(h)(F.col("key")) - F.col(t)).alias(ps[h]) for h, t in enumerate(tops)), *(F.col("key")[c].alias(c) for c in v))
        df = df.groupBy(*e).agg(*(F.max(c).alias(c) for c in x), *(F.sum(c).alias(c) for c in ps), *(F.sum(F.col(ps[i // dim]) * F.col(c)).alias(c) for i, c in enumerate(v)))
        df = df.select(*e, *(_solid(F.col(c)).alias(c) for c in x), *(_solid(F.col(c) / F.col(ps[i // dim])).alias(c) for i, c in enumerate(v)))
        df = normed(df, [F.col(c) + d for c, d in zip(x, dense(v, p + "o"), strict=True)], p + "attn_norm")
        df = apart(df, [*x, *u], [*map(F.col, x), *dense(x, p + "up")])
        df = apart(df, [*x, *u], [*map(F.col, x), *(_solid(vec.gelu_of(F.col(c))) for c in u)])
        df = normed(df, [F.col(c) + d for c, d in zip(x, dense(u, p + "down"), strict=True)], p + "mlp_norm")
    # always true, and not moved by the optimiser: a predicate on v that passed it would be written out through all projections
    return df.select(*e, F.when(F.spark_partition_id() >= 0, F.array(*x)).alias("v"))


def bert_vectors(states: DataFrame, width: int) -> DataFrame:
    """(sid, v): states of so many components averaged and brought to length 1."""
    pooled = states.groupBy("sid").agg(*(F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(width)))
    return pooled.select("sid", vec.l2_normalize(F.array(*(f"m{i}" for i in range(width)))).alias("v"))

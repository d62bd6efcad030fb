"""Vector kernel queries over `embeddings`, each with the SQL that checks it.

A vector's components come out as rows (vec_id, pos, value), rounded to 4 decimals.  Sequences are
runs of ten vectors: sid = vec_id div 10, pos = vec_id mod 10; heads are 4 slices of 16.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from ..functions.weights import weight_sql
from ..operators import relational as rel

H, HEADS, DIM, THETA, EPS = 64, 4, 16, 10000.0, 1e-6


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", vec.doubles(F.col("embedding")).alias("v"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select((F.col("vec_id") / 10).cast("long").alias("sid"), (F.col("vec_id") % 10).alias("pos"), "v")


def r4(c: Column) -> Column:
    return F.round(c, 4) + F.lit(0.0)


def components(df: DataFrame, v: Column, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(v).alias("p", "x")).select(*keys, F.col("p").cast("long").alias("pos"), r4(F.col("x")).alias("value"))


def lit_vector(salt: int, n: int, offset: float = 0.0) -> Column:
    return F.expr(f"transform(sequence(0, {n - 1}), i -> {offset}D + {weight_sql(salt, '0', 'i')})")


def lit_matrix(salt: int, out: int, into: int) -> Column:
    return F.expr(f"transform(sequence(0, {out - 1}), o -> transform(sequence(0, {into - 1}), i -> {weight_sql(salt, 'o', 'i')}))")


X = "x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
T = X + ", t AS (SELECT vec_id // 10 AS sid, vec_id % 10 AS pos, j, j // 16 AS head, j % 16 AS d, x FROM x)"


def _kernel(f, spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(embeddings(spark, sf_dir), f(F.col("v")), "vec_id")


def _elementwise(sql: str) -> str:
    return f"WITH {X} SELECT vec_id, j AS pos, round({sql}, 4) + 0.0 AS value FROM x"


def _windowed(inner: str, outer: str) -> str:
    return f"WITH {X}, y AS (SELECT *, {inner} FROM x WINDOW w AS (PARTITION BY vec_id)) SELECT vec_id, j AS pos, round({outer}, 4) + 0.0 AS value FROM y WINDOW w AS (PARTITION BY vec_id)"


_ERF_T = f"(1.0::DOUBLE / (1.0::DOUBLE + {vec.ERF_P}::DOUBLE * abs(z)))"
_ERF = f"sign(z) * (1.0::DOUBLE - ({_ERF_T} * ({vec.ERF_A[0]}::DOUBLE + {_ERF_T} * ({vec.ERF_A[1]}::DOUBLE + {_ERF_T} * ({vec.ERF_A[2]}::DOUBLE + {_ERF_T} * ({vec.ERF_A[3]}::DOUBLE + {_ERF_T} * {vec.ERF_A[4]}::DOUBLE))))) * exp(-z * z))"


def _erf_sql(x: str) -> str:
    return _ERF.replace("z", f"(({x}) / sqrt(2.0::DOUBLE))")


def gelu_sql(x: str) -> str:
    return f"0.5::DOUBLE * {x} * (1.0::DOUBLE + {_erf_sql(x)})"


def _tanh_sql(x: str) -> str:
    return f"0.5::DOUBLE * {x} * (1.0::DOUBLE + tanh(sqrt(2.0::DOUBLE / pi()) * ({x} + 0.044715::DOUBLE * {x} * {x} * {x})))"


def _gated(sql: str) -> str:
    return f"WITH {X} SELECT a.vec_id, a.j AS pos, round(({sql}) * b.x, 4) + 0.0 AS value FROM x a JOIN x b ON a.vec_id = b.vec_id AND b.j = a.j + 32 WHERE a.j < 32"


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


_add("l2_normalize", partial(_kernel, vec.l2_normalize), _windowed("sqrt(sum(x * x) OVER w) AS n", "CASE WHEN n = 0 THEN x ELSE x / n END"))
_add("vec_norm", lambda s, d: embeddings(s, d).select("vec_id", r4(vec.norm(F.col("v"))).alias("norm")), f"WITH {X} SELECT vec_id, round(sqrt(sum(x * x)), 4) + 0.0 AS norm FROM x GROUP BY 1")
for _d in (32, 16):
    _add(f"matryoshka_{_d}", partial(_kernel, lambda v, d=_d: vec.matryoshka(v, d, H)), f"WITH {X}, y AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS n FROM x WHERE j < {_d}) SELECT vec_id, j AS pos, round(CASE WHEN n = 0 THEN x ELSE x / n END, 4) + 0.0 AS value FROM y")
_add("residual_add", partial(_kernel, lambda v: vec.add(v, F.reverse(v))), f"WITH {X} SELECT a.vec_id, a.j AS pos, round(a.x + b.x, 4) + 0.0 AS value FROM x a JOIN x b ON a.vec_id = b.vec_id AND b.j = 63 - a.j")
_add("add_bias", partial(_kernel, lambda v: vec.add(v, lit_vector(1, H))), _elementwise("x + " + weight_sql(1, "0", "j")))
_add("layer_norm", partial(_kernel, lambda v: vec.layer_norm(v, lit_vector(2, H, 1.0), lit_vector(3, H), EPS)), _windowed("x - avg(x) OVER w AS c", f"c / sqrt(avg(c * c) OVER w + {EPS}) * (1.0::DOUBLE + {weight_sql(2, '0', 'j')}) + {weight_sql(3, '0', 'j')}"))
_add("rms_norm", partial(_kernel, lambda v: vec.rms_norm(v, lit_vector(2, H, 1.0), EPS)), _windowed("1 AS one", f"x / sqrt(avg(x * x) OVER w + {EPS}) * (1.0::DOUBLE + {weight_sql(2, '0', 'j')})"))
_add("rms_norm_unit_offset", partial(_kernel, lambda v: vec.rms_norm(v, vec.unit_offset(lit_vector(4, H)), EPS)), _windowed("1 AS one", f"x / sqrt(avg(x * x) OVER w + {EPS}) * (1.0::DOUBLE + {weight_sql(4, '0', 'j')})"))
_add("softmax", partial(_kernel, vec.softmax), _windowed("exp(x - max(x) OVER w) AS e", "e / sum(e) OVER w"))
_add("gelu_erf", partial(_kernel, lambda v: vec.gelu(F.transform(v, lambda x: x * 8.0))), _elementwise(gelu_sql("(x * 8.0::DOUBLE)")))
_add("erf", partial(_kernel, lambda v: F.transform(v, lambda x: vec.erf(x * 4.0))), _elementwise(_ERF.replace("z", "(x * 4.0::DOUBLE)")))
_add("gelu_tanh", partial(_kernel, lambda v: vec.gelu_tanh(F.transform(v, lambda x: x * 8.0))), _elementwise(_tanh_sql("(x * 8.0::DOUBLE)")))
_add("silu", partial(_kernel, vec.silu), _elementwise("x / (1.0::DOUBLE + exp(-x))"))
_add("swiglu", partial(_kernel, lambda v: vec.swiglu(*vec.halves(v, H))), _gated("a.x / (1.0::DOUBLE + exp(-a.x))"))
_add("geglu", partial(_kernel, lambda v: vec.geglu(*vec.halves(v, H))), _gated(gelu_sql("a.x")))
_add("geglu_tanh", partial(_kernel, lambda v: vec.geglu(*vec.halves(v, H), tanh=True)), _gated(_tanh_sql("a.x")))

# Pooling over sequences.
_add("mean_pool", lambda s, d: rel.mean_pool(tokens(s, d).withColumnRenamed("pos", "at")).select("sid", F.col("pos").cast("long").alias("pos"), r4(F.col("value")).alias("value")), f"WITH {T} SELECT sid, j AS pos, round(avg(x), 4) + 0.0 AS value FROM t GROUP BY 1, 2")
_add("cls_pool", lambda s, d: components(rel.cls_pool(tokens(s, d)), F.col("v"), "sid"), f"WITH {T} SELECT sid, j AS pos, round(x, 4) + 0.0 AS value FROM t WHERE pos = 0")
_add("lasttoken_pool", lambda s, d: components(rel.last_pool(tokens(s, d)), F.col("v"), "sid"), f"WITH {T} SELECT sid, j AS pos, round(x, 4) + 0.0 AS value FROM (SELECT *, max(pos) OVER (PARTITION BY sid) AS last FROM t) WHERE pos = last")

# Positions.


def _rotated(v: Column, pos: Column) -> Column:
    return F.concat(*(vec.rope_apply(F.slice(v, h * DIM + 1, DIM), pos, DIM, THETA) for h in range(HEADS)))


_ANGLE = f"(pos * pow({THETA}::DOUBLE, -2.0::DOUBLE * (d % 8) / 16))"
_R = T + f", r AS (SELECT a.sid, a.pos, a.head, a.d, CASE WHEN a.d < 8 THEN a.x * cos({_ANGLE.replace('pos', 'a.pos').replace('(d ', '(a.d ')}) - b.x * sin({_ANGLE.replace('pos', 'a.pos').replace('(d ', '(a.d ')}) ELSE a.x * cos({_ANGLE.replace('pos', 'a.pos').replace('(d ', '(a.d ')}) + b.x * sin({_ANGLE.replace('pos', 'a.pos').replace('(d ', '(a.d ')}) END AS x FROM t a JOIN t b ON a.sid = b.sid AND a.pos = b.pos AND a.head = b.head AND b.d = (a.d + 8) % 16)"
_add("rope_apply", lambda s, d: components(tokens(s, d).withColumn("at", F.col("pos")), _rotated(F.col("v"), F.col("pos")), "sid", "at"), f"WITH {_R} SELECT sid, pos AS at, head * 16 + d AS pos, round(x, 4) + 0.0 AS value FROM r")


def rope_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.range(128).select(F.col("id").alias("at"), F.posexplode(vec.rope_angles(F.col("id"), DIM, THETA)).alias("d", "t"))
    return df.select("at", F.col("d").cast("long").alias("d"), r4(F.cos("t")).alias("cos"), r4(F.sin("t")).alias("sin"))


_add("rope_table", rope_table, f"SELECT a.at, d, round(cos(a.at * pow({THETA}::DOUBLE, -2.0::DOUBLE * d / 16)), 4) + 0.0 AS cos, round(sin(a.at * pow({THETA}::DOUBLE, -2.0::DOUBLE * d / 16)), 4) + 0.0 AS sin FROM (SELECT range AS \"at\" FROM range(128)) a, range(8) b(d)")


def _bucket_sql(delta: str) -> str:
    return f"(CASE WHEN {delta} > 0 THEN 16 ELSE 0 END + CASE WHEN abs({delta}) < 8 THEN abs({delta}) ELSE least(8 + CAST(floor(ln(abs({delta})::DOUBLE / 8) / ln(16.0::DOUBLE) * 8) AS BIGINT), 15) END)"


_add("rel_pos_bucket", lambda s, d: s.range(-513, 514).select(F.col("id").alias("delta"), vec.rel_pos_bucket(F.col("id")).cast("long").alias("bucket")), f"SELECT delta, CAST({_bucket_sql('delta')} AS BIGINT) AS bucket FROM range(-513, 514) r(delta)")


def rel_bias_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bias by (delta, head) for sequences of ten: the table that a forward pass looks up."""
    table = spark.range(32).select(F.col("id").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(HEADS - 1))).alias("head")).withColumn("bias", F.expr(weight_sql(7, "bucket", "head")))
    deltas = spark.range(-9, 10).select(F.col("id").alias("delta"), vec.rel_pos_bucket(F.col("id")).cast("long").alias("bucket"))
    return deltas.join(F.broadcast(table), "bucket").select("delta", F.col("head").cast("long").alias("head"), r4(F.col("bias")).alias("bias"))


_add("rel_bias_delta", rel_bias_delta, f"SELECT delta, head, round({weight_sql(7, _bucket_sql('delta'), 'head')}, 4) + 0.0 AS bias FROM range(-9, 10) r(delta), range(4) h(head)")

# Matrix products.


def linear_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).select("vec_id", F.posexplode("v").alias("i", "x"))
    weights = spark.range(32 * H).select((F.col("id") / H).cast("int").alias("o"), (F.col("id") % H).cast("int").alias("i")).withColumn("w", F.expr(weight_sql(5, "o", "i")))
    return rel.matmul(rows, weights).select("vec_id", F.col("o").cast("long").alias("o"), r4(F.col("value")).alias("value"))


def _linear_sql(salt: int, out: int, x: str = "x") -> str:
    return f"SELECT vec_id, o, round(sum(x * ({weight_sql(salt, 'o', 'j')})), 4) + 0.0 AS value FROM {x}, range({out}) w(o) GROUP BY 1, 2"


_add("linear_relational", linear_relational, f"WITH {X} {_linear_sql(5, 32)}")


def _outputs(df: DataFrame, v: Column, *keys: str) -> DataFrame:
    return components(df, v, *keys).withColumnRenamed("pos", "o")


_add("linear_hof", lambda s, d: _outputs(embeddings(s, d), vec.linear(F.col("v"), lit_matrix(6, 32, H)), "vec_id"), f"WITH {X} {_linear_sql(6, 32)}")
_add("dense_head", lambda s, d: _outputs(embeddings(s, d).withColumn("u", vec.linear(F.col("v"), lit_matrix(8, 32, H))), vec.linear(F.col("u"), lit_matrix(9, H, 32)), "vec_id"), f"WITH {X}, u AS (SELECT vec_id, o AS j, sum(x * ({weight_sql(8, 'o', 'j')})) AS x FROM x, range(32) w(o) GROUP BY 1, 2) {_linear_sql(9, 64, 'u')}")
_add("qkv_fused", lambda s, d: _outputs(embeddings(s, d), vec.linear(F.col("v"), F.concat(*(lit_matrix(k, 16, H) for k in (10, 11, 12)))), "vec_id"), f"WITH {X} SELECT vec_id, o, round(sum(x * (((o % 16) * 31 + j * 17 + (10 + o // 16) * 101) % 97 - 48) / 480.0::DOUBLE), 4) + 0.0 AS value FROM x, range(48) w(o) GROUP BY 1, 2")

# Attention.


def _attention(spark: SparkSession, sf_dir: str, mask=None, bias=None, kv_heads: int = HEADS, prepare=lambda v, pos: v) -> DataFrame:
    t = tokens(spark, sf_dir)
    h = rel.heads(t, HEADS, DIM)
    q = h.withColumn("v", prepare(F.col("v"), F.col("pos")))
    k = h.filter(F.col("head") < kv_heads).withColumn("u", F.col("v")).withColumn("v", prepare(F.col("v"), F.col("pos")))
    out = rel.attention(q, k, DIM, mask, bias, HEADS // kv_heads)
    return out.select("sid", "pos", F.col("head").cast("long").alias("head"), F.col("d").cast("long").alias("d"), r4(F.col("value")).alias("value"))


def _attention_sql(where: str = "true", bias: str = "0", kv: str = "k.head = q.head", source: str = "t", ctes: str = T) -> str:
    return (
        f"WITH {ctes}, s AS (SELECT q.sid, q.pos, q.head, k.pos AS j, k.head AS kh, sum(q.x * k.x) * 0.25::DOUBLE + any_value({bias}) AS s FROM {source} q JOIN {source} k ON q.sid = k.sid AND q.d = k.d AND {kv} WHERE {where} GROUP BY q.sid, q.pos, q.head, k.pos, k.head), "
        "e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY sid, pos, head)) AS e FROM s), a AS (SELECT *, e / sum(e) OVER (PARTITION BY sid, pos, head) AS a FROM e) "
        "SELECT a.sid, a.pos, a.head, v.d, round(sum(a.a * v.x), 4) + 0.0 AS value FROM a JOIN t v ON a.sid = v.sid AND a.j = v.pos AND a.kh = v.head GROUP BY 1, 2, 3, 4"
    )


_N = T + f", n AS (SELECT sid, pos, head, d, x / sqrt(avg(x * x) OVER (PARTITION BY sid, pos, head) + {EPS}) * (1.0::DOUBLE + {weight_sql(13, '0', 'd')}) AS x FROM t)"
_add("attn_full", _attention, _attention_sql())
_add("attn_causal", partial(_attention, mask=lambda i, j: j <= i), _attention_sql("k.pos <= q.pos"))
_add("attn_window_incl", partial(_attention, mask=lambda i, j: F.abs(i - j) <= 2), _attention_sql("abs(q.pos - k.pos) <= 2"))
_add("attn_window_excl", partial(_attention, mask=lambda i, j: F.abs(i - j) < 2), _attention_sql("abs(q.pos - k.pos) < 2"))
_add("attn_gqa_qknorm", partial(_attention, mask=lambda i, j: F.abs(i - j) < 4, kv_heads=2, prepare=lambda v, pos: vec.rms_norm(v, lit_vector(13, DIM, 1.0), EPS)), _attention_sql("abs(q.pos - k.pos) < 4", kv="k.head = q.head // 2", source="n", ctes=_N))
_add("attn_relbias", partial(_attention, bias=lambda i, j: (vec.rel_pos_bucket(j - i) * 31 + F.col("head") * 17 + 707) % 97 / F.lit(480.0) - F.lit(48 / 480.0)), _attention_sql(bias=f"({_bucket_sql('(k.pos - q.pos)')} * 31 + q.head * 17 + 707) % 97 / 480.0::DOUBLE - 0.1::DOUBLE"))
_add("attn_rope", partial(_attention, prepare=lambda v, pos: vec.rope_apply(v, pos, DIM, THETA)), _attention_sql(source="r", ctes=_R))

# Quantisation.


def _weight_rows(spark: SparkSession) -> DataFrame:
    return spark.range(32).select("id", lit_matrix(14, 32, H)[F.col("id").cast("int")].alias("w"))


def quant_w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _weight_rows(spark).withColumn("scale", vec.weight_scale(F.col("w")))
    return df.select(F.col("id").alias("o"), F.posexplode(vec.quantize_weight(F.col("w"), F.col("scale"))).alias("i", "q"), F.round(F.col("scale").cast("double") * 1000, 4).alias("scale")).select("o", F.col("i").cast("long").alias("i"), F.col("q").cast("long").alias("q"), "scale")


_WQ = f"w AS (SELECT o, i, {weight_sql(14, 'o', 'i')} AS w FROM range(32) a(o), range(64) b(i)), ws AS (SELECT *, CAST(max(abs(w)) OVER (PARTITION BY o) AS FLOAT) / CAST(127 AS FLOAT) AS s FROM w), wq AS (SELECT o, i, w, s, CAST(greatest(-127, least(127, round_even(w / CAST(s AS DOUBLE), 0))) AS BIGINT) AS q FROM ws)"
_AQ = ", xs AS (SELECT *, CASE WHEN max(abs(x)) OVER (PARTITION BY vec_id) = 0 THEN CAST(1 AS FLOAT) ELSE CAST(max(abs(x)) OVER (PARTITION BY vec_id) AS FLOAT) / CAST(127 AS FLOAT) END AS s FROM x), xq AS (SELECT vec_id, j, x, s, CAST(greatest(0, least(255, round_even(CAST(CAST(x AS FLOAT) * (CAST(1 AS FLOAT) / s) AS DOUBLE), 0) + 128)) AS BIGINT) AS u FROM xs)"
_add("quant_w8", quant_w8, f"WITH {_WQ} SELECT o, i, q, round(CAST(s AS DOUBLE) * 1000, 4) AS scale FROM wq")


def quant_a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir).withColumn("scale", vec.activation_scale(F.col("v")))
    return df.select("vec_id", F.posexplode(vec.quantize_activation(F.col("v"), F.col("scale"))).alias("p", "q"), F.round(F.col("scale").cast("double") * 1000, 4).alias("scale")).select("vec_id", F.col("p").cast("long").alias("pos"), F.col("q").cast("long").alias("q"), "scale")


_add("quant_a8", quant_a8, f"WITH {X}{_AQ} SELECT vec_id, j AS pos, u AS q, round(CAST(s AS DOUBLE) * 1000, 4) AS scale FROM xq")


def _quantized(spark: SparkSession, sf_dir: str, full: bool) -> DataFrame:
    scale = vec.weight_scale_double if full else vec.weight_scale
    w = _weight_rows(spark).withColumn("ws", scale(F.col("w"))).withColumn("wq", vec.quantize_weight(F.col("w"), F.col("ws"))).withColumnRenamed("id", "o")
    x = embeddings(spark, sf_dir)
    packed = F.broadcast(w.agg(F.sort_array(F.collect_list(F.struct("o", "wq", "ws"))).alias("rows")))
    if full:
        x = x.withColumn("us", vec.activation_scale(F.col("v"))).withColumn("u", vec.quantize_activation(F.col("v"), F.col("us")))
        one = lambda r: vec.full_int8_linear(F.col("u"), r["wq"], F.col("us"), r["ws"].cast("float"))
    else:
        one = lambda r: vec.int8_linear(F.col("v"), r["wq"], r["ws"])
    # the weights are one row of fixed size, so this join is a column added to each vector
    return x.join(packed, F.lit(True)).withColumn("y", F.transform("rows", one))


#: Full int8 quantises by the double quotient; the scale itself is kept in single precision.
_WQ_FULL = f"w AS (SELECT o, i, {weight_sql(14, 'o', 'i')} AS w FROM range(32) a(o), range(64) b(i)), ws AS (SELECT *, max(abs(w)) OVER (PARTITION BY o) / 127.0::DOUBLE AS s FROM w), wq AS (SELECT o, i, w, CAST(s AS FLOAT) AS s, CAST(greatest(-127, least(127, round_even(w / s, 0))) AS BIGINT) AS q FROM ws)"
_add("linear_w8", lambda s, d: _outputs(_quantized(s, d, False), F.col("y"), "vec_id"), f"WITH {X}, {_WQ} SELECT vec_id, o, round(sum(x * q) * CAST(any_value(wq.s) AS DOUBLE), 4) + 0.0 AS value FROM x JOIN wq ON x.j = wq.i GROUP BY 1, 2")
_FULL = "f AS (SELECT xq.vec_id, wq.o, (sum(xq.u * wq.q) - 128 * sum(wq.q))::DOUBLE * CAST(any_value(xq.s) AS DOUBLE) * CAST(any_value(wq.s) AS DOUBLE) AS y, sum(xq.x * wq.w) AS z FROM xq JOIN wq ON xq.j = wq.i GROUP BY 1, 2)"
_add("linear_w8a8", lambda s, d: _outputs(_quantized(s, d, True), F.col("y"), "vec_id"), f"WITH {X}{_AQ}, {_WQ_FULL}, {_FULL} SELECT vec_id, o, round(y, 4) + 0.0 AS value FROM f")


def quant_w8_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of full int8: quotients by the double scale, the scale in single precision, and each row's sum."""
    df = _weight_rows(spark).withColumn("s", vec.weight_scale_double(F.col("w"))).withColumn("q", vec.quantize_weight(F.col("w"), F.col("s")))
    return df.select(F.col("id").alias("o"), F.array_join("q", ",").alias("q"), F.round(F.col("s").cast("float").cast("double") * 1000, 4).alias("scale"), F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


_add("quant_w8_full", quant_w8_full, f"WITH {_WQ_FULL} SELECT o, string_agg(q, ',' ORDER BY i) AS q, round(CAST(any_value(s) AS DOUBLE) * 1000, 4) AS scale, CAST(sum(q) AS BIGINT) AS total FROM wq GROUP BY o")


def quant_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full int8 against double precision: largest and mean difference, cosine."""
    df = _quantized(spark, sf_dir, True).withColumn("z", vec.linear(F.col("v"), lit_matrix(14, 32, H)))
    gap = F.zip_with("y", "z", lambda a, b: F.abs(a - b))
    return df.select("vec_id", r4(F.array_max(gap)).alias("max_abs"), r4(vec.total(gap) / F.size(gap)).alias("mean_abs"), r4(vec.cosine(F.col("y"), F.col("z"))).alias("cosine"))


_add("quant_drift", quant_drift, f"WITH {X}{_AQ}, {_WQ_FULL}, {_FULL} SELECT vec_id, round(max(abs(y - z)), 4) + 0.0 AS max_abs, round(avg(abs(y - z)), 4) + 0.0 AS mean_abs, round(sum(y * z) / (sqrt(sum(y * y)) * sqrt(sum(z * z))), 4) + 0.0 AS cosine FROM f GROUP BY 1")


def _decoded(f, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.range(65536).select(F.col("id").alias("bits"), f(F.col("id")).alias("x"))
    kind = F.when(F.isnan("x"), "nan").when(F.abs("x") == float("inf"), "inf").otherwise("finite")
    return df.select("bits", kind.alias("kind"), F.when(F.isnan("x") | (F.abs("x") == float("inf")), 0.0).otherwise(F.lit(0.0) + F.signum("x") * F.round(F.log2(F.when(F.col("x") == 0, 1.0).otherwise(F.abs("x"))), 6) + 0.0).alias("signed_log2"))


def _decode_sql(exp_bits: int, man_bits: int) -> str:
    top, bias = (1 << exp_bits) - 1, (1 << exp_bits - 1) - 1
    return (
        f"WITH p AS (SELECT bits, CASE WHEN bits >= 32768 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sg, (bits // {1 << man_bits}) % {1 << exp_bits} AS e, bits % {1 << man_bits} AS m FROM range(65536) r(bits)), "
        f"v AS (SELECT bits, e, m, sg, CASE WHEN e = {top} THEN 0.0::DOUBLE WHEN e = 0 THEN m * pow(2.0::DOUBLE, {1 - bias - man_bits}) ELSE (1 + m / {1 << man_bits}.0::DOUBLE) * pow(2.0::DOUBLE, e - {bias}) END AS a FROM p) "
        f"SELECT bits, CASE WHEN e = {top} AND m > 0 THEN 'nan' WHEN e = {top} THEN 'inf' ELSE 'finite' END AS kind, CASE WHEN a = 0 THEN 0.0::DOUBLE ELSE sg * round(log2(a), 6) END + 0.0 AS signed_log2 FROM v"
    )


_add("f16_decode", partial(_decoded, vec.half_to_double), _decode_sql(5, 10))
_add("bf16_decode", partial(_decoded, vec.bfloat_to_double), _decode_sql(8, 7))
_add("pack_layout", lambda s, d: s.range(1000).select(F.col("id").alias("n"), vec.aligned(F.col("id")).alias("aligned"), vec.rows_padded(F.col("id")).alias("padded"), vec.elements(F.array(F.col("id"), F.lit(3).cast("long"), F.lit(2).cast("long"))).alias("elements")), "SELECT n, (n + 63) // 64 * 64 AS aligned, (n + 11) // 12 * 12 AS padded, n * 6 AS elements FROM range(1000) r(n)")

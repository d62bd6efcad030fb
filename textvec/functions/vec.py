"""Vector kernels as Column expressions over array<double> columns.

Each function takes and returns Columns, so kernels compose into one projection without a shuffle
or a Python worker.  Arithmetic is in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abramowitz and Stegun 7.1.26 (fixed values): p, and a1 to a5.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda evaluates what it captures for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    return let(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def matryoshka(v: Column, d: int, full: int) -> Column:
    """The first d of `full` values, renormalised; d equal to full, or 0, leaves v alone."""
    if not 0 <= d <= full:
        raise ValueError(f"dim {d} is not between 1 and {full}")
    return v if d in (0, full) else l2_normalize(F.slice(v, 1, d))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def mul(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def layer_norm(v: Column, gamma: Column, beta: Column, eps: float) -> Column:
    n = F.size(v).cast("double")
    centred = let(total(v) / n, lambda mean: F.transform(v, lambda x: x - mean))
    scaled = let(centred, lambda c: let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x) / n + eps), lambda s: F.transform(c, lambda x: x / s)))
    return add(mul(scaled, gamma), beta)


def rms_norm(v: Column, gamma: Column, eps: float) -> Column:
    n = F.size(v).cast("double")
    scale = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x) / n + eps)
    return let(scale, lambda s: F.zip_with(v, gamma, lambda x, g: x / s * g))


def unit_offset(gamma: Column) -> Column:
    return F.transform(gamma, lambda g: g + 1.0)


def softmax(v: Column) -> Column:
    raised = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return let(raised, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def erf(x: Column) -> Column:
    """Polynomial erf, so that all engines agree (absolute error under 2e-7)."""
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    poly = t * (ERF_A[0] + t * (ERF_A[1] + t * (ERF_A[2] + t * (ERF_A[3] + t * ERF_A[4]))))
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def gelu_of(x: Column) -> Column:
    return 0.5 * x * (1.0 + erf(x / math.sqrt(2.0)))


def gelu(v: Column) -> Column:
    return F.transform(v, gelu_of)


def gelu_tanh(v: Column) -> Column:
    return F.transform(v, lambda x: 0.5 * x * (1.0 + F.tanh(math.sqrt(2.0 / math.pi) * (x + 0.044715 * x * x * x))))


def silu(v: Column) -> Column:
    return F.transform(v, lambda x: x / (1.0 + F.exp(-x)))


def halves(v: Column, n: int) -> tuple[Column, Column]:
    return F.slice(v, 1, n // 2), F.slice(v, n // 2 + 1, n // 2)


def swiglu(gate: Column, up: Column) -> Column:
    return mul(silu(gate), up)


def geglu(gate: Column, up: Column, tanh: bool = False) -> Column:
    return mul(gelu_tanh(gate) if tanh else gelu(gate), up)


def linear(v: Column, weight: Column) -> Column:
    """weight: array of rows, one per output."""
    return F.transform(weight, lambda row: dot(row, v))


def literal_matrix(rows: list[list[float]]) -> Column:
    return F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in rows))


# Rotary positions.


def rope_angles(pos: Column, head_dim: int, theta: float) -> Column:
    return F.array(*(pos.cast("double") * F.pow(F.lit(float(theta)), F.lit(-2.0 * d / head_dim)) for d in range(head_dim // 2)))


def rope_apply(v: Column, pos: Column, head_dim: int, theta: float) -> Column:
    """Rotate-half of one head."""
    a, b = halves(v, head_dim)
    angles = rope_angles(pos, head_dim, theta)
    cos, sin = F.transform(angles, lambda t: F.cos(t)), F.transform(angles, lambda t: F.sin(t))
    first = F.zip_with(mul(a, cos), mul(b, sin), lambda x, y: x - y)
    second = F.zip_with(mul(b, cos), mul(a, sin), lambda x, y: x + y)
    return F.concat(first, second)


# Relative positions, in the T5 manner.


def rel_pos_bucket(delta: Column, buckets: int = 32, horizon: int = 128) -> Column:
    """Bucket of key position less query position: exact for small distances, logarithmic beyond."""
    half = buckets // 2
    exact = half // 2
    away = F.abs(delta)
    log = exact + F.floor(F.log(away.cast("double") / exact) / math.log(horizon / exact) * (half - exact))
    inside = F.when(away < exact, away.cast("long")).otherwise(F.least(log, F.lit(half - 1)))
    return F.when(delta > 0, half).otherwise(0) + inside


# Quantisation.


def _absmax(v: Column) -> Column:
    return F.array_max(F.transform(v, lambda x: F.abs(x)))


def weight_scale(row: Column) -> Column:
    """absmax / 127 in single precision, 1 for a zero row."""
    top = _absmax(row).cast("float")
    return F.when(top == 0, F.lit(1.0).cast("float")).otherwise((top / F.lit(127.0)).cast("float"))


def quantize_weight(row: Column, scale: Column) -> Column:
    """Half-even rounding of the double quotient, within -127 and 127."""
    return F.transform(row, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x / scale.cast("double")))).cast("tinyint"))


def weight_scale_double(row: Column) -> Column:
    """The second convention: absmax / 127 in double precision."""
    top = _absmax(row)
    return F.when(top == 0, F.lit(1.0)).otherwise(top / 127.0)


def activation_scale(v: Column) -> Column:
    return weight_scale(v)


def quantize_activation(v: Column, scale: Column) -> Column:
    """Unsigned bytes with offset 128, by the single-precision reciprocal."""
    inverse = (F.lit(1.0) / scale.cast("double")).cast("float")
    return F.transform(v, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint((x.cast("float") * inverse).cast("double")) + 128.0)).cast("smallint"))


def int8_linear(v: Column, q: Column, scale: Column) -> Column:
    """One output of weight-only int8: sum of v q, times the row's scale."""
    return total(F.zip_with(v, q, lambda x, y: x * y.cast("double"))) * scale.cast("double")


def full_int8_linear(u: Column, q: Column, u_scale: Column, q_scale: Column) -> Column:
    """One output of full int8: integers first, the offset's share taken off, then both scales."""
    acc = F.aggregate(F.zip_with(u, q, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda a, x: a + x)
    offset = F.aggregate(q, F.lit(0), lambda a, x: a + x.cast("int"))
    return (acc - 128 * offset).cast("double") * u_scale.cast("double") * q_scale.cast("double")


# Storage formats.


def half_to_double(h: Column) -> Column:
    """The value of a 16-bit float given as an integer."""
    sign = F.when(h.bitwiseAND(0x8000) != 0, -1.0).otherwise(1.0)
    e = F.shiftright(h, 10).bitwiseAND(31)
    m = h.bitwiseAND(1023).cast("double")
    inf = F.when(m != 0, F.lit(float("nan"))).otherwise(sign * F.lit(float("inf")))
    return F.when(e == 0, sign * m * 2.0**-24).when(e == 31, inf).otherwise(sign * (1 + m / 1024) * F.pow(F.lit(2.0), e - 15))


def bfloat_to_double(h: Column) -> Column:
    """The value of a bfloat16 given as an integer: the upper half of a single."""
    sign = F.when(h.bitwiseAND(0x8000) != 0, -1.0).otherwise(1.0)
    e = F.shiftright(h, 7).bitwiseAND(255)
    m = h.bitwiseAND(127).cast("double")
    inf = F.when(m != 0, F.lit(float("nan"))).otherwise(sign * F.lit(float("inf")))
    return F.when(e == 0, sign * m * 2.0**-133).when(e == 255, inf).otherwise(sign * (1 + m / 128) * F.pow(F.lit(2.0), e - 127))


# Pack layout.


def rows_padded(m: Column, step: int = 12) -> Column:
    return F.floor((m + step - 1) / step) * step


def aligned(n: Column, step: int = 64) -> Column:
    return F.shiftleft(F.shiftright(n + step - 1, 6), 6) if step == 64 else F.ceil(n / step) * step


def elements(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, d: a * d)

"""Tail probabilities of small result tables: Student's t, the normal distribution, the sign test.

Spark SQL has neither the incomplete beta nor the error function, so these few rows go through
Arrow; the statistics themselves are aggregates in the JVM.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction on the side where it converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 20_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            out *= step
        if abs(step - 1) < 1e-15:
            break
    return front * out


def t_two_sided(t: float | None, df: float | None) -> float | None:
    """P(|T| >= |t|) with ``df`` degrees of freedom; null for null, NaN or df <= 0."""
    if t is None or df is None or t != t or df != df or df <= 0:
        return None
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def sign_two_sided(k: int | None, n: int | None) -> float | None:
    """Exact two-sided binomial test of k in n at one half; null for n = 0."""
    if k is None or not n:
        return None
    low = min(k, n - k)
    if 2 * low == n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(low + 1)]
    return min(1.0, 2 * math.fsum(map(math.exp, logs)))


@F.arrow_udf(DoubleType())
def student_t_p(t: pa.Array, df: pa.Array) -> pa.Array:
    return pa.array([t_two_sided(a, b) for a, b in zip(t.to_pylist(), df.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(DoubleType())
def normal_p(z: pa.Array) -> pa.Array:
    """P(|Z| >= |z|)."""
    return pa.array([None if x is None or x != x else math.erfc(abs(x) / math.sqrt(2)) for x in z.to_pylist()], pa.float64())


@F.arrow_udf(DoubleType())
def sign_test_p(k: pa.Array, n: pa.Array) -> pa.Array:
    return pa.array([sign_two_sided(a, b) for a, b in zip(k.to_pylist(), n.to_pylist(), strict=True)], pa.float64())

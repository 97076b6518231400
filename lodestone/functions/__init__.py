"""Scalar functions as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a, b) -> Column:
    """Distance; null where the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.sqrt(squared_distance(a, b)))


def scale(a, by) -> Column:
    return F.transform(a, lambda x: x * by)


def add(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sorted_letters(word) -> Column:
    return F.array_join(F.array_sort(F.split(word, "")), "")


def subsets(items) -> Column:
    """All non-empty subsets of a sorted array, in the array's order; grows as 2 to the number of items."""
    n = F.size(items)
    masks = F.sequence(F.lit(1).cast("long"), F.pow(F.lit(2.0), n).cast("long") - 1)
    pick = lambda m: F.filter(items, lambda _, i: (F.floor(m / F.pow(F.lit(2.0), i)) % 2) == 1)
    return F.when(n > 0, F.transform(masks, pick)).otherwise(F.array().cast("array<array<string>>"))


def polynomial_hash(word, seed: int = 1125899906842597) -> Column:
    """h = 31 * h + code of each character, modulo 2**64, as a signed long."""
    whole = F.lit(str(1 << 64)).cast("decimal(38,0)")
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c))
    step = lambda h, c: ((h * 31 + c) % whole).cast("decimal(38,0)")
    h = F.aggregate(codes, F.lit(seed).cast("decimal(38,0)"), step)
    return F.when(h >= whole / 2, h - whole).otherwise(h).cast("long")


def bucket(h, n: int) -> Column:
    """abs(h) modulo n, the number of a hash partition."""
    return F.abs(h % n)


def category_code(column, names: list[str]) -> Column:
    """Place of the value among ``names``, from 0; null for others."""
    at = F.array_position(F.array(*map(F.lit, names)), F.col(column) if isinstance(column, str) else column)
    return F.when(at > 0, at - 1)


def without_index(items, i) -> Column:
    return F.filter(items, lambda _, j: j != i)


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient, 0 outside 0 <= k <= n."""
    product = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1.0), lambda a, i: a * (n - k + i) / i)
    return F.when((k < 0) | (k > n), 0.0).when(k == 0, 1.0).otherwise(F.round(product))


def pearson(x, y) -> Column:
    """Correlation as an aggregate, from centred moments; null where a variance is zero."""
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return within_one(F.try_divide(F.covar_pop(x, y), F.when(spread > 0, spread)))


def within_one(r: Column) -> Column:
    """A correlation without the last digit's error beyond 1; null stays null, which greatest and least would skip."""
    return F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for _ in range(10):  # up to where the asymptotic series is exact to double precision
        shift += np.where(x < 10, np.log(x), 0.0)
        x = np.where(x < 10, x + 1, x)
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7) + 1 / (1188 * x**9)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * c * d
    value = np.where(x <= 0, 0.0, front * out)
    return np.where(flip, 1 - value, value)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@F.arrow_udf(DoubleType())
def t_p_value(t: pa.Array, df: pa.Array) -> pa.Array:
    """p as a column; null where t or df is null or df is not positive."""
    x, n = t.to_numpy(zero_copy_only=False).astype(float), df.to_numpy(zero_copy_only=False).astype(float)
    ok = np.isfinite(x) & np.isfinite(n) & (n > 0)
    out = np.full(len(x), np.nan)
    out[ok] = t_two_sided(x[ok], n[ok])
    return pa.array(out, mask=~ok)

"""Statistical tails and corrections, as Column expressions or Arrow functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranking import numbered, suffix_min

# --- fixed values: coefficients of the error function's rational approximation (Abramowitz and
# Stegun 7.1.26) ---------------------------------------------------------------------------------
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
# -------------------------------------------------------------------------------------------------


def erf(x: Column) -> Column:
    """Error function, to 1.5e-7."""
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    return (1 + erf(z / math.sqrt(2))) / 2


def two_sided(z: Column) -> Column:
    """Two-sided normal p value."""
    return 2 * (1 - normal_cdf(F.abs(z)))


ERF_SQL = "(1 - ((((1.061405429 * t + -1.453152027) * t + 1.421413741) * t + -0.284496736) * t + 0.254829592) * t * exp(-v * v))"


def two_sided_sql(z: str) -> str:
    """The same expression for DuckDB."""
    v = f"(abs({z}) / 1.4142135623730951)"
    return "2 * (1 - (1 + " + ERF_SQL.replace("* t", f"* (1 / (1 + 0.3275911 * {v}))").replace("-v * v", f"-{v} * {v}") + ") / 2)"


def chi2_sf_1(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom: erfc(sqrt(x / 2))."""
    return 1 - erf(F.sqrt(F.greatest(x, F.lit(0.0)) / 2))


def lower_gamma(s: float, x: float) -> float:
    """Regularised lower incomplete gamma, by series or continued fraction."""
    if x <= 0:
        return 0.0
    scale = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        n = s
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * scale
    tiny = 1e-300
    b = x + 1 - s
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        a = -i * (i - s)
        b += 2
        d = 1 / (d * a + b or tiny)
        c = b + a / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def chi2_sf(x: float, df: float) -> float:
    return 1 - lower_gamma(df / 2, x / 2)


def chi2_isf(p: float, df: float) -> float:
    """The x whose upper tail is p, by bisection."""
    if p >= 1:
        return 0.0
    lo, hi = 0.0, max(df, 1.0)
    while chi2_sf(hi, df) > p and hi < 1e12:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if chi2_sf(mid, df) > p:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-12 * hi:
            break
    return (lo + hi) / 2


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric_tail(hits: int, draws: int, good: int, total: int) -> float:
    """P(at least ``hits`` good ones among ``draws`` of ``total``)."""
    top = min(draws, good)
    if hits <= max(0, draws + good - total):
        return 1.0
    if hits > top:
        return 0.0
    base = log_choose(total, draws)
    return min(1.0, math.fsum(math.exp(log_choose(good, k) + log_choose(total - good, draws - k) - base) for k in range(hits, top + 1)))


def _hypergeometric_batch(hits: pd.Series, draws: pd.Series, good: pd.Series, total: pd.Series) -> pd.Series:
    seen: dict[tuple, float] = {}
    out = []
    for key in zip(hits.tolist(), draws.tolist(), good.tolist(), total.tolist(), strict=True):
        if key not in seen:
            seen[key] = hypergeometric_tail(*map(int, key))
        out.append(seen[key])
    return pd.Series(out)


def hypergeometric_sf(hits, draws, good, total) -> Column:
    """The upper tail for columns, in Arrow batches."""
    return F.pandas_udf(_hypergeometric_batch, "double")(hits, draws, good, total)


def _correlation_batch(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(student_p(r.to_numpy(float), n.to_numpy(float)))


def correlation_p(r, n) -> Column:
    """Two-sided p of a correlation of n pairs, from Student's t through the incomplete beta function."""
    return F.pandas_udf(_correlation_batch, "double")(r, n)


def student_p(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of correlations of n pairs each; 1 for fewer than three pairs and where r is NaN."""
    r, n = np.broadcast_arrays(np.asarray(r, float), np.asarray(n, float))
    out = np.where(np.abs(r) >= 1, 0.0, 1.0)
    ok = (n >= 3) & (np.abs(r) < 1)
    out[(n < 3) | np.isnan(r)] = 1.0
    df, square = n[ok] - 2, r[ok] ** 2
    out[ok] = incomplete_beta(df / 2, 0.5, 1 - square)  # df / (df + t^2) is 1 - r^2
    return out


def incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (Lentz), elementwise."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = (x >= 1).astype(float)
    inside = (x > 0) & (x < 1)
    swap = inside & (x > (a + 1) / (a + b + 2))
    out[inside & ~swap] = _beta_fraction(a[inside & ~swap], np.full(int((inside & ~swap).sum()), b), x[inside & ~swap])
    out[swap] = 1 - _beta_fraction(np.full(int(swap.sum()), b), a[swap], 1 - x[swap])
    return out


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    pairs = np.unique(np.stack([a, b], 1), axis=0, return_inverse=True) if len(a) else (np.zeros((0, 2)), np.zeros(0, int))
    log_beta = np.array([math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) for p, q in pairs[0]])  # few distinct ones
    front = np.exp(log_beta[pairs[1].ravel()] + a * np.log(x) + b * np.log1p(-x)) if len(a) else np.zeros(0)
    tiny = 1e-300
    safe = lambda v: np.where(v == 0, tiny, v)
    c = np.ones_like(x)
    d = 1 / safe(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / safe(1 + num * d)
            c = safe(1 + num / c)
            step = d * c
            h = h * step
        if (np.abs(step - 1) < 1e-15).all():
            break
    return front * h / a


def benjamini_hochberg(df: DataFrame, p: str, *group: str, out: str = "fdr") -> DataFrame:
    """Adds the BH-corrected p: the suffix minimum of p * n / rank, at most 1; ties share the largest rank.

    Groups are ordered by themselves; without them all rows are, in ranges.
    """
    if not group:
        n = F.broadcast(df.agg(F.count("*").alias("_n")))
        placed = numbered(df, p, F.xxhash64(*df.columns), out="_r").join(n)
        return suffix_min(placed, "_r", F.least(F.lit(1.0), F.col(p) * F.col("_n") / F.col("_r")), out).drop("_n", "_r")
    w = W.partitionBy(*group)
    ranked = df.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(p)))
    back = w.orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(back))).drop("_n", "_r")

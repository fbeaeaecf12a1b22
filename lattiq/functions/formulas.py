"""Closed-form scores and weights as Column expressions."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

ln = F.log


def _f(x) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else x.cast("double")


def rounded(x: Column, digits: int = 6) -> Column:
    """The same as ``F.round`` of a double, bit by bit, without a decimal for each value, which takes most of the time of a score.

    Whole numbers over a power of ten are the nearest doubles in both; values large, not finite or near a tie take ``F.round``."""
    scale = F.lit(10.0**digits)
    big = F.abs(x) * scale
    whole = F.floor(big)
    part = big - whole
    near = (whole + F.when(part > 0.5, 1).otherwise(0)).cast("double") / scale
    plain = (big < 1e12) & (F.abs(part - 0.5) > 1e-3)
    return F.when(plain, F.when((x < 0) & (near > 0), -near).otherwise(near)).otherwise(F.round(x, digits))


def rounded_array(x: np.ndarray, digits: int = 9) -> np.ndarray:
    """``rounded`` of an array of numbers from 0 to 1000; those near a tie are rounded as decimals, as ``F.round`` does."""
    big = x * 10.0**digits
    whole = np.floor(big)
    part = big - whole
    out = (whole + (part > 0.5)) / 10.0**digits
    near = np.abs(part - 0.5) <= 1e-3
    if near.any():
        values, at = np.unique(x[near], return_inverse=True)
        step = Decimal(1).scaleb(-digits)
        out[near] = np.array([float(Decimal(repr(float(v))).quantize(step, ROUND_HALF_UP)) for v in values])[at]
    return out


def count_scores(c: Column, d: Column, t: Column, total: Column) -> dict[str, Column]:
    """Scores of a candidate with c confirmed and d denied of its t findings; total: the case's confirmed."""
    c, d, t, total = (_f(x) for x in (c, d, t, total))
    dcov, scov, den = c / (t + 0.1), c / (total + 0.1), d / F.greatest(t, F.lit(1.0))
    v18 = c / (t + 1) * c
    return {
        "v4": dcov * scov * (1 - den) ** 2, "v5": dcov * scov * (1 - 0.3 * den), "v6": dcov * scov,
        "v7": c - 0.5 * d, "v8": c * c / ((t + 1) * (total + 1)) * (1 - d / (t + 1)), "v9": ln(c + 1) - 0.5 * ln(d + 1),
        "v10": c / (t + 0.1) * (1 - d / (t + 0.1)), "v11": c * (1 - 0.1 * d), "v12": F.sqrt(c) * (1 - 0.2 * d / (t + 1)),
        "v13": F.sqrt(dcov) * F.sqrt(scov) * (1 - 0.3 * d / (t + 1)), "v15": c / (c + d + 1) * c, "v16": c * c / (c + d + 1), "v17": c - 0.3 * d,
        "v18": v18, "v19": c * (1 - d / (t + 1)), "v20": ln(c + 1) / ln(d + 2), "v21": c * c / (c + 0.5 * d + 1), "v22": c / F.sqrt(d + 1),
        "v23": v18 * (1 - 0.1 * d / (t + 1)), "v24": v18 * (1 - 0.2 * d / (t + 1)), "v25": v18 - 0.05 * d, "v26": c * c / (t + 0.3 * d + 1),
        "v27": c / (t + 1) * c / (c + d + 1) * c,
    }


def clamped_scores(c: Column, d: Column, t: Column, n_diseases: float, n_findings: float) -> dict[str, Column]:
    """The first family: count-based approximations, none below zero."""
    c, d, t = (_f(x) for x in (c, d, t))
    p = c / t
    raw = {
        "jaccard": c / (c + d + t - c), "tfidf": c / t * ln(n_diseases / (1 + c)), "cosine": c / (F.sqrt(t) * F.sqrt(c + d + 0.01)),
        "bm25": c * 2.2 / (c + 1.2 * (0.25 + 0.75 * t / (n_findings / n_diseases))) - 0.1 * d, "nb": c * ln(F.greatest(p, F.lit(0.01))) + d * ln(F.greatest(1 - p, F.lit(0.01))),
    }
    return {k: F.greatest(v, F.lit(0.0)) for k, v in raw.items()}


def corrected_scores(c: Column, d: Column, t: Column, n: float = 49, findings: float = 223, mean_t: float = 18.1) -> dict[str, Column]:
    """The second family: naive Bayes, BM25, log-likelihood ratio, IDF only, noisy OR."""
    c, d, t = (_f(x) for x in (c, d, t))
    share = d / F.greatest(c + d, F.lit(1.0))
    idf = ln(1 + (n - t + 0.5) / (t + 0.5))
    tf = c * 2.2 / (c + 1.2 * (1 - 0.75 + 0.75 * t / mean_t))
    part = lambda k: F.when(k > 0, k * ln((k / t) / (k / findings))).otherwise(0.0)
    return {
        "nb": c * math.log(0.8 / 0.1) + d * math.log(0.2 / 0.9), "bm25": tf * idf * (1 - 0.5 * share),
        "llr": F.when((c == 0) | (t == 0), -999.0).otherwise(part(c) + part(d)), "idf": c * idf * (1 - 0.3 * share),
        "noisy_or": c * math.log(0.715 / 0.05) + d * math.log(0.285 / 0.95),
    }


IDF = {
    "smooth": lambda n, df: ln((n + 1.0) / (df + 1.0)) + 1, "plain": lambda n, df: ln(n / df), "plus_df": lambda n, df: ln(n / (df + 1.0)) + 1,
    "plus_one": lambda n, df: ln(n / df + 1.0), "floor": lambda n, df: F.greatest(F.lit(0.1), ln(n / df)),
}


def hill(w: Column, kappa: float = 20.0) -> Column:
    return w / (w + kappa)


def self_aware(idf: Column, tau: float, sharpness: float) -> Column:
    """Weight that fades out common findings."""
    return 1 / (1 + F.exp((idf - tau) / sharpness))


def reweight(p: Column, idf: Column, alpha: float = 1.0, beta: float = 0.75, pmi: Column | None = None, gamma: float = 0.0) -> Column:
    out = F.pow(p, F.lit(alpha)) * F.pow(idf, F.lit(beta))
    return out if pmi is None else out * F.pow(1 + pmi, F.lit(gamma))


def jensen(c_ab: Column, c_a: Column, c_b: Column, n: Column, alpha: float = 0.6) -> Column:
    """Co-mention score C^a (C N / (Ca Cb))^(1-a); 0 unless all counts are positive."""
    ok = (c_ab > 0) & (c_a > 0) & (c_b > 0) & (n > 0)
    return F.when(ok, F.pow(_f(c_ab), F.lit(alpha)) * F.pow(_f(c_ab) * n / (_f(c_a) * c_b), F.lit(1 - alpha))).otherwise(0.0)


def g2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Dunning's log-likelihood ratio of a 2x2 table; empty cells are skipped."""
    a, b, c, d = (_f(x) for x in (a, b, c, d))
    n = a + b + c + d
    part = lambda o, e: F.when((o > 0) & (e > 0), o * ln(F.when((o > 0) & (e > 0), o / F.when(e > 0, e)))).otherwise(0.0)
    safe = F.when(n > 0, n)
    return 2 * (part(a, (a + b) * (a + c) / safe) + part(b, (a + b) * (b + d) / safe) + part(c, (c + d) * (a + c) / safe) + part(d, (c + d) * (b + d) / safe))


def signed_g2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """G2, negative where the pair occurs less often than chance."""
    value, n = g2(a, b, c, d), _f(a) + b + c + d
    return F.when(_f(a) * n < (_f(a) + b) * (_f(a) + c), -value).otherwise(value)


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series) -> pd.Series:
    """P(chi-squared with one degree of freedom > x)."""
    return x.map(lambda v: None if v is None or v != v else math.erfc(math.sqrt(max(v, 0.0) / 2)))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of k successes in n."""
    k, n = _f(k), F.when(n > 0, _f(n))
    p, q = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / q, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / q
    return mid - half, mid + half


def entropy(probabilities: Column) -> Column:
    """Bits of an array of probabilities; parts that are not positive are skipped."""
    return F.aggregate(F.filter(probabilities, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log2(p))


def link_band(score: Column) -> Column:
    return F.when(score >= 0.3, "LIKELY").when(score >= 0.15, "POSSIBLE").otherwise("UNLIKELY")

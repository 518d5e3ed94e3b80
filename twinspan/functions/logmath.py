"""Log-space arithmetic: Column builders over arrays of natural-log values, and numpy twins for grouped code."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lambdas import let

LN10 = math.log(10.0)
MAX_PHRED = 10_000.0


# ------------------------------------------------------------------ Columns
def logsumexp(values: Column) -> Column:
    """Of an array, shifted by its maximum; null for an empty one."""
    of = lambda v: let(F.array_max(v), lambda top: top + F.ln(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top))))
    return let(values, of)


def log_normalize(values: Column) -> Column:
    return let(values, lambda v: let(logsumexp(v), lambda total: F.transform(v, lambda x: x - total)))


def phred_of_best(values: Column, best: Column | int) -> Column:
    """-10 log10 of the probability of everything but entry `best` (0-based), at most MAX_PHRED."""
    b = F.lit(best) if isinstance(best, int) else best
    quality = lambda v, others: F.when(F.size(others) == 0, F.lit(MAX_PHRED)).otherwise(F.least(F.lit(MAX_PHRED), F.lit(-10 / LN10) * (logsumexp(others) - logsumexp(v))))
    return let(values, lambda v: let(F.filter(v, lambda x, i: i != b), lambda others: quality(v, others)))


def extended_phred(values: Column, best: Column | int, remaining: Column) -> Column:
    """The same where the values, which sum up to 1, are what is left besides an event of probability exp(remaining)."""
    b = F.lit(best) if isinstance(best, int) else best

    def quality(v: Column, others: Column) -> Column:
        rest = F.when(F.size(others) == 0, F.lit(0.0)).otherwise(F.exp(logsumexp(others) - logsumexp(v)))
        return F.least(F.lit(MAX_PHRED), F.lit(-10 / LN10) * F.ln((1 - F.exp(remaining)) * rest + F.exp(remaining)))

    return let(values, lambda v: let(F.filter(v, lambda x, i: i != b), lambda others: quality(v, others)))


def log1m_sum(values: Column) -> Column:
    """ln(1 - sum(exp(values))), -infinity where nothing is left."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x))
    return F.when(total >= 1, F.lit(float("-inf"))).otherwise(F.log1p(-total))


def tricube(distance: Column) -> Column:
    x = F.least(F.abs(distance), F.lit(1.0))
    return F.pow(1 - F.pow(x, F.lit(3.0)), F.lit(3.0))


def log_factorial(n: Column) -> Column:
    """Of a whole number up to 20."""
    return F.ln(F.factorial(n.cast("int")))


def multinomial_coefficient(counts: Column) -> Column:
    """ln of the multinomial coefficient of an array of counts whose sum is at most 20."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return log_factorial(total) - F.aggregate(counts, F.lit(0.0), lambda a, x: a + log_factorial(x))


def round_significant(x: Column, digits: int = 3) -> Column:
    scale = F.pow(F.lit(10.0), F.greatest(F.lit(0), digits - 1 - F.floor(F.log10(F.abs(x)))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.floor(x * scale + 0.5) / scale)


# ------------------------------------------------------------------ numpy
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def lgamma(x: np.ndarray) -> np.ndarray:
    return np.asarray(_lgamma(np.asarray(x, float)), float)


def np_logsumexp(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        out = np.log(np.sum(np.exp(x - top), axis=axis, keepdims=True)) + top
    return out.squeeze(axis) if axis is not None else out.item()


def nb_logpmf(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Negative binomial with real n and success probability p; its mean is n (1 - p) / p."""
    return lgamma(k + n) - lgamma(n) - lgamma(k + 1.0) + n * np.log(p) + k * np.log1p(-p)


def binomial_log_tail(k: int, n: int, p: float) -> float:
    """ln P(X <= k)."""
    i = np.arange(0, k + 1)
    return float(np_logsumexp(lgamma(np.full(k + 1, n + 1.0)) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * math.log(p) + (n - i) * math.log1p(-p)))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p-value of [[a, b], [c, d]]: tables at most as likely as the given one."""
    rows, column, total = a + b, a + c, a + b + c + d
    if total == 0:
        return 1.0
    x = np.arange(max(0, rows + column - total), min(rows, column) + 1)
    fixed = math.lgamma(rows + 1) + math.lgamma(total - rows + 1) + math.lgamma(column + 1) + math.lgamma(total - column + 1) - math.lgamma(total + 1)
    logs = fixed - lgamma(x + 1.0) - lgamma(rows - x + 1.0) - lgamma(column - x + 1.0) - lgamma(total - rows - column + x + 1.0)
    return float(min(1.0, np.exp(logs[logs <= logs[x == a][0] + 1e-7]).sum()))


@lru_cache(maxsize=None)
def genotypes(n_alleles: int, ploidy: int) -> tuple[tuple[int, ...], ...]:
    """All count vectors of n_alleles that sum up to ploidy, from (ploidy, 0, ...) on in descending order."""
    if n_alleles == 1:
        return ((ploidy,),)
    return tuple((k, *rest) for k in range(ploidy, -1, -1) for rest in genotypes(n_alleles - 1, ploidy - k))


def golden_section(f, low: float, high: float, steps: int = 40) -> float:
    """Minimizer of a unimodal function on an interval."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(steps):
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = f(b)
    return (low + high) / 2

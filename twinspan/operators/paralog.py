"""Paralog-specific copy number: f-values of variants that tell copies apart, by expectation-maximization, and what
follows from them. numpy code over one (locus, region group), called in grouped maps."""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.logmath import np_logsumexp

RELIABLE, SEMI_RELIABLE = 0.95, 0.80
LN_PRIOR = -1.5 * math.log(10)


@lru_cache(maxsize=None)
def copy_tuples(total: int, copies: int) -> tuple[tuple[int, ...], ...]:
    """All splits of a total copy number over the copies."""
    if copies == 1:
        return ((total,),)
    return tuple((k, *rest) for k in range(total, -1, -1) for rest in copy_tuples(total - k, copies - 1))


def split_priors(tuples: tuple[tuple[int, ...], ...], reference: int = 2) -> np.ndarray:
    """ln priors: the L1 distance from the reference split, 1.5 decades each; normalized."""
    p = np.array([LN_PRIOR * sum(abs(k - reference) for k in t) for t in tuples])
    return p - np_logsumexp(p)


def split_table(spark, totals: range, copies: int, reference: int = 2) -> DataFrame:
    """(total, cns, prior) of every split of the totals: some hundred rows to join with."""
    rows = [(t, list(x), float(p)) for t in totals for x, p in zip(copy_tuples(t, copies), split_priors(copy_tuples(t, copies), reference))]
    return spark.createDataFrame(rows, "total int, cns array<int>, prior double")


def allele_distribution(cns: tuple[int, ...], f: np.ndarray) -> np.ndarray:
    """P(number of reference-1 alleles) given copies' numbers: copy 1 carries its allele with probability f1, any
    other copy carries it with 1 - f; the convolution of their binomials."""
    out = np.ones(1)
    for i, k in enumerate(cns):
        q = f[i] if i == 0 else 1 - f[i]
        one = np.array([math.comb(k, j) * q**j * (1 - q) ** (k - j) for j in range(k + 1)])
        out = np.convolve(out, one)
    return out


def allele_distribution_slopes(cns: tuple[int, ...], f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """allele_distribution() and how it changes with each f-value, (copies, total + 1): a binomial of k changes with its q as
    k times the difference of two of k - 1."""
    ones, slopes = [], []
    for i, k in enumerate(cns):
        q = f[i] if i == 0 else 1 - f[i]
        pmf = lambda n: np.array([math.comb(n, j) * q**j * (1 - q) ** (n - j) for j in range(n + 1)])  # noqa: B023, E731
        ones.append(pmf(k))
        less = pmf(k - 1) if k else np.zeros(0)
        slopes.append((1 if i == 0 else -1) * k * (np.append(0.0, less) - np.append(less, 0.0)) if k else np.zeros(1))
    out = []
    for i in range(len(cns) + 1):
        total = np.ones(1)
        for j in range(len(cns)):
            total = np.convolve(total, slopes[j] if i == j else ones[j])
        out.append(total)
    return out[-1], np.array(out[:-1])


def with_allele_distribution(df: DataFrame, cns: str, f: str, out: str) -> DataFrame:
    """Adds allele_distribution() of each row's copy numbers (array of ints) and f-values (array of doubles)."""

    @F.pandas_udf("array<double>")
    def mixed(k: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([allele_distribution(tuple(int(i) for i in a), np.asarray(b, float)) for a, b in zip(k, values)])

    return df.withColumn(out, mixed(cns, f))


def observation_logs(n1: np.ndarray, n2: np.ndarray, total: int, error: float = 0.01) -> np.ndarray:
    """ln P(counts | k of `total` alleles are of copy 1), (observations, total + 1); the coefficient is left out."""
    share = np.clip(np.arange(total + 1) / max(total, 1), error, 1 - error)
    return n1[:, None] * np.log(share) + n2[:, None] * np.log(1 - share)


def psv_support(n1: np.ndarray, n2: np.ndarray, tuples: tuple[tuple[int, ...], ...], f: np.ndarray) -> np.ndarray:
    """ln P(counts of each sample | split) of one variant: (samples, splits)."""
    total = sum(tuples[0])
    logs = observation_logs(n1, n2, total)
    with np.errstate(divide="ignore"):
        mix = np.log(np.array([allele_distribution(t, f) for t in tuples]))  # -inf: no floor stands up to deep counts
    return np_logsumexp(logs[:, None, :] + mix[None, :, :], axis=2)


def with_psv_support(df: DataFrame, n1: str, n2: str, f: str, total: int, out: str = "support") -> DataFrame:
    """Adds psv_support() of each row's counts and f-values: ln P(counts | split) for every split of `total` in copy_tuples order."""

    @F.pandas_udf("array<double>")
    def logs(a: pd.Series, b: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([psv_support(np.array([x], float), np.array([y], float), copy_tuples(total, len(v)), np.asarray(v, float))[0] for x, y, v in zip(a, b, values)])

    return df.withColumn(out, logs(n1, n2, f))


def information(n1: np.ndarray, n2: np.ndarray) -> float:
    """Mean share of the other copies' allele where there are reads, times four (1 for even counts)."""
    depth = n1 + n2
    some = depth > 0
    if not some.any():
        return 0.0
    share = n2[some] / depth[some]
    return float(min(1.0, 4 * np.mean(share * (1 - share))))


LOW_F, HIGH_F = 0.03, 0.999
STARTS = (0.05, 0.35, 0.65, 0.95)


class Mixture:
    """A variant's counts under the splits of its samples, as a function of its f-values: the expected ln likelihood over the samples'
    posteriors, and a Beta(5, 1) prior on the largest f-value."""

    def __init__(self, counts: np.ndarray, groups: dict, tuples: dict, posterior: dict):
        self.parts = []
        for t, own in groups.items():
            logs = observation_logs(counts[own, 0], counts[own, 1], int(t))
            top = logs.max(axis=1, keepdims=True)
            self.parts.append((np.exp(logs - top), float((posterior[t] * top).sum()), posterior[t], tuples[t]))

    def __call__(self, f: np.ndarray) -> tuple[float, np.ndarray]:
        """The value and its gradient."""
        best = int(f.argmax())
        value, slope = math.log(5) + 4 * math.log(max(f[best], 1e-12)), np.zeros(len(f))
        slope[best] = 4 / max(f[best], 1e-12)
        for seen, base, weight, splits in self.parts:
            each = [allele_distribution_slopes(x, f) for x in splits]
            p = np.maximum(seen @ np.array([m for m, _ in each]).T, 1e-300)  # samples, splits
            value += base + float((weight * np.log(p)).sum())
            share = weight / p
            for c in range(len(f)):
                slope[c] += float((share * (seen @ np.array([d[c] for _, d in each]).T)).sum())
        return value, slope


def climb(target, start: np.ndarray, low: float = LOW_F, high: float = HIGH_F, steps: int = 60, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """The top of target (value, gradient) near start, within a box, by a quasi-Newton method: the inverse Hessian is built up
    from gradients, steps are cut off at the box, and coordinates that push against their bound are held there."""
    x = np.clip(np.asarray(start, float), low, high)
    value, slope = target(x)
    inverse = np.eye(len(x)) * 1e-3
    for _ in range(steps):
        free = ~(((x <= low) & (slope < 0)) | ((x >= high) & (slope > 0)))
        if not free.any() or np.abs(slope[free]).max() < tolerance * max(1.0, abs(value)):
            break
        way = np.where(free, inverse @ np.where(free, slope, 0), 0)
        if way @ slope <= 0:
            inverse, way = np.eye(len(x)) * 1e-3, np.where(free, slope, 0) * 1e-3
        size = min(1.0, 0.5 / max(np.abs(way).max(), 1e-300))
        while size > 1e-12:
            new = np.clip(x + size * way, low, high)
            then, slope_then = target(new)
            if then >= value + 1e-4 * float(slope @ (new - x)):
                break
            size /= 2
        else:
            break
        if np.abs(new - x).max() < 1e-9:
            break
        s, y = new - x, slope - slope_then  # of the function turned over, which is convex near a top
        if s @ y > 1e-12:
            rho, left = 1 / (s @ y), np.eye(len(x))
            left = left - rho * np.outer(s, y)
            inverse = left @ inverse @ left.T + rho * np.outer(s, s)
        else:
            inverse = inverse * 4  # straight or hollow here: longer steps
        x, value, slope = new, then, slope_then
    return x, value


def best_f_values(target: Mixture, start: np.ndarray) -> tuple[np.ndarray, float]:
    """From the last values and from the best of a coarse grid, as there may be several tops."""
    if len(start) <= 3:
        grid = [np.array(x) for x in product(STARTS, repeat=len(start))]
    else:
        grid = [np.full(len(start), x) for x in STARTS]
    coarse = max(grid, key=lambda x: target(x)[0])
    return max((climb(target, x) for x in (start, coarse)), key=lambda r: r[1])


def masked_correlation(share: np.ndarray, least: int = 5) -> np.ndarray:
    """Pearson correlation of each two rows over the columns that both have; nan where these are fewer than `least`, or one row
    is constant there."""
    here = ~np.isnan(share)
    x, h = np.where(here, share, 0.0), here.astype(float)
    n = h @ h.T
    with np.errstate(invalid="ignore", divide="ignore"):
        own, other = x @ h.T, h @ x.T  # sums of a row where the other one is there, and the other way round
        across = x @ x.T - own * other / n
        spread = (x * x) @ h.T - own * own / n
        r = across / np.sqrt(np.maximum(spread, 0) * np.maximum(spread.T, 0))
    r[(n < least) | ~np.isfinite(r)] = np.nan
    np.fill_diagonal(r, 1.0)
    return np.clip(r, -1, 1)


def row_distances(cor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Euclidean distances of the rows of a correlation matrix over the entries that both have, by their number; and the rows to
    use: of two without any in common the one with fewer is left out."""
    here = ~np.isnan(cor)
    n = len(cor)
    out, use = np.full((n, n), np.nan), np.ones(n, bool)
    np.fill_diagonal(out, 0.0)
    for i in range(n):
        for j in range(i + 1, n) if use[i] else ():
            both = here[i] & here[j]
            if not use[j]:
                continue
            if both.any():
                out[i, j] = out[j, i] = math.sqrt(((cor[i, both] - cor[j, both]) ** 2).sum()) / both.sum()
            elif here[i].sum() > here[j].sum():
                use[j] = False
            else:
                use[i] = False
                break
    return out, use


LEAST_CLUSTER = 5


def variant_clusters(counts: np.ndarray) -> list[np.ndarray]:
    """Masks of the variants that go together over the samples, two groups at most; those of fewer than LEAST_CLUSTER are left
    out, and all where there are too few variants to tell. A sample without reads of a variant counts for nothing there."""
    depth = counts.sum(axis=2)
    share = np.where(depth > 0, counts[:, :, 0] / np.maximum(depth, 1), np.nan)
    distance, use = row_distances(masked_correlation(share))
    at = np.flatnonzero(use)
    if len(at) < 2 * LEAST_CLUSTER:
        return []
    labels = cluster_two(distance[np.ix_(at, at)])
    return [np.isin(np.arange(len(counts)), at[labels == k]) for k in (0, 1) if LEAST_CLUSTER <= (labels == k).sum() < len(counts)]


def fit_f_values(counts: np.ndarray, totals: np.ndarray, iterations: int = 100, tolerance: float = 0.01, copies: int = 2) -> dict:
    """Fits that start from all variants and from either cluster of variants that go together; the one under which
    all variants' counts are likeliest is taken. A noisy variant can hold a fit from all of them back."""
    starts = [np.ones(len(counts), bool), *variant_clusters(counts)]
    return max((_fit(counts, totals, iterations, tolerance, copies, use) for use in starts), key=lambda m: m["explained"])


def _fit(counts: np.ndarray, totals: np.ndarray, iterations: int, tolerance: float, copies: int, use: np.ndarray) -> dict:
    """counts: (variants, samples, 2); totals: copy number of each sample. E-step: posteriors of the splits of each
    sample by the variants in use, weighted with their information and f-values; M-step: all f-values of a variant at once
    (best_f_values). Semi-reliable variants are in use from then on, if there are any. Ends when the likelihood changes by less than
    tolerance."""
    variants = len(counts)
    f = np.full((variants, copies), 0.98)
    tuples = {t: copy_tuples(int(t), copies) for t in np.unique(totals)}
    priors = {t: split_priors(x) for t, x in tuples.items()}
    groups = {t: np.flatnonzero(totals == t) for t in tuples}
    weights = np.array([information(counts[v, :, 0], counts[v, :, 1]) for v in range(variants)])
    history: list[float] = []
    values = np.zeros(variants)
    for _ in range(iterations):
        total, posterior = 0.0, {}
        for t, own in groups.items():
            logs = np.tile(priors[t], (len(own), 1))
            for v in np.flatnonzero(use):
                logs = logs + weights[v] * f[v].min() * psv_support(counts[v, own, 0], counts[v, own, 1], tuples[t], f[v])
            norm = np_logsumexp(logs, axis=1)
            total += float(norm.sum())
            posterior[t] = np.exp(logs - norm[:, None])
        history.append(total)
        for v in range(variants):
            f[v], values[v] = best_f_values(Mixture(counts[v], groups, tuples, posterior), f[v])
        good = (f >= SEMI_RELIABLE).all(axis=1)
        use = good if good.any() else use
        if len(history) > 1 and abs(history[-1] - history[-2]) < tolerance:
            break
    explained = float(values.sum()) + sum(float((posterior[t] * priors[t]).sum()) for t in groups)
    return {"f": f, "history": history, "explained": explained, "weights": weights, "reliable": (f >= RELIABLE).all(axis=1), "semi": (f >= SEMI_RELIABLE).all(axis=1)}


def estimate(counts: np.ndarray, totals: np.ndarray, f: np.ndarray, use: np.ndarray, weights: np.ndarray) -> pd.DataFrame:
    """Best split of each sample by the variants in use, and each copy's number with its Phred quality."""
    rows = []
    for s, t in enumerate(totals):
        tuples = copy_tuples(int(t), f.shape[1])
        logs = split_priors(tuples)
        for v in np.flatnonzero(use):
            logs = logs + weights[v] * psv_support(counts[v, s : s + 1, 0], counts[v, s : s + 1, 1], tuples, f[v])[0]
        logs = logs - np_logsumexp(logs)
        best = tuples[int(logs.argmax())]
        quals = []
        for c, k in enumerate(best):
            other = [i for i, x in enumerate(tuples) if x[c] != k]
            quals.append(min(-10 / math.log(10) * float(np_logsumexp(logs[other])) if other else 1000.0, 1000.0))
        rows.append((s, ",".join(map(str, best)), ",".join(f"{q:.0f}" for q in quals), float(min(quals))))
    return pd.DataFrame(rows, columns=["sample", "pscn", "pscn_qual", "least_qual"])


def paralog_copy_numbers(allele_counts: DataFrame, by: tuple[str, ...] = ("locus",)) -> DataFrame:
    """allele_counts: keys, psv_ix, sample_id, n1, n2, agcn. Per sample: pscn, pscn_qual, n_reliable and a filter."""
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in allele_counts.schema if f.name in by)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        grid = {c: rows.pivot_table(index="psv_ix", columns="sample_id", values=c, aggfunc="sum").sort_index().fillna(0) for c in ("n1", "n2")}
        totals = rows.groupby("sample_id")["agcn"].max().reindex(grid["n1"].columns).to_numpy(int)
        counts = np.stack([grid["n1"].to_numpy(float), grid["n2"].to_numpy(float)], axis=2)
        m = fit_f_values(counts, totals)
        use = m["reliable"] if m["reliable"].any() else m["semi"]
        out = estimate(counts, totals, m["f"], use, m["weights"])
        n = int(use.sum())
        out["sample_id"] = grid["n1"].columns.to_numpy()[out["sample"]]
        out["n_reliable"] = n
        out["filter"] = "NoReliable" if n == 0 else "FewReliable" if n < 3 else "PASS"
        for k in by:
            out[k] = rows[k].iloc[0]
        return out[[*by, "sample_id", "pscn", "pscn_qual", "n_reliable", "filter"]]

    return allele_counts.groupBy(*by).applyInPandas(run, f"{keys}, sample_id bigint, pscn string, pscn_qual string, n_reliable bigint, filter string")


def f_values(allele_counts: DataFrame, by: tuple[str, ...] = ("locus",)) -> DataFrame:
    """f-values of each variant, its information and whether it is reliable."""
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in allele_counts.schema if f.name in by)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        grid = {c: rows.pivot_table(index="psv_ix", columns="sample_id", values=c, aggfunc="sum").sort_index().fillna(0) for c in ("n1", "n2")}
        totals = rows.groupby("sample_id")["agcn"].max().reindex(grid["n1"].columns).to_numpy(int)
        m = fit_f_values(np.stack([grid["n1"].to_numpy(float), grid["n2"].to_numpy(float)], axis=2), totals)
        out = pd.DataFrame({"psv_ix": grid["n1"].index.to_numpy(), "f1": m["f"][:, 0], "f2": m["f"][:, 1], "info": m["weights"], "reliable": m["reliable"]})
        for k in by:
            out[k] = rows[k].iloc[0]
        return out[[*by, "psv_ix", "f1", "f2", "info", "reliable"]]

    return allele_counts.groupBy(*by).applyInPandas(run, f"{keys}, psv_ix bigint, f1 double, f2 double, info double, reliable boolean")


def cluster_two(distance: np.ndarray) -> np.ndarray:
    """Complete linkage down to two clusters; labels 0 and 1."""
    d = np.array(distance, float)
    np.fill_diagonal(d, np.inf)
    labels = np.arange(len(d))
    for _ in range(len(d) - 2):
        i, j = np.unravel_index(d.argmin(), d.shape)
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        labels[labels == j] = i
    return (labels != labels.min()).astype(int) if len(d) else labels


def gene_conversions(logs: np.ndarray, main: int, stay: float = 0.99, least: int = 2) -> list[tuple[int, int, int]]:
    """logs: ln P(variant | split) in order, (variants, splits). Runs (first, last + 1, split) of at least `least`
    variants that a split other than the main one explains, on the best path of a star-shaped chain."""
    n = logs.shape[1]
    if n < 2 or not len(logs):
        return []
    a = np.full((n, n), -np.inf)
    a[np.diag_indices(n)] = math.log(stay)
    a[main, :] = math.log((1 - stay) / (n - 1))
    a[:, main] = math.log(1 - stay)
    a[main, main] = math.log(stay)
    start = np.full(n, math.log(0.5 / (n - 1)))
    start[main] = math.log(0.5)
    score, back = start + logs[0], np.zeros(logs.shape, int)
    for i in range(1, len(logs)):
        ways = score[:, None] + a
        back[i] = ways.argmax(axis=0)
        score = ways[back[i], np.arange(n)] + logs[i]
    path = [int(score.argmax())]
    for i in range(len(logs) - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    path.reverse()
    cuts = [0, *(i for i in range(1, len(path)) if path[i] != path[i - 1]), len(path)]
    return [(s, e, path[s]) for s, e in zip(cuts, cuts[1:]) if path[s] != main and e - s >= least]

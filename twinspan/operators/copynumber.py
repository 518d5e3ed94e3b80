"""Aggregate copy number: a banded hidden Markov model over windows, in grouped numpy code.

One group is a (locus, region group): its samples share transitions and window multipliers, so they are fitted
together. A locus has some hundred windows, and its samples are the study's; both are bounded by the input's
design, and grouped maps over loci are what spreads the work.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.logmath import golden_section, nb_logpmf, np_logsumexp
from .grouped import Spaced

TINY = 0.01  # copies that an absent region seems to have


@dataclass(frozen=True)
class HmmConfig:
    max_cn: int = 8
    transition: float = 1e-5
    jump: int = 6
    iterations: int = 50
    tolerance: float = 0.1
    multiplier_low: float = 0.4
    multiplier_high: float = 2.1
    least_samples: int = 50
    best_states: int = 2
    jump_reach: int = 10  # windows around a peak of jumps that are taken for one breakpoint


def transitions(n: int, up: np.ndarray, down: np.ndarray, jump: int) -> np.ndarray:
    """ln of (positions, n, n): one step has the given probability, each further one costs as much again, and
    jumps longer than `jump` are impossible."""
    steps = np.arange(n)[None, :] - np.arange(n)[:, None]
    out = np.zeros((len(up), n, n))
    for t, (u, d) in enumerate(zip(up, down)):
        p = np.where(steps > 0, u ** np.maximum(steps, 1), np.where(steps < 0, d ** np.maximum(-steps, 1), 0.0))
        p[np.abs(steps) > jump] = 0
        np.fill_diagonal(p, 0)
        np.fill_diagonal(p, np.maximum(1 - p.sum(axis=1), 1e-12))
        out[t] = np.log(np.maximum(p, 1e-300))
    return out


def emissions(depth: np.ndarray, nb_n: np.ndarray, nb_p: np.ndarray, multiplier: np.ndarray, n_states: int, weight: np.ndarray | None = None) -> np.ndarray:
    """ln P(depth | copies), normalized over states: (samples, windows, states). n grows with the copies and the
    window's multiplier; weight (0 to 1) flattens windows that are trusted less."""
    cn = np.arange(n_states, dtype=float)
    cn[0] = TINY
    n = nb_n[:, :, None] * cn[None, None, :] * multiplier[None, :, None]
    e = nb_logpmf(np.broadcast_to(depth[:, :, None].astype(float), n.shape), n, np.broadcast_to(nb_p[:, :, None], n.shape))
    if weight is not None:
        e = e * weight[None, :, None]
    return e - np_logsumexp(e, axis=2)[:, :, None]


def passes(e: np.ndarray, a: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One sample: ln of what leads to each state of each window (its emission included), of what follows, and of all."""
    t, n = e.shape
    alpha, beta = np.empty((t, n)), np.zeros((t, n))
    alpha[0] = start + e[0]
    for i in range(1, t):
        alpha[i] = e[i] + np_logsumexp(alpha[i - 1][:, None] + a[i - 1], axis=0)
    for i in range(t - 2, -1, -1):
        beta[i] = np_logsumexp(a[i] + (e[i + 1] + beta[i + 1])[None, :], axis=1)
    return alpha, beta, np_logsumexp(alpha[-1])


def forward_backward(e: np.ndarray, a: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One sample: ln posteriors (windows, states), expected ln transition mass (windows - 1, states, states), and
    the ln likelihood."""
    alpha, beta, total = passes(e, a, start)
    xi = alpha[:-1, :, None] + a + (e[1:] + beta[1:])[:, None, :] - total
    return alpha + beta - total, xi, total


def segment_posteriors(e: np.ndarray, a: np.ndarray, start: np.ndarray, segments: list[tuple[int, int, int]], reach: int = 2) -> list[list[tuple[int, float]]]:
    """For each (first window, window behind, state): ln P that the chain stays in a state all through the segment, for the
    states up to `reach` beside its own, normalized over these, the own one first. What leads to the segment and what follows is summed up
    over all paths."""
    alpha, beta, _ = passes(e, a, start)
    n = e.shape[1]
    k = np.arange(n)
    stays = np.vstack([np.zeros(n), np.cumsum(a[:, k, k] + e[1:], axis=0)])  # from window 0 on
    out = []
    for i, j, own in segments:
        states = [own, *(c for c in range(max(0, own - reach), min(n, own + reach + 1)) if c != own)]
        logs = alpha[i, states] + stays[j - 1, states] - stays[i, states] + beta[j - 1, states]
        out.append(list(zip(states, (logs - np_logsumexp(logs)).tolist())))
    return out


def viterbi(e: np.ndarray, a: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best path; of equal ways the lowest previous state."""
    t, n = e.shape
    score, back = start + e[0], np.zeros((t, n), int)
    for i in range(1, t):
        ways = score[:, None] + a[i - 1]
        back[i] = ways.argmax(axis=0)
        score = ways[back[i], np.arange(n)] + e[i]
    path = np.empty(t, int)
    path[-1] = score.argmax()
    for i in range(t - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def path_log_likelihood(e: np.ndarray, a: np.ndarray, start: np.ndarray, path: np.ndarray) -> float:
    i = np.arange(len(path))
    return float(start[path[0]] + e[i, path].sum() + a[i[:-1], path[:-1], path[1:]].sum())


def run_length_text(path: np.ndarray) -> str:
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1, [len(path)]))
    return ";".join(f"{path[s]}x{e - s}" for s, e in zip(cuts, cuts[1:]))


def peaks_of(values: np.ndarray, least: float, distance: int) -> list[int]:
    """Local maxima of at least this height (of a plateau its middle), the higher first, none closer than distance to one before."""
    rise = np.diff(np.concatenate(([-np.inf], values)))
    starts = np.flatnonzero(rise != 0)
    ends = np.append(starts[1:], len(values))
    level = values[starts]
    high = np.concatenate(([-np.inf], level[:-1])) < level
    high &= np.append(level[1:], -np.inf) < level
    places = ((starts + ends - 1) // 2)[high & (level >= least)]
    near = Spaced(distance)
    return sorted(int(i) for i in sorted(places, key=lambda i: (-values[i], i)) if near.take(int(i)))


def gathered_jumps(mass: np.ndarray, least: float, distance: int = 10) -> np.ndarray:
    """The expected jumps by position, with those around each peak moved to it: from the last peak's reach, or `distance` before,
    to the middle to the next peak, or `distance` behind. Samples that change at one breakpoint then share its transition
    however blurred their depths are. The sum stays."""
    out, before = mass.copy(), 0
    peaks = peaks_of(mass, least, distance)
    for k, at in enumerate(peaks):
        low, high = max(before, at - distance), min(len(mass), at + distance)
        if k + 1 < len(peaks):
            high = min(high, (at + peaks[k + 1]) // 2)
        high = max(high, at + 1)
        out[low:high] = 0
        out[at] = mass[low:high].sum()
        before = high
    return out


def fit_group(depth: np.ndarray, nb_n: np.ndarray, nb_p: np.ndarray, config: HmmConfig, reference_cn: int = 4) -> dict:
    """Baum-Welch over all samples of a group: transition rates by window, start probabilities and multipliers.

    nb_n, nb_p are of one copy. With too few samples there is a single pass under the defaults."""
    samples, windows = depth.shape
    n = config.max_cn + 1
    up = np.full(max(windows - 1, 0), config.transition)
    down = up.copy()
    start = np.log(np.full(n, 1e-3))
    start[min(reference_cn, n - 1)] = 0
    start -= np_logsumexp(start)
    multiplier, last, history = np.ones(windows), -np.inf, []
    train = samples >= config.least_samples
    for _ in range(config.iterations if train else 1):
        a = transitions(n, up, down, config.jump)
        e = emissions(depth, nb_n, nb_p, multiplier, n)
        results = [forward_backward(e[s], a, start) for s in range(samples)]
        gamma = np.exp(np.array([r[0] for r in results]))
        total = float(sum(r[2] for r in results))
        history.append(total)
        if not train or abs(total - last) < config.tolerance:
            break
        last = total
        xi = np.exp(np.array([r[1] for r in results])).sum(axis=0)
        mass = xi.sum(axis=(1, 2))
        rates = ((xi * part).sum(axis=(1, 2)) / np.maximum(mass, 1e-9) for part in (np.triu(np.ones((n, n)), 1), np.tril(np.ones((n, n)), -1)))
        up, down = (np.clip(gathered_jumps(r, config.transition, config.jump_reach), config.transition, 0.1) for r in rates)
        start = np.log((gamma[:, 0].sum(axis=0) + 1e-3) / (samples + n * 1e-3))
        cn = np.maximum(np.arange(n), TINY)
        expected = (gamma * cn).sum(axis=2)
        for w in range(windows):
            shape = lambda m, w=w: -float(nb_logpmf(depth[:, w].astype(float), nb_n[:, w] * np.maximum(expected[:, w], TINY) * m, nb_p[:, w]).sum())
            multiplier[w] = golden_section(shape, config.multiplier_low, config.multiplier_high, 25)
    a = transitions(n, up, down, config.jump)
    e = emissions(depth, nb_n, nb_p, multiplier, n)
    return {"gamma": gamma, "paths": np.array([viterbi(e[s], a, start) for s in range(samples)]), "multiplier": multiplier, "up": up, "down": down, "history": history, "e": e, "a": a, "start": start}


def fitted(rows: pd.DataFrame, config: HmmConfig, reference_cn: int) -> tuple[pd.DataFrame, dict]:
    """The grid of depths (samples, windows) of a group's rows, and its fit."""
    grid = {c: rows.pivot_table(index="sample_id", columns="window_ix", values=c, aggfunc="mean").sort_index() for c in ("depth", "nb_n", "nb_p")}
    depth = grid["depth"].fillna(0)
    nb_n, nb_p = (grid[c].fillna(rows[c].mean()).to_numpy() for c in ("nb_n", "nb_p"))
    return depth, fit_group(depth.to_numpy().round(), nb_n, nb_p, config, reference_cn)


def segment_copy_numbers(depths: DataFrame, config: HmmConfig = HmmConfig(), by: tuple[str, ...] = ("locus",), reference_cn: int = 4, reach: int = 2) -> DataFrame:
    """Runs of one copy number on each sample's best path, which also end where windows change their const region. depths as in
    copy_number_profiles(), with region_ix, ws and we of the windows. Per run: segment, region_ix, s, e, cn, cn_qual (Phred of all
    other probable numbers) and probable (cn, ln_p), the run's own first."""
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in depths.schema if f.name in by)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        depth, m = fitted(rows, config, reference_cn)
        place = rows.groupby("window_ix")[["region_ix", "ws", "we"]].min().reindex(depth.columns)
        out = []
        for k, sample in enumerate(depth.index):
            path, region = m["paths"][k], place["region_ix"].to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(path) != 0) | (np.diff(region) != 0)) + 1).tolist(), len(path)]
            runs = [(i, j, int(path[i])) for i, j in zip(cuts, cuts[1:])]
            for n, ((i, j, state), probable) in enumerate(zip(runs, segment_posteriors(m["e"][k], m["a"], m["start"], runs, reach))):
                others = [p for _, p in probable[1:]]
                qual = min(1000.0, -10 / np.log(10) * float(np_logsumexp(np.array(others)))) if others else 1000.0
                out.append((*(rows[c].iloc[0] for c in by), sample, n, region[i], place["ws"].iloc[i], place["we"].iloc[j - 1], state, max(qual, 0.0), [{"cn": c, "ln_p": p} for c, p in probable]))
        return pd.DataFrame(out, columns=[*by, "sample_id", "segment", "region_ix", "s", "e", "cn", "cn_qual", "probable"])

    return depths.groupBy(*by).applyInPandas(fit, f"{keys}, sample_id bigint, segment bigint, region_ix bigint, s bigint, e bigint, cn bigint, cn_qual double, probable array<struct<cn:bigint,ln_p:double>>")


def copy_number_profiles(depths: DataFrame, config: HmmConfig = HmmConfig(), by: tuple[str, ...] = ("locus",), reference_cn: int = 4) -> DataFrame:
    """depths: the keys, sample_id, window_ix, depth, nb_n, nb_p (of one copy). Returns per sample and window:
    cn (Viterbi), cn_qual (Phred of the posterior of that state), second_cn, multiplier, path (run lengths).

    Windows or samples that a group lacks count as depth 0 of its mean background."""
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in depths.schema if f.name in by)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        depth, m = fitted(rows, config, reference_cn)
        s, w = m["paths"].shape
        posterior = np.take_along_axis(m["gamma"], m["paths"][:, :, None], 2)[:, :, 0]
        others = m["gamma"].copy()
        np.put_along_axis(others, m["paths"][:, :, None], -1, 2)
        out = pd.DataFrame({
            "sample_id": np.repeat(depth.index.to_numpy(), w), "window_ix": np.tile(depth.columns.to_numpy(), s), "cn": m["paths"].ravel().astype("int64"),
            "cn_qual": np.minimum(-10 * np.log10(np.maximum(1 - posterior, 1e-30)), 1000).ravel(), "second_cn": others.argmax(axis=2).ravel().astype("int64"),
            "multiplier": np.tile(m["multiplier"], s), "path": np.repeat([run_length_text(p) for p in m["paths"]], w),
        })
        for k in by:
            out[k] = rows[k].iloc[0]
        return out[[*by, "sample_id", "window_ix", "cn", "cn_qual", "second_cn", "multiplier", "path"]]

    return depths.groupBy(*by).applyInPandas(fit, f"{keys}, sample_id bigint, window_ix bigint, cn bigint, cn_qual double, second_cn bigint, multiplier double, path string")


def path_weights(profiles: DataFrame, by: tuple[str, ...] = ("locus",), least: float = 0.001) -> DataFrame:
    """Samples of one path, and their share of the group; rare paths left out."""
    paths = profiles.groupBy(*by, "sample_id").agg(F.first("path").alias("path")).groupBy(*by, "path").agg(F.count(F.lit(1)).alias("n"))
    totals = paths.groupBy(*by).agg(F.sum("n").alias("_t"))
    return paths.join(totals, list(by)).withColumn("weight", F.col("n") / F.col("_t")).filter(F.col("weight") >= least).drop("_t")


def smooth_short_runs(values: list[bool], least: int) -> list[bool]:
    """Flips the first run shorter than `least` until there is none, or one run is left. Runs behind which all is settled are kept
    on a list: a flipped one takes its neighbours in, and with one before it, which isn't short, neither is the whole."""
    cuts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
    runs = [[values[s], e - s] for s, e in zip(cuts, cuts[1:]) if s < e]
    done: list[list] = []
    k = 0
    while k < len(runs):
        value, n = runs[k]
        k += 1
        while n < least and not done and k < len(runs):
            value, n = runs[k][0], n + runs[k][1]
            k += 1
        if n < least and done:
            done[-1][1] += n
            if k < len(runs):
                done[-1][1] += runs[k][1]
                k += 1
        else:
            done.append([value, n])
    return [v for v, n in done for _ in range(n)]


def with_emissions(df: DataFrame, depth: str, nb_n: str, nb_p: str, n_states: int, out: str = "emissions") -> DataFrame:
    """Adds emissions() of each row's depth under its background: ln P(depth | copies) for 0 to n_states - 1 copies, normalized."""

    @F.pandas_udf("array<double>")
    def logs(d: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        e = emissions(d.to_numpy(float)[None, :], n.to_numpy(float)[None, :], p.to_numpy(float)[None, :], np.ones(len(d)), n_states)
        return pd.Series(list(e[0]))

    return df.withColumn(out, logs(depth, nb_n, nb_p))


def chain_scores(df: DataFrame, keys: list[str], order: str, emission: str, stay: float) -> DataFrame:
    """A chain of each key's rows in order, over the states of an array of ln emissions: even start, `stay` to remain and the rest
    even over the others. total: ln likelihood of all paths; best: that of the likeliest, as path_log_likelihood gives it; path:
    its runs of states."""
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        e = np.stack(rows[emission].to_numpy()).astype(float)
        n = e.shape[1]
        a = np.full((n, n), np.log((1 - stay) / max(n - 1, 1)))
        a[np.diag_indices(n)] = np.log(stay)
        a, start = np.broadcast_to(a, (len(e) - 1, n, n)), np.full(n, -np.log(n))
        path = viterbi(e, a, start)
        return pd.DataFrame([(*(rows[k].iloc[0] for k in keys), forward_backward(e, a, start)[2], path_log_likelihood(e, a, start, path), run_length_text(path))], columns=[*keys, "total", "best", "path"])

    return df.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "total double, best double, path string"]))

"""Read depth: window counts, GC strata, LOESS over GC bins, negative-binomial moments, sample filters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import primary_reads

LOW_MAPQ = 10


def window_counts(reads: DataFrame, width: int, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Per sample and window of one width: first and second reads, and the low-MAPQ, clipped and unpaired ones."""
    count = lambda c: F.count_if(c).alias
    return (
        primary_reads(reads).withColumn("window_ix", F.floor(F.col("pos") / width))
        .groupBy(*by, "window_ix")
        .agg(count(F.col("is_read2") == 0)("depth1"), count(F.col("is_read2") == 1)("depth2"), count(F.col("mapq") < LOW_MAPQ)("low_mapq"),
             count(F.col("clipped") == 1)("clipped"), count(F.col("unpaired") == 1)("unpaired"))
    )


def gc_stats(windows: DataFrame, value: str = "depth1", by: Sequence[str] = ("sample_id", "gc")) -> DataFrame:
    """Mean, population variance and interpolated quartiles by GC stratum."""
    q = F.percentile(value, F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0))))
    return windows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_windows"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"), q.alias("quartiles"))


def gc_range(windows: DataFrame, tail: int) -> DataFrame:
    """GC bins with more than `tail` windows on either side, themselves counted; the histogram has one row a bin."""
    bins = windows.groupBy("gc").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(F.lit(0)).orderBy("gc").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(F.lit(0)).orderBy("gc").rowsBetween(0, Window.unboundedFollowing)
    return bins.withColumn("below", F.sum("n").over(up)).withColumn("above", F.sum("n").over(down)).withColumn("usable", (F.col("below") >= tail) & (F.col("above") >= tail))


def nb_parameters(mean: Column, var: Column) -> tuple[Column, Column]:
    """n and p of a negative binomial by moments; the variance is at least the mean plus 0.01."""
    v = F.greatest(var, mean + 0.01)
    return mean * mean / (v - mean), mean / v


def normalized_cn(depth: Column, nb_n: Column, nb_p: Column) -> Column:
    return depth / (nb_n * (1 - nb_p) / nb_p)


def failed_windows(windows: DataFrame, passes: Column, most: float = 0.1) -> DataFrame:
    """Windows that fail in more than this share of their samples."""
    per = windows.groupBy("window_ix").agg(F.count(F.lit(1)).alias("n"), F.count_if(~passes).alias("failed"))
    return per.withColumn("drop", F.col("failed") > most * F.col("n"))


def variance_to_mean(stats: DataFrame, gc: int, percentile: float | None = None, threshold: float | None = None) -> DataFrame:
    """Samples by their variance to mean ratio at one GC; kept up to a threshold or a percentile (0 to 100)."""
    ratio = stats.filter(F.col("gc") == gc).groupBy("sample_id").agg(F.avg(F.try_divide("var", "mean")).alias("vmr"))
    if threshold is not None:
        return ratio.withColumn("kept", F.col("vmr") <= threshold)
    limit = ratio.agg(F.percentile("vmr", percentile / 100).alias("_limit"))
    return ratio.join(F.broadcast(limit)).withColumn("kept", F.col("vmr") <= F.col("_limit")).drop("_limit")  # one row


# ------------------------------------------------------------------ LOESS
def loess(x: np.ndarray, y: np.ndarray, n: np.ndarray, at: np.ndarray, fraction: float) -> np.ndarray:
    """Local linear fits of bin means y with counts n at ascending x, each over the nearest fraction of all points.

    Points are as near as their bin; of the bin at the edge only the part that is needed counts. Tricube of the
    distance over the full range weighs a point, squared, as weights multiply residuals. Where all that is needed
    lies in one bin, its mean is the fit."""
    total, span = n.sum(), max(float(x.max() - x.min()), 1e-9)
    need = max(1.0, round(total * fraction))
    out = np.empty(len(at))
    for k, x0 in enumerate(at):
        order = np.argsort(np.abs(x - x0), kind="stable")
        before = np.concatenate(([0], np.cumsum(n[order])[:-1]))
        part = np.clip(need - before, 0, n[order])
        xs, ys = x[order][part > 0], y[order][part > 0]
        w = part[part > 0] * (1 - np.minimum(np.abs(xs - x0) / span, 1) ** 3) ** 6
        if len(xs) == 1 or w.sum() <= 0:
            out[k] = ys[0]
            continue
        mx, my = np.average(xs, weights=w), np.average(ys, weights=w)
        sxx = np.sum(w * (xs - mx) ** 2)
        out[k] = my + (np.sum(w * (xs - mx) * (ys - my)) / sxx * (x0 - mx) if sxx > 1e-12 else 0.0)
    return out


def smooth_by_gc(windows: DataFrame, value: str, fraction: float = 0.2, by: Sequence[str] = ("sample_id",), least_var_windows: int = 10) -> DataFrame:
    """mean_loess and var_loess of each (sample, gc). Windows are first folded into their GC bin (at most 101 a
    sample), which is all that a local fit over whole-number GC needs, so a group is never large."""
    bins = windows.groupBy(*by, "gc").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))

    def fit(bins: pd.DataFrame) -> pd.DataFrame:
        b = bins.sort_values("gc")
        x, n = b["gc"].to_numpy(float), b["n"].to_numpy(float)
        mean = loess(x, b["mean"].to_numpy(float), n, x, fraction)
        many = n >= least_var_windows
        if many.sum() < 2:
            many = np.ones(len(n), bool)
        var = loess(x[many], b["var"].to_numpy(float)[many], n[many], x, 1.0)
        return b.assign(mean_loess=mean, var_loess=np.maximum(var, mean + 0.01))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bins.schema)
    return bins.groupBy(*by).applyInPandas(fit, f"{fields}, mean_loess double, var_loess double")


def background(windows: DataFrame, value: str = "depth1", fraction: float = 0.2) -> DataFrame:
    """The background model: smoothed mean and variance and negative-binomial n, p by sample and GC."""
    fits = smooth_by_gc(windows, value, fraction)
    n, p = nb_parameters(F.col("mean_loess"), F.col("var_loess"))
    return fits.withColumn("nb_n", n).withColumn("nb_p", p)

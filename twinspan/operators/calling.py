"""Variant calling over pooled reads: allele observations, read locations, pooled and per-copy genotypes, biases,
and filters. Long tables keyed by (variant, sample, read); what sums over reads is an aggregation."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logmath import LN10, binomial_log_tail, fisher_exact, genotypes, np_logsumexp
from .grouped import Apart, Spaced, map_groups
from .covers import extremes
from .intervals import overlap_join, with_islands, with_sessions

MISSING_PENALTY, MATE_PENALTY = -4 * LN10, -5 * LN10
LOW_DEPTH, HIGH_DEPTH, MAX_BIAS = 3, 2000, 30.0


# ------------------------------------------------------------------ observations and locations
def quality_filter(observations: DataFrame, snp: float = 10, indel: float = 10) -> DataFrame:
    """Observations (is_snp, ln_qual) whose error probability is small enough."""
    limit = F.when(F.col("is_snp"), F.lit(-0.1 * snp * LN10)).otherwise(F.lit(-0.1 * indel * LN10))
    return observations.filter(F.col("ln_qual") <= limit)


def read_location(reads: DataFrame, unique: DataFrame, least_overlap: int = 15, least_mapq: int = 50) -> DataFrame:
    """Where a pooled read belongs by itself: to its original place (oa) where it was mapped well, or to the unique
    stretch that it overlaps enough; else unknown. reads: read_id, chrom_id, s, e, oa, mapq, clipped."""
    size = F.least("e", "b_e") - F.greatest("s", "b_s")
    most = overlap_join(reads.select("read_id", "chrom_id", "s", "e"), unique).groupBy("read_id").agg(F.max(size).alias("_u"))
    rows = reads.join(most, "read_id", "left")
    known = F.when(F.col("clipped"), "unknown").when(F.col("_u") >= least_overlap, "unique").when(F.col("oa").isNotNull() & (F.col("mapq") >= least_mapq), "original").otherwise("unknown")
    return rows.withColumn("location", known).drop("_u")


def location_probabilities(weights: DataFrame) -> DataFrame:
    """weights: sample_id, read_id, copy, ln_weight by evidence (variants, mates, penalties). The posterior of each
    copy: sums per read and copy, log-softmax over copies. A read meets a handful of copies."""
    total = weights.groupBy("sample_id", "read_id", "copy").agg(F.sum("ln_weight").alias("w"))
    w = Window.partitionBy("sample_id", "read_id")
    shifted = total.withColumn("_m", F.max("w").over(w))
    return shifted.withColumn("ln_prob", F.col("w") - F.col("_m") - F.ln(F.sum(F.exp(F.col("w") - F.col("_m"))).over(w))).drop("_m", "w")


def join_mates(locations: DataFrame, max_distance: int) -> DataFrame:
    """locations: read_id, mate, copy, pos, ln_prob. Each read pair's best pair of places: one copy, near enough, or
    else the best of both with a penalty."""
    x = locations.filter("mate = 1").select("read_id", F.col("copy").alias("copy1"), F.col("pos").alias("pos1"), F.col("ln_prob").alias("p1"))
    y = locations.filter("mate = 2").select("read_id", F.col("copy").alias("copy2"), F.col("pos").alias("pos2"), F.col("ln_prob").alias("p2"))
    near = (F.col("copy1") == F.col("copy2")) & (F.abs(F.col("pos1") - F.col("pos2")) <= max_distance)
    pairs = x.join(y, "read_id").withColumn("score", F.col("p1") + F.col("p2") + F.when(near, 0.0).otherwise(MATE_PENALTY))
    return pairs.groupBy("read_id").agg(F.max_by(F.struct("copy1", "copy2"), F.struct(F.col("score"), -F.col("copy1"), -F.col("copy2"))).alias("best"), F.max("score").alias("score"))


def common_reads(observations: DataFrame, max_ahead: int = 10) -> DataFrame:
    """Pairs of variants of a sample that reads connect, with counts of reads that agree and that conflict.
    observations: sample_id, read_hash, rank (of the variant), copy. Joined on the read, of which there are few rows."""
    y = observations.select("sample_id", "read_hash", F.col("rank").alias("rank2"), F.col("copy").alias("copy2"))
    pairs = observations.join(y, ["sample_id", "read_hash"]).filter((F.col("rank2") > F.col("rank")) & (F.col("rank2") - F.col("rank") <= max_ahead))
    return pairs.groupBy("sample_id", "rank", "rank2").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("copy") != F.col("copy2")).alias("conflicts"))


def conflicting(pairs: DataFrame, error: float = 0.05, p_value: float = 1e-3) -> DataFrame:
    """Adds whether so few agreeing reads are too unlikely: P(agree <= seen) under the error rate."""

    @F.pandas_udf("boolean")
    def unlikely(n: pd.Series, bad: pd.Series) -> pd.Series:
        return pd.Series([k > 0 and binomial_log_tail(int(k - b), int(k), 1 - error) <= math.log(p_value) for k, b in zip(n, bad)])

    return pairs.withColumn("conflict", unlikely("n", "conflicts"))


def keep_consistent(n: int, conflicts: set[tuple[int, int]], fitness: list[float]) -> list[int]:
    """Greedy largest consistent set: by fitness times the number of partners it agrees with."""
    agrees = {i: {j for j in range(n) if j != i and (min(i, j), max(i, j)) not in conflicts} for i in range(n)}
    left, kept = set(range(n)), []
    while left:
        best = max(left, key=lambda i: (fitness[i] * (1 + len(agrees[i] & left)), -i))
        kept.append(best)
        left = {j for j in left if j != best and j in agrees[best]}
    return sorted(kept)


# ------------------------------------------------------------------ genotypes
def pooled_genotypes(observations: DataFrame, copies: int, n_alleles: int, error: float = 0.01, threshold: float = 1e-5) -> DataFrame:
    """observations: variant_id, sample_id, allele_ix, n. The likeliest pooled genotype of `copies` alleles, its
    Phred quality, and how many genotypes pass the threshold; counts are pivoted, so a key is one row."""
    table = genotypes(n_alleles, copies)
    wide = observations.groupBy("variant_id", "sample_id").pivot("allele_ix", list(range(n_alleles))).agg(F.sum("n")).na.fill(0)
    shares = np.array([[max(k, error * copies) for k in g] for g in table])
    logs = np.log(shares / shares.sum(axis=1, keepdims=True))
    columns = [str(i) for i in range(n_alleles)]

    @F.pandas_udf("struct<gt:string,gq:double,n_likely:bigint>")
    def called(*counts: pd.Series) -> pd.DataFrame:
        c = np.stack([x.to_numpy(float) for x in counts], axis=1)
        ll = c @ logs.T
        ll = ll - np_logsumexp(ll, axis=1)[:, None]
        best = np.round(ll, 9).argmax(axis=1)  # of equal ones the first
        rest = ll.copy()
        rest[np.arange(len(ll)), best] = -np.inf
        gq = np.minimum(-10 / LN10 * np_logsumexp(rest, axis=1), 10000.0) if len(table) > 1 else np.full(len(ll), 10000.0)
        return pd.DataFrame({"gt": ["/".join(str(i) for i, k in enumerate(table[b]) for _ in range(k)) for b in best], "gq": gq, "n_likely": (ll >= math.log(threshold)).sum(axis=1)})

    return wide.withColumn("_g", called(*(F.col(f"`{c}`") for c in columns))).select("variant_id", "sample_id", "_g.gt", "_g.gq", "_g.n_likely")


@lru_cache(maxsize=None)
def parts_of(counts: tuple[int, ...], size: int) -> tuple[tuple[int, ...], ...]:
    """All ways to take `size` of some alleles, given how many there are of each: how many of each are taken."""
    if len(counts) == 1:
        return ((size,),) if size <= counts[0] else ()
    return tuple((k, *rest) for k in range(min(size, counts[0]), -1, -1) if size - k <= sum(counts[1:]) for rest in parts_of(counts[1:], size - k))


@lru_cache(maxsize=1 << 14)
def copy_genotypes(counts: tuple[int, ...], copies: tuple[int, ...]) -> tuple[tuple[tuple[int, ...], ...], ...]:
    """All different ways to deal a pooled genotype's alleles out to copies of the given numbers: copy by copy what it may
    take of the alleles that are left, so the work grows with the result."""
    if not copies:
        return ((),)
    out = []
    for taken in parts_of(counts, copies[0]):
        own = tuple(i for i, k in enumerate(taken) for _ in range(k))
        out += [(own, *rest) for rest in copy_genotypes(tuple(c - k for c, k in zip(counts, taken)), copies[1:])]
    return tuple(sorted(out))


def arrangements(dealt: tuple[tuple[int, ...], ...]) -> int:
    """In how many orders of single chromosomes this is what the copies have."""
    out = 1
    for own in dealt:
        out *= math.factorial(len(own)) // math.prod(math.factorial(own.count(a)) for a in set(own))
    return out


def read_support(location: np.ndarray, allele: np.ndarray, table: list[tuple[tuple[int, ...], ...]], error: float = 0.01) -> np.ndarray:
    """ln P(reads | per-copy genotype): location (reads, copies) in ln, allele of each read. A read's probability is
    the sum over copies of P(copy) times the share of its allele there."""
    out = np.zeros(len(table))
    for g, copies in enumerate(table):
        p = np.empty_like(location)
        for c, own in enumerate(copies):
            share = np.array([own.count(a) / len(own) if own else 0.0 for a in allele])
            p[:, c] = location[:, c] + np.log(np.clip(share, error, 1 - error))
        out[g] = np_logsumexp(p, axis=1).sum() if len(allele) else 0.0
    return out - np_logsumexp(out)


def extended_copies(cns: list[int | None], total: int) -> list[int]:
    """Known copies as they are; the unknown ones are one copy with what remains of the total. Empty where nothing fits."""
    known = [c for c in cns if c is not None]
    rest = total - sum(known)
    if rest < 0 or (rest > 0) != (len(known) < len(cns)):
        return []
    return known + ([rest] if rest else [])


# ------------------------------------------------------------------ biases, filters, overlaps
def bias(counts: DataFrame, columns: tuple[str, str]) -> DataFrame:
    """counts: variant_id, allele_ix and two counts (forward and reverse, or paired and unpaired). Per variant, the
    largest Phred of Fisher's exact test of an allele against all others."""
    a, b = columns
    w = Window.partitionBy("variant_id")
    rows = counts.withColumn("_ta", F.sum(a).over(w)).withColumn("_tb", F.sum(b).over(w))

    @F.pandas_udf("double")
    def phred(x: pd.Series, y: pd.Series, tx: pd.Series, ty: pd.Series) -> pd.Series:
        return pd.Series([abs(-10 * math.log10(max(fisher_exact(int(p), int(q), int(s - p), int(t - q)), 1e-300))) for p, q, s, t in zip(x, y, tx, ty)])

    return rows.withColumn("_p", phred(a, b, "_ta", "_tb")).groupBy("variant_id").agg(F.max("_p").alias("bias"))


def variant_filters(depth: Column, strand_bias: Column, pair_bias: Column, agcn: Column, pscn: Column, conflict: Column | None = None, outside: Column | None = None) -> Column:
    """`PASS` or the names of what speaks against a call. conflict: estimates that the variant overlaps differ
    (copy_numbers_of_variants); outside: it reaches over the end of a copy."""
    tests = {
        "LowReadDepth": depth < LOW_DEPTH, "HighReadDepth": depth > HIGH_DEPTH, "StrandBias": strand_bias > MAX_BIAS, "UnpairedBias": pair_bias > MAX_BIAS,
        "UnknownAgCN": agcn.isNull(), "UnknownPsCN": agcn.isNotNull() & pscn.isNull(), "ZeroPsCN": pscn == 0,
    }
    tests |= {k: c for k, c in (("ConflictingCN", conflict), ("OutOfBounds", outside)) if c is not None}
    tags = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in tests.items())))
    return F.when(F.size(tags) == 0, "PASS").otherwise(F.array_join(tags, ";"))


def resolve_overlaps(variants: DataFrame, part: str = "chrom_id") -> DataFrame:
    """variants: variant_id, chrom_id, s, e, quality. Of overlapping ones the better stay: islands of overlapping
    variants first, and then greedily inside each, in n log n steps."""
    marked = with_islands(variants, [part], "_i", 0)
    names, fields = list(variants.columns), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in variants.schema)
    i_s, i_e, i_q, i_id = (names.index(c) for c in ("s", "e", "quality", "variant_id"))

    def greedy(island: list[tuple]) -> list[tuple]:
        apart = Apart()
        return [r[: len(names)] for r in sorted(island, key=lambda r: (-r[i_q], r[i_s], r[i_id])) if apart.take(r[i_s], r[i_e])]

    return map_groups(marked.select(*names, "_i"), [part, "_i"], ["s"], greedy, fields)


def suppress_close(variants: DataFrame, radius: int = 100, part: str = "chrom_id") -> DataFrame:
    """variants: variant_id, chrom_id, s, info, is_snp. By information, single bases first, then by place; others
    within the radius of one that stays go. Inside runs without a gap of the radius, in n log n steps."""
    marked = with_sessions(variants, [part], "s", radius, "_i")
    names, fields = list(variants.columns), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in variants.schema)
    i_s, i_info, i_snp, i_id = (names.index(c) for c in ("s", "info", "is_snp", "variant_id"))

    def greedy(run: list[tuple]) -> list[tuple]:
        near = Spaced(radius + 1)
        return [r[: len(names)] for r in sorted(run, key=lambda r: (-r[i_info], not r[i_snp], r[i_s], r[i_id])) if near.take(r[i_s])]

    return map_groups(marked.select(*names, "_i"), [part, "_i"], ["s"], greedy, fields)


def copy_numbers_of_variants(variants: DataFrame, profile: DataFrame) -> DataFrame:
    """variants: variant_id, chrom_id, s, e; profile: sample_id, chrom_id, s, e, cn. Per variant and sample: the copy
    number where all estimates that it overlaps agree, null and `conflict` where they differ."""
    found = extremes(variants.select("variant_id", "chrom_id", "s", "e"), profile, "variant_id", "sample_id", "cn")
    agreed = found.groupBy("variant_id", "sample_id").agg(F.min("low").alias("_low"), F.max("high").alias("_high"))
    return agreed.select("variant_id", "sample_id", F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("cn"), (F.col("_low") != F.col("_high")).alias("conflict"))

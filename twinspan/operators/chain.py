"""Calling for each sample: pooled genotypes, the variants that can place its reads, which copy each read is from, and
genotypes of every copy. Tables keyed by sample, so samples and loci are tasks of one plan; only a variant's reads of one sample
(as many as its depth) and a sample's linked variants meet in one worker."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.logmath import LN10, genotypes, np_logsumexp
from .calling import common_reads, conflicting, copy_genotypes, extended_copies, keep_consistent, location_probabilities, pooled_genotypes, read_support, variant_filters
from .grouped import map_groups
from .variants import usability

MAX_PHRED = 10_000.0


@dataclass(frozen=True)
class ChainConfig:
    error: float = 0.01
    threshold: float = 1e-5
    max_total: int = 8  # pooled genotypes are called up to this copy number
    least_ref_quality: float = 20
    p_conflict: float = 1e-3
    link_ahead: int = 10  # variants ahead that shared reads link


def pooled_calls(observations: DataFrame, copy_numbers: DataFrame, n_alleles: int, config: ChainConfig = ChainConfig()) -> DataFrame:
    """observations: locus, variant_id, sample_id, read_id, allele_ix; copy_numbers: variant_id, sample_id, agcn, pscn (array).
    variant_id, sample_id, agcn, pscn, depth, gt, gq, n_likely: the pooled genotype under each sample's own total."""
    counts = observations.groupBy("variant_id", "sample_id", "allele_ix").agg(F.count(F.lit(1)).alias("n"))
    known = counts.join(copy_numbers.select("variant_id", "sample_id", "agcn"), ["variant_id", "sample_id"])
    parts = [pooled_genotypes(known.filter(F.col("agcn") == t).drop("agcn"), t, n_alleles, config.error, config.threshold) for t in range(1, config.max_total + 1)]
    called = parts[0]
    for p in parts[1:]:
        called = called.unionByName(p)
    depth = counts.groupBy("variant_id", "sample_id").agg(F.sum("n").alias("depth"))
    return copy_numbers.join(depth, ["variant_id", "sample_id"]).join(called, ["variant_id", "sample_id"], "left")


def informative_psvs(calls: DataFrame, psvs: DataFrame, config: ChainConfig = ChainConfig()) -> DataFrame:
    """Adds why each PSV of each sample can or can't place reads. psvs: variant_id, locus, rank, copy_alleles (of each copy),
    f_values. Where all copies carry one allele it can't tell them apart."""
    rows = calls.join(psvs, "variant_id")
    different = F.size(F.array_distinct("copy_alleles"))
    quality = F.lit(-10 / LN10) * F.ln(F.greatest(1 - F.array_min("f_values"), F.lit(1e-6))) + F.coalesce("gq", F.lit(0.0))
    unknown = F.coalesce(F.exists("pscn", lambda c: c.isNull()), F.lit(True))
    return rows.withColumn("reason", usability(F.col("agcn"), F.when(~unknown, F.lit(1)), different, quality, F.lit(False), config.least_ref_quality))


def consistent_psvs(observations: DataFrame, usable: DataFrame, config: ChainConfig = ChainConfig()) -> DataFrame:
    """(variant_id, sample_id) of usable PSVs without those that shared reads contradict: pairs whose reads disagree about their
    copy too often are in conflict, and of each sample and locus a largest set without one is taken greedily by information."""
    placed = usable.select("variant_id", "sample_id", "locus", "rank", "copy_alleles", F.array_min("f_values").alias("fitness"))
    own = F.array_position(F.col("copy_alleles"), F.col("allele_ix")) - 1
    seen = observations.select("variant_id", "sample_id", "read_id", "allele_ix").join(placed, ["variant_id", "sample_id"]).withColumn("copy", own).filter("copy >= 0")
    keyed = seen.select(F.struct("sample_id", "locus").alias("sample_id"), F.col("read_id").alias("read_hash"), "rank", "copy")
    pairs = conflicting(common_reads(keyed, config.link_ahead), p_value=config.p_conflict).filter("conflict")
    bad = pairs.groupBy("sample_id.sample_id", "sample_id.locus").agg(F.collect_set(F.struct("rank", "rank2")).alias("bad"))
    rows = placed.join(bad, ["sample_id", "locus"], "left").select("sample_id", "locus", "rank", "variant_id", "fitness", "bad")

    def choose(part: list[tuple]) -> list[tuple]:
        at = {r[2]: k for k, r in enumerate(part)}
        conflicts = {(at[p["rank"]], at[p["rank2"]]) for p in part[0][5] or () if p["rank"] in at and p["rank2"] in at}
        kept = keep_consistent(len(part), conflicts, [r[4] for r in part]) if conflicts else range(len(part))
        return [(part[k][3], part[k][0]) for k in kept]

    kinds = dict(placed.dtypes)
    return map_groups(rows, ["sample_id", "locus"], ["rank"], choose, f"variant_id {kinds['variant_id']}, sample_id {kinds['sample_id']}")


def read_copies(observations: DataFrame, informative: DataFrame, config: ChainConfig = ChainConfig()) -> DataFrame:
    """(sample_id, read_id, copy, ln_prob): the posterior of each copy for every read that covers an informative PSV. A copy
    that has the read's allele explains it with its f-value, another one with what is left of that."""
    rows = observations.select("variant_id", "sample_id", "read_id", "allele_ix").join(informative.select("variant_id", "sample_id", "copy_alleles", "f_values", "pscn"), ["variant_id", "sample_id"])
    each = rows.select("sample_id", "read_id", "allele_ix", F.posexplode(F.arrays_zip("copy_alleles", "f_values", "pscn")).alias("copy", "c"))
    agrees = F.greatest(F.lit(config.error), F.least(F.lit(1 - config.error), F.col("c.f_values")))
    weight = F.ln(F.when(F.col("c.copy_alleles") == F.col("allele_ix"), agrees).otherwise(1 - agrees))
    there = F.when(F.col("c.pscn") == 0, F.lit(-30.0)).otherwise(0.0)  # a read of a copy that the sample lacks
    return location_probabilities(each.select("sample_id", "read_id", "copy", (weight + there).alias("ln_weight")))


CALLS = pa.schema([("variant_id", pa.int64()), ("sample_id", pa.int64()), ("paralog_gt", pa.string()), ("paralog_gq", pa.float64()), ("copy_quals", pa.list_(pa.float64()))])


def likely_genotypes(counts: list[int], total: int, config: ChainConfig) -> list[tuple[int, ...]]:
    """Pooled genotypes, as counts of alleles, whose probability under an even prior reaches the threshold; the best at least."""
    table = genotypes(len(counts), total)
    shares = np.array([[max(k, config.error * total) for k in g] for g in table])
    logs = np.log(shares / shares.sum(axis=1, keepdims=True)) @ np.array(counts, float)
    logs = logs - np_logsumexp(logs)
    return [g for g, p in zip(table, logs) if p >= np.log(config.threshold) or p == logs.max()]


def _joined(logs: list[float], at: list[int], unknown: list[int]) -> list[float]:
    """A read's ln probabilities of the known copies, and of all unknown ones together."""
    return [logs[i] for i in at] + ([float(np_logsumexp(np.array([logs[i] for i in unknown])))] if unknown else [])


def paralog_calls(observations: DataFrame, calls: DataFrame, locations: DataFrame, n_alleles: int, config: ChainConfig = ChainConfig()) -> DataFrame:
    """variant_id, sample_id, paralog_gt (`0/0;0/1`: a genotype for each copy), paralog_gq, copy_quals. All ways to deal the
    alleles of the pooled genotypes that are likely enough out to the copies are weighed by the reads, each with what is
    known of its copy; a read that covers no informative PSV is from any copy, in proportion to their numbers. Copies of unknown
    numbers are one copy with what the known ones leave of the total: its genotype stands in the place of the first of them, `+` in those
    of the others, and all have its quality."""
    known = calls.filter(F.col("gt").isNotNull() & (F.size("pscn") > 0) & F.exists("pscn", lambda c: c.isNotNull()))
    rest = F.col("agcn") - F.aggregate("pscn", F.lit(0), lambda a, c: a + F.coalesce(c.cast("int"), F.lit(0)))
    known = known.filter(F.when(F.exists("pscn", lambda c: c.isNull()), rest > 0).otherwise(rest == 0))
    where = locations.groupBy("sample_id", "read_id").agg(F.array_sort(F.collect_list(F.struct("copy", "ln_prob"))).alias("where"))
    reads = observations.select("variant_id", "sample_id", "read_id", "allele_ix").join(where, ["sample_id", "read_id"], "left")
    rows = reads.join(known.select("variant_id", "sample_id", "pscn", "agcn"), ["variant_id", "sample_id"]).select("variant_id", "sample_id", "pscn", "allele_ix", "where", "agcn")

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []
        for (variant, sample), group in groupby(every, key=lambda r: r[:2]):
            part = list(group)
            pscn = [None if c is None else int(c) for c in part[0][2]]
            copies = tuple(extended_copies(pscn, int(part[0][5])))
            at = [i for i, c in enumerate(pscn) if c is not None]  # places of the copies; the unknown ones behind all others
            unknown = [i for i, c in enumerate(pscn) if c is None]
            pooled = likely_genotypes([sum(r[3] == i for r in part) for i in range(n_alleles)], sum(copies), config)
            table = [g for counts in pooled for g in copy_genotypes(counts, copies)]
            even = np.log(np.maximum(np.array(copies, float) / sum(copies), 1e-13))
            location = np.array([_joined([x["ln_prob"] for x in r[4]], at, unknown) if r[4] and len(r[4]) == len(pscn) else even for r in part])
            logs = read_support(location, np.array([r[3] for r in part]), table, config.error)
            best = int(np.round(logs, 9).argmax())
            apart = lambda same: min(MAX_PHRED, -10 / LN10 * float(np_logsumexp(logs[~same]))) if (~same).any() else MAX_PHRED
            quals = [max(0.0, apart(np.array([g[c] == table[best][c] for g in table]))) for c in range(len(copies))]
            whole = max(0.0, apart(np.arange(len(table)) == best))
            texts = ["/".join(map(str, own)) if own else "." for own in table[best]]
            shown = {i: (texts[k], quals[k]) for k, i in enumerate(at)} | {i: ("+" if n else texts[-1], quals[-1]) for n, i in enumerate(unknown)}
            out.append((variant, sample, ";".join(shown[i][0] for i in range(len(pscn))), whole, [shown[i][1] for i in range(len(pscn))]))
            if len(out) >= 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), CALLS)], schema=CALLS)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), CALLS)], schema=CALLS)

    keys = ["variant_id", "sample_id"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "allele_ix").mapInArrow(call, "variant_id bigint, sample_id bigint, paralog_gt string, paralog_gq double, copy_quals array<double>")


def call_samples(observations: DataFrame, copy_numbers: DataFrame, psvs: DataFrame, n_alleles: int, config: ChainConfig = ChainConfig()) -> dict[str, DataFrame]:
    """The whole chain. `variants`: variant_id, sample_id, agcn, pscn, depth, gt, gq, paralog_gt, paralog_gq, copy_quals, filter;
    `psv_use`: why each PSV of a sample was used or not; `locations`: where reads are from."""
    calls = pooled_calls(observations, copy_numbers, n_alleles, config)
    judged = informative_psvs(calls, psvs, config)
    kept = consistent_psvs(observations, judged.filter("reason = 'ok'"), config).withColumn("_kept", F.lit(True))
    judged = judged.join(kept, ["variant_id", "sample_id"], "left").withColumn("reason", F.when((F.col("reason") == "ok") & F.col("_kept").isNull(), "conflict").otherwise(F.col("reason"))).drop("_kept")
    locations = read_copies(observations, judged.filter("reason = 'ok'"), config)
    dealt = paralog_calls(observations, calls, locations, n_alleles, config)
    known = F.when(~F.exists("pscn", lambda c: c.isNull()), F.array_max("pscn"))
    named = variant_filters(F.col("depth"), F.lit(0.0), F.lit(0.0), F.col("agcn"), known)
    return {"variants": calls.join(dealt, ["variant_id", "sample_id"], "left").withColumn("filter", named), "psv_use": judged.select("variant_id", "sample_id", "reason"), "locations": locations}

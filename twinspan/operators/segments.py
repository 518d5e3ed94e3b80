"""Segments of one copy number: forced by hand, refined by the variants in them, linked where neighbours agree, and split up
over the copies; and what comes out of it by place of each copy.

A group is one sample in one locus: its segments and the variants that tell copies apart there, some hundred rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.logmath import np_logsumexp
from .covers import first_covering, matrix
from .grouped import map_groups
from .intervals import STRETCH, numbered_runs, previous_row
from .paralog import copy_tuples, gene_conversions, psv_support

MOST = 1000.0  # Phred


@dataclass(frozen=True)
class SegmentConfig:
    copies: int = 2
    max_cn: int = 8  # a segment of this number may have more
    radius: int = 500  # variants as close share their weight when totals are refined
    conversion_qual: float = 20
    conversion_psvs: int = 3


@dataclass
class Segment:
    s: int
    e: int
    cn: int
    qual: float
    probable: list[tuple[int, float]]
    refined: int = 0  # variants that its number was refined with
    forced: bool = False


@dataclass
class Psv:
    ix: int
    pos: int
    n1: float
    n2: float
    f: np.ndarray
    info: float
    reliable: bool
    semi: bool


def phred(others: np.ndarray) -> float:
    """Of the ln probabilities of all that isn't the answer."""
    return max(0.0, min(MOST, -10 / math.log(10) * float(np_logsumexp(others)))) if len(others) else MOST


def with_forced(segments: list[Segment], forced: list[tuple[int, int, int]]) -> list[Segment]:
    """Segments cut where stretches (s, e, cn) with a number by hand begin and end; those inside have it. Of stretches that
    overlap the first one counts."""
    out: list[Segment] = []
    for g in segments:
        ends = sorted({g.s, g.e, *(min(max(x, g.s), g.e) for s, e, _ in forced for x in (s, e))})
        for s, e in zip(ends, ends[1:]):
            cn = next((cn for fs, fe, cn in forced if fs <= s and e <= fe), None)
            new = Segment(s, e, g.cn, g.qual, g.probable) if cn is None else Segment(s, e, cn, MOST, [(cn, 0.0)], forced=True)
            last = out[-1] if out else None
            if last and last.forced and new.forced and last.cn == new.cn and last.e == s:
                last.e = e
            else:
                out.append(new)
    return out


def inside(psvs: list[Psv], s: int, e: int) -> list[Psv]:
    return [p for p in psvs if s <= p.pos < e]


def neighbour_weights(psvs: list[Psv], radius: int) -> np.ndarray:
    """One over the number of variants (in order) within radius, itself among them."""
    pos = np.array([p.pos for p in psvs])
    return 1.0 / (np.searchsorted(pos, pos + radius, side="right") - np.searchsorted(pos, pos - radius))


def split_logs(psvs: list[Psv], cn: int, copies: int, weights: np.ndarray | None = None) -> np.ndarray:
    """ln P(counts | split) of each way to deal cn to the copies, over the variants."""
    tuples = copy_tuples(cn, copies)
    out = np.zeros(len(tuples))
    for k, p in enumerate(psvs):
        out += (1.0 if weights is None else weights[k]) * psv_support(np.array([p.n1]), np.array([p.n2]), tuples, p.f)[0]
    return out


def refine(segment: Segment, psvs: list[Psv], config: SegmentConfig) -> Segment:
    """The segment with the total that its reliable variants make likeliest, of those that its depths allow."""
    own = [p for p in inside(psvs, segment.s, segment.e) if p.reliable]
    if len(segment.probable) < 2 or not own:
        return segment
    weights = neighbour_weights(own, config.radius)
    logs = np.array([lp + np_logsumexp(split_logs(own, c, config.copies, weights)) for c, lp in segment.probable])
    logs -= np_logsumexp(logs)
    best = int(logs.argmax())
    return Segment(segment.s, segment.e, segment.probable[best][0], phred(np.delete(logs, best)), [(c, float(x)) for (c, _), x in zip(segment.probable, logs)], len(own))


def linked(segments: list[Segment]) -> list[list[Segment]]:
    """Neighbours of one number."""
    out: list[list[Segment]] = []
    for g in segments:
        if out and out[-1][-1].cn == g.cn:
            out[-1].append(g)
        else:
            out.append([g])
    return out


def marginals(tuples: tuple[tuple[int, ...], ...], logs: np.ndarray) -> list[list[float]]:
    """For each copy, ln P of its having 0, 1, ... of the total."""
    total = sum(tuples[0])
    return [[float(np_logsumexp(logs[[i for i, t in enumerate(tuples) if t[c] == k]])) for k in range(total + 1)] for c in range(len(tuples[0]))]


def resolve(segments: list[Segment], psvs: list[Psv], config: SegmentConfig) -> list[tuple]:
    """Rows (link, s, e, cn, cn_qual, n_segments, n_refined, n_psvs, n_reliable, pscn, pscn_qual, marginals, filter, conversions) of
    linked segments: one split explains the variants of all of a link's segments together."""
    out = []
    for k, link in enumerate(linked([refine(g, psvs, config) if not g.forced else g for g in segments])):
        cn, s, e = link[0].cn, link[0].s, link[-1].e
        row = (k, s, e, cn, min(g.qual for g in link), len(link), sum(g.refined > 0 for g in link))
        own = [p for g in link for p in inside(psvs, g.s, g.e)]
        good = [p for p in own if p.reliable]
        tags = ["HighCN"] if config.copies > config.max_cn // 2 else []
        if cn == 0:
            out.append((*row, len(own), len(good), None, None, None, "PASS", None))
            continue
        if cn >= config.max_cn and not link[0].forced:
            tags.append("UncertainCN")
        elif not own:
            tags.append("NoGoodPSVs")
        elif not good:
            tags.append("NoReliable")
        if tags:
            out.append((*row, len(own), len(good), None, None, None, ";".join(tags), None))
            continue
        tuples = copy_tuples(cn, config.copies)
        logs = split_logs(good, cn, config.copies)
        logs -= np_logsumexp(logs)
        by_copy = marginals(tuples, logs)
        best = [int(np.argmax(m)) for m in by_copy]
        quals = [phred(np.delete(np.array(m), b)) for m, b in zip(by_copy, best)]
        if np.mean([p.info for p in good]) < 0.9:
            tags.append("LowInfoContent")
        if max(p.f.min() for p in good) < 0.99:
            tags.append("NoComplReliable")
        if len(good) < 3:
            tags.append("FewReliable")
        found = ""
        semi = [p for p in own if p.semi]
        if min(quals) >= config.conversion_qual and len(semi) >= config.conversion_psvs:
            each = np.array([split_logs([p], cn, config.copies) for p in semi])
            runs = gene_conversions(each - np_logsumexp(each, axis=1)[:, None], int(logs.argmax()))
            found = ";".join(f"{semi[i].pos}-{semi[j - 1].pos + 1}:{','.join(map(str, tuples[t]))}:{j - i}" for i, j, t in runs)
        out.append((*row, len(own), len(good), ",".join(map(str, best)), ",".join(f"{q:.0f}" for q in quals), by_copy, ";".join(tags) or "PASS", found))
    return out


def paralog_segments(segments: DataFrame, psvs: DataFrame, forced: DataFrame | None = None, config: SegmentConfig = SegmentConfig()) -> DataFrame:
    """segments: as copynumber.segment_copy_numbers() gives them (locus, sample_id, s, e, cn, cn_qual, probable). psvs: locus,
    sample_id, psv_ix, pos, n1, n2, f (array), info, reliable, semi. forced: locus, sample_id (null: all samples), s, e, cn.
    Rows of resolve() by locus and sample. A sample without variants in a locus has the tag NoGoodPSVs."""
    kinds = "locus bigint, sample_id bigint, kind int, s bigint, e bigint, cn bigint, qual double, probable array<struct<cn:bigint,ln_p:double>>, n1 double, n2 double, f array<double>, reliable boolean, semi boolean"
    empty = {c.split(" ", 1)[0]: c.split(" ", 1)[1] for c in kinds.split(", ")}

    def like(df: DataFrame, kind: int, **given) -> DataFrame:
        return df.select("locus", "sample_id", *((given[c] if c in given else F.lit(kind) if c == "kind" else F.lit(None)).cast(t).alias(c) for c, t in list(empty.items())[2:]))

    rows = like(segments, 1, s=F.col("s"), e=F.col("e"), cn=F.col("cn"), qual=F.col("cn_qual"), probable=F.col("probable"))
    rows = rows.union(like(psvs, 2, s=F.col("pos"), e=F.col("psv_ix"), qual=F.col("info"), n1=F.col("n1"), n2=F.col("n2"), f=F.col("f"), reliable=F.col("reliable"), semi=F.col("semi")))
    if forced is not None:
        everyone = segments.select("locus", "sample_id").distinct()
        named = forced.filter("sample_id is not null").unionByName(forced.filter("sample_id is null").drop("sample_id").join(everyone, "locus").select(forced.columns))
        rows = rows.union(like(named, 0, s=F.col("s"), e=F.col("e"), cn=F.col("cn")))

    def run(part: list[tuple]) -> list[tuple]:
        by_hand = [(r[3], r[4], r[5]) for r in part if r[2] == 0]
        own = [Segment(r[3], r[4], r[5], r[6], [(p["cn"], p["ln_p"]) for p in r[7]]) for r in part if r[2] == 1]
        variants = [Psv(r[4], r[3], r[8], r[9], np.array(r[10], float), r[6], r[11], r[12]) for r in part if r[2] == 2 and r[8] + r[9] > 0]
        return [(part[0][0], part[0][1], *r) for r in resolve(with_forced(own, by_hand) if by_hand else own, variants, config)]

    schema = (
        "locus bigint, sample_id bigint, link bigint, s bigint, e bigint, cn bigint, cn_qual double, n_segments bigint, n_refined bigint, n_psvs bigint, n_reliable bigint,"
        " pscn string, pscn_qual string, marginals array<array<double>>, filter string, conversions string"
    )
    return map_groups(rows, ["locus", "sample_id"], ["kind", "s", "e"], run, schema)


# ------------------------------------------------------------------ results by copy
def by_copy(results: DataFrame, id_col: str = "result_id") -> DataFrame:
    """results: id, sample_id, copies (array<struct<chrom_id,s,e>>), pscn and qual (arrays, one value a copy; null where unknown). A
    row for each copy: id, copy (from 1), sample_id, chrom_id, s, e, cn, qual."""
    each = results.select(id_col, "sample_id", F.posexplode(F.arrays_zip("copies", "pscn", "qual")).alias("k", "x"))
    return each.select(id_col, (F.col("k") + 1).alias("copy"), "sample_id", "x.copies.chrom_id", "x.copies.s", "x.copies.e", F.col("x.pscn").alias("cn"), F.col("x.qual").alias("qual"))


def copy_profile(entries: DataFrame, width: int = STRETCH) -> DataFrame:
    """entries: entry_id, sample_id, chrom_id, s, e, cn, qual, which may overlap. What is known of each place of each sample: where
    entries overlap, the one of the best quality (of equal ones the smaller id); then neighbours that touch and agree are one, with
    the lowest of their qualities. sample_id, chrom_id, s, e, cn, qual."""
    best = first_covering(entries.filter("s < e"), ["sample_id", "chrom_id"], [F.desc_nulls_last("qual"), "entry_id", F.desc_nulls_last("cn")], ["cn", "qual"])
    part = ["sample_id", "chrom_id"]
    rows = previous_row(best, part, "s", ["e", "cn"], width)
    same = (F.col("_previous.e") == F.col("s")) & F.col("_previous.cn").eqNullSafe(F.col("cn"))
    runs = numbered_runs(rows.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).drop("_previous"), part, ["s"], "_new", "_run")
    out = runs.groupBy(*part, "_run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.first("cn").alias("cn"), F.min("qual").alias("qual"))
    return out.select(*part, "s", "e", "cn", "qual")


def copy_matrix(entries: DataFrame, samples: list[int]) -> DataFrame:
    """entries as in copy_profile(). A row for each stretch that the same entries cover (chrom_id, s, e), with a text for each of the
    samples in order: its number, `!` where its entries disagree, `?` where the one number is unknown, `.` where it has none."""
    texts = entries.filter("s < e").withColumn("v", F.coalesce(F.col("cn").cast("string"), F.lit("?")))
    return matrix(texts, ["chrom_id"], "sample_id", samples, "v", "!", ".")

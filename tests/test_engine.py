"""The engine's operators: golden cases, invariants, randomized comparisons, recovery of simulated parameters."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from twinspan.functions import logmath as lm
from twinspan.functions.expressions import compile_expression, parse_info
from twinspan.operators import alignment as al
from twinspan.operators import calling as ca
from twinspan.operators import chain
from twinspan.operators import cigars as cg
from twinspan.operators import copynumber as cn
from twinspan.operators import depth as dp
from twinspan.operators import genotypes as gt
from twinspan.operators import grouped as gr
from twinspan.operators import homology as hm
from twinspan.operators import intervals as iv
from twinspan.operators import paralog as pl
from twinspan.operators import relational as rel
from twinspan.operators import selfalign as sa
from twinspan.operators import variants as vr
from twinspan.plans import catalog


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def frame(spark, rows, schema="chrom_id long, s long, e long"):
    return spark.createDataFrame(rows, schema)


def random_intervals(rng, n, contigs=3, length=3000, widest=120):
    return [(rng.randrange(contigs), s := rng.randrange(length), s + rng.randint(1, widest)) for _ in range(n)]


# ------------------------------------------------------------------ golden values
def test_genotype_enumeration():
    assert lm.genotypes(3, 2) == ((2, 0, 0), (1, 1, 0), (1, 0, 1), (0, 2, 0), (0, 1, 1), (0, 0, 2))
    assert lm.genotypes(2, 3) == ((3, 0), (2, 1), (1, 2), (0, 3))


def test_distance_convention(spark):
    d = lambda s1, e1, s2, e2, c2=1: one(spark, iv.distance(F.lit(1), F.lit(s1), F.lit(e1), F.lit(c2), F.lit(s2), F.lit(e2)))
    assert (d(0, 10, 10, 20), d(0, 10, 12, 20), d(0, 10, 5, 20)) == (1, 3, 0) and d(0, 10, 0, 10, 2) == iv.FAR


def test_merge_and_disjoint_golden(spark):
    merged = iv.merge_overlapping(frame(spark, [(1, 0, 10), (1, 10, 20), (1, 22, 30)])).collect()
    assert sorted((r["s"], r["e"]) for r in merged) == [(0, 20), (22, 30)]
    rows = spark.createDataFrame([(1, 0, 10, 0), (1, 5, 15, 1)], "chrom_id long, s long, e long, id long")
    assert sorted((r["s"], r["e"], r["covering"]) for r in iv.disjoint_regions(rows, "id").collect()) == [(0, 5, [0]), (5, 10, [0, 1]), (10, 15, [1])]


def test_subtract_keeps_the_left_piece(spark):
    s, e = iv.subtract_first(F.lit(0), F.lit(10), F.lit(3), F.lit(5))
    assert (one(spark, s), one(spark, e)) == (0, 3)


def test_cigar_golden(spark):
    ops = cg.parse_cigar(F.lit("3=1X2D4=2I3="))
    assert [one(spark, cg.cigar_length(ops, k)) for k in (cg.REF_OPS, cg.READ_OPS, cg.BOTH_OPS)] == [13, 13, 11]
    assert one(spark, cg.format_cigar(ops)) == "3=1X2D4=2I3="
    df = spark.createDataFrame([(1, "3=1X4=1D2=")], "id long, c string").withColumn("ops", cg.parse_cigar(F.col("c")))
    got = sorted((r["ref_s"], r["ref_e"], r["read_s"], r["read_e"]) for r in cg.differences(df, "ops", ["id"]).collect())
    assert got == [(3, 4, 3, 4), (7, 9, 7, 8)]


def test_reverse_complement_and_clipping(spark):
    assert one(spark, cg.reverse_complement(F.lit("ACGTN"))) == "NACGT" and one(spark, cg.reverse_complement(F.lit("AQ"))) == "XT"
    clip = lambda c, low: one(spark, cg.truly_clipped(cg.parse_cigar(F.lit(c)), F.array(*(F.lit(x) for x in [2] * low + [40] * (20 - low))), 10, 2))
    assert clip("5S15=", 3) is False and clip("6S14=", 3) is True


def test_phred_fisher_and_text(spark):
    assert math.isclose(one(spark, lm.phred_of_best(F.array(F.lit(math.log(0.9)), F.lit(math.log(0.1))), 0)), 10.0)
    assert math.isclose(lm.fisher_exact(10, 0, 0, 10), 1.0825e-05, rel_tol=1e-4)
    assert one(spark, gt.genotype_text(F.array(F.lit(4), F.lit(2)))) == "0/0/0/0/1/1"
    text = lambda c, q, t: one(spark, gt.paralog_text(F.array(*(F.lit(x).cast("bigint") for x in c)), F.array(*map(F.lit, q)), F.lit(t)))
    assert text((2, 2), (30, 3), 4) == "2,?" and text((2, 0), (30, 3), 2) == "2,0"
    assert [one(spark, gt.cn_text(F.lit(k), F.lit(4), F.lit(8), F.lit(4))) for k in (4, 6, 8)] == ["<5", "6", ">7"]


def test_expressions(spark):
    df = spark.createDataFrame([("chr1", 10, 20, "+", "chr2", 5, 9, "ALENGTH=30;SS=0.97;X=abc;X=last;flag")], "chrom1 string, start1 long, end1 long, strand string, chrom2 string, start2 long, end2 long, t string").withColumn("info", parse_info(F.col("t")))

    def value(e):
        a, b = df.select(compile_expression(e).alias("v"), compile_expression(e, "t", as_text=True).alias("w")).first()
        assert a == b
        return a

    assert value("length >= 20 && seq_sim > 0.95") and value("strand == '+' || false") and value("!(length < 20)") and value("x == 'last'")
    assert value("chrom1 == 'chr1' and end1 - start1 == 10") and value("10 <= length <= 30") and value("chrom2 in ('chr2', 'chr3')") and value("max(length, 5) * 2 > 59")
    assert value("missing > 1") is None and value("length if strand == '-' else 1") is True
    for bad in ("__import__('os')", "a.b", "length >", "[1][0]", "lambda: 1", "open('x')"):
        with pytest.raises(ValueError):
            value(bad)


# ------------------------------------------------------------------ randomized and invariants
def test_overlap_joins_against_all_pairs(spark):
    rng = random.Random(1)
    a, b = random_intervals(rng, 150), random_intervals(rng, 120, widest=700)
    A = spark.createDataFrame([(i, *x) for i, x in enumerate(a)], "a_id long, chrom_id long, s long, e long")
    B = spark.createDataFrame([(i, *x) for i, x in enumerate(b)], "id long, chrom_id long, s long, e long")
    hit = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2]}
    for width in (1, 64, 10_000):
        got = [(r["a_id"], r["b_id"]) for r in iv.overlap_join(A, B, width).collect()]
        assert len(got) == len(set(got)) and set(got) == hit
    assert {r["a_id"] for r in iv.overlap_semi(A, B, ["a_id"]).collect()} == {i for i, _ in hit}
    assert {r["a_id"] for r in iv.overlap_semi(A, B, ["a_id"], anti=True).collect()} == set(range(len(a))) - {i for i, _ in hit}


def test_overlap_join_of_all_lengths(spark):
    """Lengths from 1 to ten million: all pairs, once each; an interval is in a few bins; an equi join without a cartesian product."""
    rng = random.Random(8)

    def some(n):
        rows = []
        for i in range(n):
            length = int(10 ** rng.uniform(0, 7))
            s = rng.choice([rng.randrange(20_000_000), rng.choice([128, 512, 1 << 20]) * rng.randrange(1, 15)])
            rows.append((i, rng.choice([1, 1, 2]), s, s + length))
        return rows

    a, b = some(250), some(220)
    A, B = spark.createDataFrame(a, "a_id long, chrom_id long, s long, e long"), spark.createDataFrame(b, "id long, chrom_id long, s long, e long")
    joined = iv.overlap_join(A, B)
    got = [(r["a_id"], r["b_id"]) for r in joined.collect()]
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 2000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    each = F.transform(F.array(*map(F.lit, range(iv.LEVELS))), lambda k: F.struct(k.alias("k"), F.lit(0).alias("r")))
    binned = iv._in_bins(iv.with_level(A), iv.BIN, F.filter(each, lambda p: p["k"] >= F.col("_level"))).groupBy("a_id").count()
    assert binned.agg(F.max("count")).first()[0] <= 2 * iv.LEVELS
    assert iv.overlap_join(A, B.limit(0)).count() == 0 and iv.overlap_join(A.limit(0), B).count() == 0


def test_greedy_steps_against_plain_loops():
    rng = random.Random(7)
    for _ in range(300):
        n, least = rng.randrange(0, 40), rng.randrange(1, 6)
        values = [rng.random() < 0.5 for _ in range(n)]
        want = list(values)
        while True:
            cuts = [0, *(i for i in range(1, len(want)) if want[i] != want[i - 1]), len(want)]
            short = next(((s, e) for s, e in zip(cuts, cuts[1:]) if e - s < least), None)
            if short is None or len(cuts) <= 2:
                break
            want[short[0] : short[1]] = [not want[short[0]]] * (short[1] - short[0])
        assert cn.smooth_short_runs(values, least) == want
        near, apart, places, kept = gr.Spaced(least), gr.Apart(), [], []
        for _ in range(n):
            p = rng.randrange(60)
            far = all(abs(p - q) >= least for q in places)
            assert near.take(p) == far
            places += [p] if far else []
            s = rng.randrange(60)
            e = s + rng.randrange(0, 9)
            free = all(e <= x or s >= y for x, y in kept)
            assert apart.take(s, e) == free
            kept += [(s, e)] if free else []
    many = gr.Spaced(3)
    assert sum(many.take(rng.randrange(10**6)) for _ in range(100_000)) > 60_000
    assert len(cn.smooth_short_runs([i % 3 == 0 for i in range(100_000)], 2)) == 100_000


def test_alignment_tells_all_letters_apart():
    assert al.align("aΩb", "aЖb")[0] == "1=1X1=" and al.align("日本", "日本") == ("2=", 2)


def test_sweeps_against_positions(spark):
    rng = random.Random(2)
    rows = random_intervals(rng, 80, length=900)
    df = frame(spark, rows)
    for width in (64, 1 << 16):
        depth = {}
        for r in iv.coverage(df, width=width).collect():
            for p in range(r["s"], r["e"]):
                depth[(r["chrom_id"], p)] = r["depth"]
        want = {}
        for c, s, e in rows:
            for p in range(s, e):
                want[(c, p)] = want.get((c, p), 0) + 1
        assert depth == want
        merged = iv.merge_overlapping(df, 1, width=width)
        covered = {(r["chrom_id"], p) for r in merged.collect() for p in range(r["s"], r["e"])}
        assert covered == set(want) and sum(r["n"] for r in merged.collect()) == len(rows)
        again = iv.merge_overlapping(merged.select("chrom_id", "s", "e"))
        assert sorted(map(tuple, again.select("chrom_id", "s", "e").collect())) == sorted(map(tuple, merged.select("chrom_id", "s", "e").collect()))
    contigs = spark.createDataFrame([(c, 1200) for c in range(5)], "chrom_id long, length long")
    gaps = {(r["chrom_id"], p) for r in iv.complement(df, contigs).collect() for p in range(r["s"], r["e"])}
    assert gaps == {(c, p) for c in range(5) for p in range(1200)} - set(want)


def test_run_lengths_cover_all(spark):
    rows = [(1, i, v) for i, v in enumerate([0, 0, 1, 1, 0])]
    got = sorted((r["start_ix"], r["end_ix"], r["state"]) for r in iv.run_lengths(spark.createDataFrame(rows, "k long, ix long, st long"), "k", "ix", "st").collect())
    assert got == [(0, 2, 0), (2, 4, 1), (4, 5, 0)]


def brute_alignment(a, b):
    best = -(10**9)

    def go(i, j, score, last):
        nonlocal best
        if i == len(a) and j == len(b):
            best = max(best, score)
            return
        if i < len(a) and j < len(b):
            go(i + 1, j + 1, score + (1 if a[i] == b[j] else -4), "M")
        if i < len(a):
            go(i + 1, j, score - 1 - (0 if last == "D" else 6), "D")
        if j < len(b):
            go(i, j + 1, score - 1 - (0 if last == "I" else 6), "I")

    go(0, 0, 0, "M")
    return best


def test_alignment_against_exhaustion():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ("".join(rng.choice("AC") for _ in range(rng.randint(0, 5))) for _ in range(2))
        cigar, score = al.align(a, b)
        assert score == brute_alignment(a, b) == al.score_of(cigar), (a, b, cigar)
        top, _, bottom = al.drawn(a, b, cigar)
        assert top.replace("-", "") == a and bottom.replace("-", "") == b
    cigar, score = al.align("TTTTACGTACGTTTTT", "ACGTACG", free_ends=True)
    assert cigar == "4D7=5D" and score == 7


def test_left_normalization():
    assert al.left_normalize("GCACACAT", 4, "ACA", "A") == (0, "GCA", "G")
    assert al.left_normalize("GAAAT", 3, "A", "AA") == (0, "G", "GA")


def test_reads_move_between_copies():
    copy1 = "ACGTTGCAACGTACCATGCA" * 3
    copy2 = copy1[:25] + copy1[27:]
    cigar, _ = al.align(copy1, copy2)
    start, own = al.move_read(copy2, copy1, cigar, 30, copy2[30:50])
    assert (start, own) == (32, "20=")


def plain_places(cigar):
    """(kind, reference base or the one before, read base or the one before) of each base of an alignment."""
    i = j = 0
    out = []
    for n, op in al.parse(cigar):
        for _ in range(n):
            r, q = op in "M=XDN", op in "M=XIS"
            out.append((op, i if r else None, j if q else None))
            i, j = i + r, j + q
    return out, i, j


def test_lift_follows_aligned_pairs(spark):
    cigar = "5=2I3=4D6=1X2="
    df = spark.createDataFrame([(1, cigar)], "id long, c string").withColumn("ops", cg.parse_cigar(F.col("c")))
    pairs = {r["ref_pos"]: r["read_pos"] for r in cg.aligned_pairs(df.withColumn("segs", cg.segments(F.col("ops"))), "segs", ["id"]).collect()}
    assert pairs == {r: q for _, r, q in plain_places(cigar)[0] if r is not None and q is not None}
    spans = list(itertools.combinations(range(22), 2))
    every = df.crossJoin(spark.createDataFrame(spans, "s long, e long"))
    for r in every.select("s", "e", cg.lift(F.col("ops"), F.col("s"), F.col("e")).alias("l")).collect():
        inside = [pairs[p] for p in range(r["s"], r["e"]) if p in pairs]
        assert (r["l"]["s"], r["l"]["e"]) == ((min(inside), max(inside) + 1) if inside else (None, None))


def test_regions_of_an_alignment_by_its_bases(spark):
    for cigar in ("5=2I3=4D6=1X2=", "4=3D2=1I5="):
        bases, n_ref, n_read = plain_places(cigar)
        read_at, at = {}, 0  # of each reference base: read bases before it, and whether it is aligned
        for _, r, q in bases:
            if r is not None:
                read_at[r] = (at, q is not None)
            at += q is not None
        df = spark.createDataFrame([(cigar,)], "c string").select(cg.parse_cigar(F.col("c")).alias("ops"))
        every = df.crossJoin(spark.createDataFrame(list(itertools.combinations(range(n_ref + 1), 2)), "s long, e long"))
        got = every.select("s", "e", cg.aligned_region(F.col("ops"), F.col("s"), F.col("e")).alias("a"), cg.aligned_region(F.col("ops"), F.col("s"), F.col("e"), 1).alias("l"), cg.read_region(F.col("ops"), F.col("s"), F.col("e")).alias("r")).collect()
        for r in got:
            s, e = r["s"], r["e"]
            end = read_at[e - 1][0] + read_at[e - 1][1]
            assert (r["a"]["s"], r["a"]["e"]) == (read_at[s][0], end), (cigar, s, e)
            behind = [i for i, b in enumerate(bases) if b[1] == e - 1][0] + 1
            assert r["l"]["e"] == end + (behind < len(bases) and bases[behind][0] == "I"), (cigar, s, e)
            start = read_at[s][0] + (0 if read_at[s][1] else 1)
            last = n_read if e == n_ref else read_at[e][0] + (0 if read_at[e][1] else 1)
            if e == n_ref or bases[[i for i, b in enumerate(bases) if b[1] == e][0] - 1][0] == "I" or (read_at[e][1] != read_at[e - 1][1]):
                last = end if e < n_ref else n_read  # the interval ends with an operation
            assert (r["r"]["s"], r["r"]["e"]) == (start, last), (cigar, s, e)
        assert df.select(cg.ref_region(F.col("ops"), F.lit(0), F.lit(n_read)).alias("x")).first()["x"] == (0, n_ref)


# ------------------------------------------------------------------ models
def test_loess_equals_direct_fits():
    rng = np.random.default_rng(1)
    x = np.arange(30, 50, dtype=float)
    y = 2 * x + rng.normal(size=20)
    n = np.ones(20)
    got = dp.loess(x, y, n, x, 1.0)
    for k, x0 in enumerate(x):
        w = (1 - np.minimum(np.abs(x - x0) / 19, 1) ** 3) ** 3
        assert math.isclose(got[k], np.polyval(np.polyfit(x, y, 1, w=w), x0), rel_tol=1e-6)
    assert np.allclose(dp.loess(x, 3 * x + 1, n, x, 0.3), 3 * x + 1)


def test_viterbi_and_posteriors_by_enumeration():
    rng = np.random.default_rng(2)
    e = np.log(rng.dirichlet(np.ones(3), 6))
    a = cn.transitions(3, np.full(5, 0.05), np.full(5, 0.1), 2)
    start = np.log(np.array([0.2, 0.5, 0.3]))
    paths = list(itertools.product(range(3), repeat=6))
    logs = np.array([cn.path_log_likelihood(e, a, start, np.array(p)) for p in paths])
    assert tuple(cn.viterbi(e, a, start)) == paths[int(logs.argmax())]
    gamma, xi, total = cn.forward_backward(e, a, start)
    assert math.isclose(total, lm.np_logsumexp(logs), rel_tol=1e-9) and np.allclose(np.exp(gamma).sum(axis=1), 1) and np.allclose(np.exp(xi).sum(axis=(1, 2)), 1)
    for t, k in itertools.product(range(6), range(3)):
        own = [x for x, p in zip(logs, paths) if p[t] == k]
        assert math.isclose(gamma[t, k], lm.np_logsumexp(np.array(own)) - total, abs_tol=1e-9)


def test_copy_numbers_are_recovered(spark):
    rng = np.random.default_rng(3)
    truth = np.full((20, 40), 4)
    truth[:6, 10:25], truth[6:9, 20:] = 3, 6
    p, per_copy = 0.5, 40.0
    depth = rng.negative_binomial(per_copy * p / (1 - p) * truth, p)
    rows = [(0, s, w, int(depth[s, w]), per_copy * p / (1 - p), p) for s in range(20) for w in range(40)]
    df = spark.createDataFrame(rows, "locus long, sample_id long, window_ix long, depth long, nb_n double, nb_p double")
    got = cn.copy_number_profiles(df, cn.HmmConfig(least_samples=10)).collect()
    assert np.mean([r["cn"] == truth[r["sample_id"], r["window_ix"]] for r in got]) > 0.97
    paths = cn.path_weights(spark.createDataFrame(got)).collect()
    assert math.isclose(sum(r["weight"] for r in paths), 1.0) and max(r["n"] for r in paths) >= 9


def test_paralog_numbers_are_recovered(spark):
    rng = np.random.default_rng(4)
    splits = [(2, 2)] * 14 + [(3, 1)] * 6 + [(1, 3)] * 6
    rows = []
    for v in range(6):
        f = (0.99, 0.99) if v < 4 else (0.6, 0.7)
        for s, (a, b) in enumerate(splits):
            k = rng.binomial(a, f[0]) + rng.binomial(b, 1 - f[1])
            n1 = rng.binomial(300, np.clip(k / 4, 0.01, 0.99))
            rows.append((0, v, s, int(n1), 300 - int(n1), 4))
    df = spark.createDataFrame(rows, "locus long, psv_ix long, sample_id long, n1 long, n2 long, agcn long")
    reliable = {r["psv_ix"] for r in pl.f_values(df).filter("reliable").collect()}
    assert reliable and reliable <= {0, 1, 2, 3}
    got = {r["sample_id"]: r["pscn"] for r in pl.paralog_copy_numbers(df).collect()}
    assert np.mean([got[s] == f"{a},{b}" for s, (a, b) in enumerate(splits)]) > 0.9


def test_gene_conversion_runs():
    logs = np.log(np.full((20, 3), 0.05))
    logs[:, 0] = np.log(0.9)
    logs[8:13] = np.log([0.0001, 0.9, 0.05])
    assert pl.gene_conversions(logs, 0) == [(8, 13, 1)]


def test_negative_binomial_and_tails():
    assert math.isclose(np.exp(lm.nb_logpmf(np.arange(400.0), np.full(400, 3.5), np.full(400, 0.2))).sum(), 1, abs_tol=1e-9)
    assert math.isclose(math.exp(lm.binomial_log_tail(2, 5, 0.3)), sum(math.comb(5, k) * 0.3**k * 0.7 ** (5 - k) for k in range(3)))
    assert math.isclose(lm.golden_section(lambda x: (x - 1.3) ** 2, 0, 3), 1.3, abs_tol=1e-6)


def test_copy_genotypes_and_reads():
    dealt = ca.copy_genotypes((3, 1), (2, 2))
    assert dealt == (((0, 0), (0, 1)), ((0, 1), (0, 0)))
    location = np.log(np.array([[0.99, 0.01]] * 10 + [[0.01, 0.99]] * 10))
    logs = ca.read_support(location, np.array([0] * 10 + [0, 1] * 5), list(dealt))
    assert logs.argmax() == 0 and math.isclose(np.exp(logs).sum(), 1)
    assert ca.keep_consistent(4, {(0, 1), (2, 3)}, [1.0, 0.5, 0.9, 0.8]) == [0, 2] and ca.extended_copies([2, None, None], 5) == [2, 3]


def test_dealt_genotypes_are_all_multisets():
    for counts, copies in (((3, 1), (2, 2)), ((4, 4, 4), (4, 4, 4)), ((2, 1, 1), (1, 2, 1)), ((5, 0), (2, 3)), ((6, 6), (4, 4, 2, 2))):
        dealt = ca.copy_genotypes(counts, copies)
        assert len(set(dealt)) == len(dealt) and all(tuple(map(len, g)) == copies for g in dealt)
        assert all([sum(own.count(a) for own in g) for a in range(len(counts))] == list(counts) for g in dealt)
        total = math.factorial(sum(counts)) // math.prod(map(math.factorial, counts))
        assert sum(map(ca.arrangements, dealt)) == total
    assert set(ca.copy_genotypes((2, 1, 1), (1, 2, 1))) == {tuple((tuple(sorted(p[a:b])) for a, b in ((0, 1), (1, 3), (3, 4)))) for p in itertools.permutations((0, 0, 1, 2))}
    assert ca.extended_copies([2, None], 2) == [] and ca.extended_copies([2, 2], 5) == [] and ca.extended_copies([2, 2], 4) == [2, 2]


def test_unknown_copies_are_called_as_one(spark):
    rows = [(1, 7, i, 1 if i < 10 else 0) for i in range(60)]
    obs = spark.createDataFrame([(0, v, s, r, a) for v, s, r, a in rows], "locus long, variant_id long, sample_id long, read_id long, allele_ix long")
    calls = spark.createDataFrame([(1, 7, 6, [2, None, None], "0/0/0/0/0/1")], "variant_id long, sample_id long, agcn long, pscn array<int>, gt string")
    where = spark.createDataFrame([(7, i, c, math.log(p)) for i in range(60) for c, p in enumerate((0.9, 0.05, 0.05) if i >= 40 else (0.02, 0.49, 0.49))], "sample_id long, read_id long, copy int, ln_prob double")
    got = chain.paralog_calls(obs, calls, where, 2).collect()
    assert len(got) == 1 and got[0]["paralog_gt"] == "0/0;0/0/0/1;+" and len(got[0]["copy_quals"]) == 3 and got[0]["copy_quals"][1] == got[0]["copy_quals"][2] > 10


def test_overlaps_are_resolved_by_quality(spark):
    rows = [(1, 0, 0, 10, 5), (2, 0, 5, 15, 9), (3, 0, 12, 20, 8), (4, 0, 40, 50, 1), (5, 1, 0, 10, 2)]
    got = ca.resolve_overlaps(spark.createDataFrame(rows, "variant_id long, chrom_id long, s long, e long, quality long"))
    assert sorted(r["variant_id"] for r in got.collect()) == [2, 4, 5]


def test_homology_chains_and_examine(spark):
    rows = [(1, 0, 0, 100, 1, 2, 1000, 1100, 0.99), (2, 0, 80, 180, 1, 2, 1080, 1180, 0.99), (3, 0, 10, 60, 1, 2, 1010, 1060, 0.99), (4, 0, 500, 600, 1, 2, 9000, 9100, 0.99)]
    hits = spark.createDataFrame(rows, "hit_id long, chrom_id long, s long, e long, strand long, chrom2 long, s2 long, e2 long, similarity double")
    got = sorted((r["s"], r["e"], r["s2"], r["e2"], r["n_parts"]) for r in hm.combine(hits).collect())
    assert got == [(0, 180, 1000, 1180, 2), (500, 600, 9000, 9100, 1)]
    regions = hm.examine(hits.withColumn("is_tangled", F.col("hit_id") == 2), "hit_id").collect()
    assert {(r["s"], r["e"], r["filter"], r["ref_cn"]) for r in regions} >= {(0, 10, "PASS", 4), (10, 60, "PASS", 6), (80, 100, "TANGLED", 6)}
    lines = {r["row_ix"]: r["line"] for r in hm.multiple_alignment(spark.createDataFrame([(0, 0, 0, "A"), (0, 0, 1, "CGG"), (0, 1, 0, "A"), (0, 1, 1, "C")], "locus long, row_ix long, pos long, text string")).collect()}
    assert lines == {0: "ACGG", 1: "AC--", -1: "*   "}


def test_alignments_are_stitched():
    rng = random.Random(6)
    a = "".join(rng.choice("ACGT") for _ in range(120))
    b = a[:50] + "GG" + a[50:80] + a[83:]
    one_, two = al.align(a[:60], b[:62])[0], al.align(a[40:], b[40:])[0]
    far = al.align(a[70:], b[72:])[0]
    for segments in ([(0, 0, one_), (40, 40, two)], [(0, 0, one_), (70, 72, far)], [(0, 0, one_), (5, 5, "10=")]):
        r, q, cigar = al.stitch(a, b, segments)
        top, _, bottom = al.drawn(a[r:], b[q:], cigar)
        assert (r, q) == (0, 0) and a.startswith(top.replace("-", "")) and b.startswith(bottom.replace("-", ""))
        assert len(segments) == 2 and (segments[1][0] == 5 or (top.replace("-", ""), bottom.replace("-", "")) == (a, b))


def test_copy_numbers_of_variants_and_unique_regions(spark):
    v = spark.createDataFrame([(1, 0, 5, 6), (2, 0, 9, 11), (3, 0, 50, 51)], "variant_id long, chrom_id long, s long, e long")
    p = spark.createDataFrame([(7, 0, 0, 10, 2), (7, 0, 10, 20, 3)], "sample_id long, chrom_id long, s long, e long, cn long")
    assert {r["variant_id"]: (r["cn"], r["conflict"]) for r in ca.copy_numbers_of_variants(v, p).collect()} == {1: (2, False), 2: (None, True)}
    contigs = spark.createDataFrame([(0, 30)], "chrom_id long, length long")
    assert [(r["s"], r["e"]) for r in iv.unique_regions(p, contigs).collect()] == [(20, 30)]


# ------------------------------------------------------------------ calling, sample by sample
def simulated_reads(rng, n_samples=4):
    """Two copies of two chromosomes each, six PSVs (copy 1 has allele 0, copy 2 allele 1) and two variants: 100 is on one
    chromosome of copy 2 in odd samples, 101 on both of copy 1 in sample 0. A read covers four neighbouring places."""
    places = [0, 1, 100, 2, 3, 101, 4, 5]
    rows, read = [], 0
    for sample in range(n_samples):
        for copy in (0, 1):
            for chromosome in (0, 1):
                for _ in range(40):
                    read += 1
                    at = rng.randrange(len(places) - 3)
                    for v in places[at : at + 4]:
                        allele = copy if v < 100 else int((v == 100 and copy == 1 and chromosome == 0 and sample % 2 == 1) or (v == 101 and copy == 0 and sample == 0))
                        if rng.random() < 0.005:
                            allele = 1 - allele
                        rows.append((v, sample, read, allele))
    return rows


def test_calling_chain_on_simulated_samples(spark):
    rng = random.Random(17)
    obs = spark.createDataFrame(simulated_reads(rng), "variant_id long, sample_id long, read_id long, allele_ix int")
    numbers = [(v, s, 4, [2, 2]) for v in (0, 1, 2, 3, 4, 5, 100, 101) for s in range(4)]
    cns = spark.createDataFrame(numbers, "variant_id long, sample_id long, agcn int, pscn array<int>")
    psvs = spark.createDataFrame([(v, 1, v, [0, 1], [0.99, 0.99]) for v in range(6)], "variant_id long, locus long, rank int, copy_alleles array<int>, f_values array<double>")
    out = chain.call_samples(obs, cns, psvs, 2)
    got = {(r["variant_id"], r["sample_id"]): r for r in out["variants"].collect()}
    assert all(got[v, s]["paralog_gt"] == "0/0;1/1" for v in range(6) for s in range(4))
    assert all(got[v, s]["gt"] == "0/0/1/1" for v in range(1, 5) for s in range(4))
    for s in range(4):
        assert got[100, s]["paralog_gt"] == ("0/0;0/1" if s % 2 else "0/0;0/0"), s
        assert got[101, s]["paralog_gt"] == ("1/1;0/0" if s == 0 else "0/0;0/0"), s
    assert all(r["filter"] == "PASS" and r["paralog_gq"] > 10 and len(r["copy_quals"]) == 2 for r in got.values())
    assert {r["reason"] for r in out["psv_use"].collect()} == {"ok"}


def test_a_psv_against_the_others_is_left_out(spark):
    """The alleles of PSV 2 are put the wrong way round: reads contradict it, and it places none."""
    rng = random.Random(18)
    rows = [(v, s, r, 1 - a if v == 2 else a) for v, s, r, a in simulated_reads(rng)]
    obs = spark.createDataFrame(rows, "variant_id long, sample_id long, read_id long, allele_ix int")
    cns = spark.createDataFrame([(v, s, 4, [2, 2]) for v in (0, 1, 2, 3, 4, 5, 100, 101) for s in range(4)], "variant_id long, sample_id long, agcn int, pscn array<int>")
    psvs = spark.createDataFrame([(v, 1, v, [0, 1], [0.99, 0.99 if v != 2 else 0.9]) for v in range(6)], "variant_id long, locus long, rank int, copy_alleles array<int>, f_values array<double>")
    out = chain.call_samples(obs, cns, psvs, 2)
    use = {(r["variant_id"], r["sample_id"]): r["reason"] for r in out["psv_use"].collect()}
    assert all(use[v, s] == ("conflict" if v == 2 else "ok") for v, s in use)
    assert all(r["paralog_gt"] == ("0/0;0/1" if r["sample_id"] % 2 else "0/0;0/0") for r in out["variants"].filter("variant_id = 100").collect())


def test_calls_without_known_copies(spark):
    obs = spark.createDataFrame([(1, 1, r, r % 2) for r in range(20)] + [(1, 2, r, 0) for r in range(30, 40)], "variant_id long, sample_id long, read_id long, allele_ix int")
    cns = spark.createDataFrame([(1, 1, 4, [2, None]), (1, 2, None, None)], "variant_id long, sample_id long, agcn int, pscn array<int>")
    psvs = spark.createDataFrame([], "variant_id long, locus long, rank int, copy_alleles array<int>, f_values array<double>")
    got = {r["sample_id"]: r for r in chain.call_samples(obs, cns, psvs, 2)["variants"].collect()}
    assert got[1]["gt"] == "0/0/1/1" and got[1]["filter"] == "UnknownPsCN"
    assert got[1]["paralog_gt"] in ("0/0;1/1", "0/1;0/1", "1/1;0/0") and got[1]["paralog_gq"] < 10  # nothing says which copy has what
    assert got[2]["gt"] is None and got[2]["filter"] == "UnknownAgCN"


def test_continued_copies_and_matched_alleles(spark):
    rng = random.Random(3)
    span = "array<struct<chrom_id:bigint,s:bigint,e:bigint,forward:boolean>>"
    rows = []
    for i in range(300):
        draw = lambda: [(rng.randrange(2), (s := rng.randrange(60)), s + rng.randint(1, 20), rng.random() < 0.7) for _ in range(rng.randint(0, 3))]
        rows.append((i, draw(), draw()))
    df = spark.createDataFrame(rows, f"i long, a {span}, b {span}")
    got = {r["i"]: r["x"] for r in df.select("i", vr.continued_copies(F.col("a"), F.col("b"), 15).alias("x")).collect()}
    for i, a, b in rows:
        used, out = set(), []
        for x in a:
            for k, y in enumerate(b):
                if k in used or y[0] != x[0] or y[3] != x[3]:
                    continue
                p, q = (x, y) if x[3] else (y, x)
                if p[1] <= q[1] and p[2] <= q[2] and q[1] - p[2] < 15:
                    used.add(k)
                    out.append((x[0], p[1], q[2], x[3]))
                    break
            else:
                out = None
                break
        assert (got[i] if got[i] is None else [tuple(t) for t in got[i]]) == out, (a, b)


def test_psvs_and_prior_tables(spark):
    t = {(r["total"], tuple(r["cns"])): r["prior"] for r in pl.split_table(spark, range(1, 6), 2).collect()}
    assert math.isclose(sum(math.exp(p) for (n, _), p in t.items() if n == 4), 1) and max((p, c) for (n, c), p in t.items() if n == 4)[1] == (2, 2)
    d = pl.with_allele_distribution(spark.createDataFrame([([2, 2], [1.0, 1.0])], "k array<int>, f array<double>"), "k", "f", "p").first()["p"]
    assert np.allclose(d, [0, 0, 1, 0, 0])


def test_combined_rows_are_stitched_alignments(spark):
    """Windows of one long alignment, forward and reverse, come together as that alignment."""
    rng = random.Random(6)
    for forward in (1, 0):
        ops = [(rng.randint(8, 30), "=") if k % 2 == 0 else (rng.randint(1, 3), rng.choice("XDI")) for k in range(31)]
        n1, n2 = sum(n for n, op in ops if op in "=XD"), sum(n for n, op in ops if op in "=XI")
        pairs = {}  # reference -> place along copy 2
        i = j = 0
        for n, op in ops:
            for _ in range(n):
                if op in "=X":
                    pairs[i] = j
                i, j = i + (op in "=XD"), j + (op in "=XI")
        rows = []
        for k, start in enumerate(range(0, n1 - 60, 40)):
            s, e = min(p for p in pairs if p >= start), max(p for p in pairs if p < start + 100) + 1
            part = al.cut(ops, s, e)
            while part[0][1] == "I":
                part = part[1:]
            a, b = pairs[s], pairs[e - 1] + 1
            s2, e2 = (1000 + a, 1000 + b) if forward else (1000 + n2 - b, 1000 + n2 - a)
            rows.append((k, 1, 500 + s, 500 + e, forward, 2, s2, e2, al.text(part)))
        df = spark.createDataFrame(rows, "hit_id long, chrom_id long, s long, e long, strand long, chrom2 long, s2 long, e2 long, cigar string")
        got = hm.combine(df, cigar="cigar").collect()
        assert len(got) == 1 and got[0]["n_parts"] == len(rows)
        r = got[0]
        assert (r["s"], r["e"], r["s2"], r["e2"]) == (500, max(x[3] for x in rows), min(x[6] for x in rows), max(x[7] for x in rows))
        assert r["cigar"] == al.text(al.cut(ops, 0, r["e"] - 500))


def test_sweeps_do_not_depend_on_the_bins(spark):
    """Islands, sessions, runs and gaps with bins of a few places, against loops."""
    rng = random.Random(12)
    rows = random_intervals(rng, 300, contigs=2, length=4000, widest=30)
    df = frame(spark, rows)
    for gap in (1, 8):
        want = []
        for c in (0, 1):
            end, out = None, []
            for _, s, e in sorted(r for r in rows if r[0] == c):
                if end is not None and s <= end + gap - 1:
                    out[-1] = (c, out[-1][1], max(out[-1][2], e), out[-1][3] + 1)
                else:
                    out.append((c, s, e, 1))
                end = out[-1][2]
            want += out
        for width in (16, 1 << 16):
            assert sorted(map(tuple, iv.merge_overlapping(df, gap, width=width).collect())) == sorted(want)
    for width in (16, 1 << 16):
        sessions = {(r["chrom_id"], r["s"], r["e"], r["n"]) for r in iv.gap_sessions(df, 12, ["chrom_id"], "s", width).collect()}
        want = set()
        for c in (0, 1):
            places = sorted(s for x, s, _ in rows if x == c)
            cuts = [0, *(i for i in range(1, len(places)) if places[i] - places[i - 1] > 12), len(places)]
            want |= {(c, places[a], places[b - 1] + 1, b - a) for a, b in zip(cuts, cuts[1:])}
        assert sessions == want
    states = [(k, i, rng.choice(["a", "b", None])) for k in (0, 1) for i in range(200) if i % 7 != 3]
    df = spark.createDataFrame(states, "key long, ix long, state string")
    want = set()
    for k in (0, 1):
        for state, group in itertools.groupby((r for r in states if r[0] == k), key=lambda r: r[2]):
            own = [r[1] for r in group]
            want.add((k, own[0], own[-1] + 1, state))
    for width in (8, 1 << 16):
        assert set(map(tuple, iv.run_lengths(df, "key", "ix", "state", width).collect())) == want


# ------------------------------------------------------------------ hits without an external aligner
def test_minimizers_of_both_strands_and_of_shifted_texts():
    rng = random.Random(40)
    seq = "".join(rng.choice("ACGT") for _ in range(500))
    h, pos, forward = sa.minimizers(seq)
    back = seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    h2, pos2, forward2 = sa.minimizers(back)
    one = {(x, p, f) for x, p, f in zip(h.tolist(), pos.tolist(), forward.tolist())}
    assert one == {(x, len(seq) - sa.K - p, not f) for x, p, f in zip(h2.tolist(), pos2.tolist(), forward2.tolist())}
    inner = {x for x, p, _ in one if 130 <= p < 400 - sa.K}
    assert inner <= set(sa.minimizers(seq[100:430])[0].tolist()) and len(inner) > 30
    assert not len(sa.minimizers("ACGTN" * 40)[0]) and not len(sa.minimizers("ACG")[0])


def test_hits_are_where_copies_lie(spark):
    """A sequence with a copy of 1,000 letters, changed in 2 %, forward in one contig and reversed in another."""
    rng = random.Random(41)
    draw = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    core = draw(1000)
    changed = "".join(rng.choice("ACGT") if rng.random() < 0.02 else c for c in core)
    turned = changed.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    contigs = [(0, draw(700) + core + draw(300)), (1, draw(70_000) + changed + draw(500)), (2, draw(200) + turned + draw(400))]
    sequences = spark.createDataFrame(contigs, "seq_id long, seq string")
    reads = spark.createDataFrame([(k, core[k * 100 : k * 100 + 300]) for k in range(8)] + [(99, draw(300))], "seq_id long, seq string")
    got = {(r["read_id"], r["seq_id"], r["forward"]): r for r in sa.hits(reads, sequences).collect()}
    assert set(got) == {(k, c, c != 2) for k in range(8) for c in (0, 1, 2)}
    for (k, c, _), r in got.items():
        start = {0: 700 + k * 100, 1: 70_000 + k * 100, 2: 200 + 1000 - k * 100 - 300}[c]
        assert abs(r["s"] - start) <= 3 and abs(r["e"] - start - 300) <= 3
        if c == 0:
            assert (r["s"], r["cigar"], r["similarity"]) == (start, "300=", 1.0)


def test_homopolymer_places(spark):
    rng = random.Random(60)
    texts = ["", "A", "AAA", "CAAAAAAG", "éééa", *("".join(rng.choice("ACé") for _ in range(60)) for _ in range(20))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for n in (2, 3, 5):
        got = {r["i"]: r["p"] for r in df.select("i", cg.homopolymer_places(F.col("t"), n).alias("p")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == [p for p in range(len(t)) if len(t[p + 1 : p + 1 + n]) == n and len(set(t[p + 1 : p + 1 + n])) == 1], (t, n)


def test_combined_table_does_not_depend_on_the_order_of_rows(spark, tmp_path):
    """Lines repeat an id with other values; whichever comes first, the same one counts in every part of the plan."""
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    found = []
    for name, order in (("up", "l_partkey"), ("down", F.desc("l_partkey"))):
        lines.coalesce(1).sortWithinPartitions(order, "l_suppkey").write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        found.append(sorted(map(tuple, catalog.QUERIES["m01_combined_table"](spark, f"{tmp_path}/{name}").drop("component").collect())))
    assert len(found[0]) > 100 and found[0] == found[1]


def test_contained_rows_against_all_pairs(spark):
    rng = random.Random(8)
    rows = [(k, rng.randint(0, 1), rng.randint(0, 1), s, s + rng.randint(1, 30)) for k in range(300) for s in [rng.randint(0, 200) + rng.choice((0, 1 << 17))]]
    holds = lambda y, x: y[1:3] == x[1:3] and y[3] <= x[3] and y[4] >= x[4] and (y[4] - y[3] > x[4] - x[3] or y[0] < x[0])
    want = sorted(x[0] for x in rows if not any(holds(y, x) for y in rows))
    df = spark.createDataFrame([*rows, (999, None, 1, 5, 6)], "hit_id long, chrom_id long, strand long, s long, e long")
    out = rel.drop_contained(df, "hit_id")
    assert sorted(r["hit_id"] for r in out.collect()) == [*want, 999]


def test_support_of_deep_counts():
    """Where each copy surely has its own allele, only one number of alleles is possible, however unlikely the counts are."""
    tuples = pl.copy_tuples(4, 2)
    got = pl.psv_support(np.array([40.0, 9000.0]), np.array([1000.0, 12.0]), tuples, np.ones(2))
    for n1, n2, logs in zip((40, 9000), (1000, 12), got):
        share = [min(max(t[0] / 4, 0.01), 0.99) for t in tuples]
        assert np.allclose(logs, [n1 * math.log(q) + n2 * math.log(1 - q) for q in share], rtol=1e-12)

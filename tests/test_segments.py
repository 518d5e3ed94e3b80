"""Segment posteriors against all paths, refined and forced totals, linked segments against all splits."""

import itertools
import math

import numpy as np
import pytest
from twinspan.operators import copynumber as cn
from twinspan.operators import paralog as pl
from twinspan.operators import segments as sg


def test_segment_posteriors_equal_all_paths():
    rng = np.random.default_rng(4)
    t, n = 6, 4
    e = np.log(rng.dirichlet(np.ones(n), t))
    a = np.log(rng.dirichlet(np.ones(n) * 2, (t - 1, n)))
    start = np.log(rng.dirichlet(np.ones(n)))
    segments = [(0, 2, 1), (2, 5, 3), (5, 6, 0), (0, 6, 2)]
    for (i, j, own), found in zip(segments, cn.segment_posteriors(e, a, start, segments, reach=2)):
        total = {}
        for path in itertools.product(range(n), repeat=t):
            if len(set(path[i:j])) == 1:
                total[path[i]] = total.get(path[i], 0) + math.exp(cn.path_log_likelihood(e, a, start, np.array(path)))
        states = [c for c in range(n) if abs(c - own) <= 2]
        norm = sum(total[c] for c in states)
        assert found[0][0] == own and {c for c, _ in found} == set(states)
        for c, lp in found:
            assert math.isclose(math.exp(lp), total[c] / norm, rel_tol=1e-9)


def psv(ix, pos, n1, n2, f=(0.999, 0.999), info=1.0, reliable=True, semi=True):
    return sg.Psv(ix, pos, n1, n2, np.array(f), info, reliable, semi)


def by_hand(psvs, cn_, copies):
    """Every split in turn: the product over variants of the mixture over numbers of alleles."""
    logs = {}
    for split in itertools.product(range(cn_ + 1), repeat=copies):
        if sum(split) != cn_:
            continue
        logs[split] = 0.0
        for p in psvs:
            mix = pl.allele_distribution(split, p.f)
            share = [min(max(k / cn_, 0.01), 0.99) for k in range(cn_ + 1)]
            logs[split] += math.log(sum(m * math.exp(p.n1 * math.log(x) + p.n2 * math.log(1 - x)) for m, x in zip(mix, share)))
    top = max(logs.values())
    norm = top + math.log(sum(math.exp(x - top) for x in logs.values()))
    return {k: math.exp(x - norm) for k, x in logs.items()}


@pytest.mark.parametrize("copies", [2, 3])
def test_linked_segments_share_one_split(copies):
    f = (0.97,) * copies
    psvs = [psv(0, 10, 12, 14, f), psv(1, 30, 9, 20, f), psv(2, 130, 15, 11, f), psv(3, 250, 30, 2, f)]
    segments = [sg.Segment(0, 100, 4, 50.0, [(4, 0.0)]), sg.Segment(100, 200, 4, 30.0, [(4, 0.0)]), sg.Segment(200, 300, 3, 40.0, [(3, 0.0)])]
    rows = sg.resolve(segments, psvs, sg.SegmentConfig(copies=copies))
    assert [(r[1], r[2], r[3], r[5]) for r in rows] == [(0, 200, 4, 2), (200, 300, 3, 1)] and rows[0][4] == 30.0
    for row, own in ((rows[0], psvs[:3]), (rows[1], psvs[3:])):
        all_ = by_hand(own, row[3], copies)
        for c in range(copies):
            for k in range(row[3] + 1):
                want = sum(p for split, p in all_.items() if split[c] == k)
                assert math.isclose(math.exp(row[11][c][k]), want, rel_tol=1e-6, abs_tol=1e-12)
    assert "FewReliable" in rows[1][12] and "NoComplReliable" in rows[0][12]


def test_refined_totals():
    """Depths can't tell 4 from 5, allele counts of 2:1 say that there are three or six copies."""
    psvs = [psv(i, 20 + 600 * i, 200, 100) for i in range(4)]
    segment = sg.Segment(0, 5000, 4, 3.0, [(4, math.log(0.5)), (3, math.log(0.3)), (5, math.log(0.2))])
    got = sg.refine(segment, psvs, sg.SegmentConfig())
    assert got.cn == 3 and got.refined == 4 and got.qual > 40 and math.isclose(sum(math.exp(p) for _, p in got.probable), 1)
    assert sg.refine(segment, [psv(0, 20, 200, 100, reliable=False)], sg.SegmentConfig()).cn == 4
    near = [psv(i, 20 + i, 200, 100) for i in range(4)]
    assert np.allclose(sg.neighbour_weights(near, 500), 0.25) and np.allclose(sg.neighbour_weights(psvs, 500), 1)
    rows = sg.resolve([segment], psvs, sg.SegmentConfig())
    assert rows[0][3] == 3 and rows[0][6] == 1 and rows[0][9] == "2,1"


def test_forced_totals():
    segments = [sg.Segment(0, 100, 4, 50.0, [(4, 0.0)]), sg.Segment(100, 300, 5, 20.0, [(5, 0.0)])]
    got = sg.with_forced(segments, [(50, 150, 3), (140, 160, 2)])
    assert [(g.s, g.e, g.cn, g.forced) for g in got] == [(0, 50, 4, False), (50, 150, 3, True), (150, 160, 2, True), (160, 300, 5, False)]
    assert sg.with_forced(segments, [(500, 600, 1)]) == segments


def test_tags_and_conversions():
    one = lambda cn_, psvs, **kw: sg.resolve([sg.Segment(0, 100, cn_, 9.0, [(cn_, 0.0)])], psvs, sg.SegmentConfig(**kw))[0]
    assert one(8, [psv(0, 5, 1, 1)])[12] == "UncertainCN" and one(4, [])[12] == "NoGoodPSVs" and one(4, [psv(0, 5, 1, 1, reliable=False)])[12] == "NoReliable"
    assert one(0, [])[12] == "PASS" and one(4, [psv(i, i, 20, 20) for i in range(3)])[12] == "PASS" and one(4, [], copies=5)[12] == "HighCN;NoGoodPSVs"
    assert one(4, [psv(i, i, 20, 20, info=0.5) for i in range(3)])[12] == "LowInfoContent"
    row = one(4, [psv(i, i, 40, 0) if 10 <= i < 15 else psv(i, i, 40, 40) for i in range(30)])
    assert row[9] == "2,2" and row[13] == "10-15:4,0:5"


def test_segments_of_samples(spark):
    """From depths to splits by sample: a drop in depth is a segment of its own, a number by hand reaches the result."""
    rng = np.random.default_rng(2)
    rows = []
    for sample in range(12):
        for w in range(60):
            copies = 2 if sample < 3 and 20 <= w < 40 else 4
            rows.append((1, sample, w, int(rng.negative_binomial(10 * copies, 0.5)), 10.0, 0.5, w // 30, w * 100, w * 100 + 100))
    depths = spark.createDataFrame(rows, "locus long, sample_id long, window_ix long, depth long, nb_n double, nb_p double, region_ix long, ws long, we long")
    found = cn.segment_copy_numbers(depths, cn.HmmConfig(least_samples=10, transition=1e-4))
    by = {}
    for r in found.orderBy("sample_id", "segment").collect():
        by.setdefault(r["sample_id"], []).append(r)
        assert math.isclose(sum(math.exp(p["ln_p"]) for p in r["probable"]), 1, rel_tol=1e-6) and r["probable"][0]["cn"] == r["cn"]
    assert [(r["s"], r["e"], r["cn"]) for r in by[5]] == [(0, 3000, 4), (3000, 6000, 4)]
    assert {2, 4} <= {r["cn"] for r in by[0]} and any(abs(r["s"] - 2000) <= 200 for r in by[0])
    psvs = spark.createDataFrame([(1, s, i, 150 + 700 * i, 30.0, 30.0, [0.995, 0.995], 1.0, True, True) for s in range(12) for i in range(8) if s != 7],
                                 "locus long, sample_id long, psv_ix long, pos long, n1 double, n2 double, f array<double>, info double, reliable boolean, semi boolean")
    forced = spark.createDataFrame([(1, 4, 1000, 2000, 6), (1, None, 5900, 6000, 2)], "locus long, sample_id long, s long, e long, cn long")
    out = {}
    for r in sg.paralog_segments(found, psvs, forced).orderBy("sample_id", "link").collect():
        out.setdefault(r["sample_id"], []).append(r)
    assert [(r["s"], r["e"], r["cn"], r["n_segments"]) for r in out[5]] == [(0, 5900, 4, 2), (5900, 6000, 2, 1)] and out[5][0]["pscn"] == "2,2" and out[5][0]["filter"] == "PASS"
    assert [(r["s"], r["e"], r["cn"]) for r in out[4]] == [(0, 1000, 4), (1000, 2000, 6), (2000, 5900, 4), (5900, 6000, 2)]
    assert {r["filter"] for r in out[7]} == {"NoGoodPSVs"} and len(out) == 12
    assert sg.paralog_segments(found.limit(0), psvs.limit(0)).count() == 0


def test_profile_and_matrix(spark):
    rows = [(1, 0, 5, 0, 100, 2, 30), (2, 0, 5, 50, 150, 3, 90), (3, 0, 5, 150, 200, 3, 10), (4, 0, 5, 300, 300, 1, 1), (5, 1, 5, 60, 80, None, 5), (6, 0, 6, 0, 10, 2, 30)]
    df = spark.createDataFrame(rows, "entry_id long, sample_id long, chrom_id long, s long, e long, cn long, qual long")
    got = sorted((tuple(r) for r in sg.copy_profile(df).collect()), key=str)
    assert got == sorted([(0, 5, 0, 50, 2, 30), (0, 5, 50, 200, 3, 10), (1, 5, 60, 80, None, 5), (0, 6, 0, 10, 2, 30)], key=str)
    cells = {(r["chrom_id"], r["s"]): r["values"] for r in sg.copy_matrix(df, [0, 1]).collect()}
    assert cells == {(5, 0): ["2", "."], (5, 50): ["!", "."], (5, 60): ["!", "?"], (5, 80): ["!", "."], (5, 100): ["3", "."], (5, 150): ["3", "."], (6, 0): ["2", "."]}


# ------------------------------------------------------------------ jumps
def test_jumps_are_gathered_at_peaks():
    rng = np.random.default_rng(8)
    for n in (1, 5, 40, 200):
        for _ in range(20):
            mass = rng.random(n) ** 6
            got = cn.gathered_jumps(mass, 1e-3, int(rng.integers(2, 12)))
            assert math.isclose(got.sum(), mass.sum()) and (got >= 0).all() and np.count_nonzero(got) <= np.count_nonzero(mass)
    blurred = np.zeros(60)
    blurred[18:23], blurred[40:43] = (0.01, 0.03, 0.05, 0.02, 0.01), (0.2, 0.3, 0.1)
    got = cn.gathered_jumps(blurred, 1e-3)
    assert np.flatnonzero(got).tolist() == [20, 41] and np.allclose(got[[20, 41]], [0.12, 0.6])
    assert cn.peaks_of(np.array([0, 2, 2, 2, 1, 3, 0.0]), 1, 2) == [2, 5] and cn.peaks_of(np.array([0, 2, 2, 2, 1, 3, 0.0]), 1, 4) == [5]


def test_shared_breakpoints_are_recovered():
    """A third of the samples lose a copy at window 30 and have it back at 55: transitions peak there within one window."""
    rng = np.random.default_rng(12)
    copies = np.full((60, 80), 4)
    copies[:20, 30:55] = 3
    depth = rng.negative_binomial(8 * copies, 0.4)
    m = cn.fit_group(depth, np.full(depth.shape, 8.0), np.full(depth.shape, 0.4), cn.HmmConfig(least_samples=10, iterations=15))
    assert abs(int(m["down"].argmax()) - 29) <= 1 and abs(int(m["up"].argmax()) - 54) <= 1
    assert np.count_nonzero(m["down"] > 1e-3) <= 3 and (m["paths"] == copies).mean() > 0.97


# ------------------------------------------------------------------ f-values
def mixture(rng, f, samples=40, copies=2):
    totals = rng.choice([3, 4, 5], samples)
    tuples = {t: pl.copy_tuples(int(t), copies) for t in np.unique(totals)}
    groups = {t: np.flatnonzero(totals == t) for t in tuples}
    posterior = {t: rng.dirichlet(np.ones(len(tuples[t])) * 0.3, len(own)) for t, own in groups.items()}
    counts = np.zeros((samples, 2))
    for t, own in groups.items():
        for k, i in enumerate(own):
            mix = pl.allele_distribution(tuples[t][int(posterior[t][k].argmax())], np.array(f))
            share = rng.choice(t + 1, p=mix / mix.sum()) / t
            counts[i, 0] = rng.binomial(30, min(max(share, 0.01), 0.99))
            counts[i, 1] = 30 - counts[i, 0]
    return pl.Mixture(counts, groups, tuples, posterior)


@pytest.mark.parametrize("f", [(0.97, 0.9), (0.5, 0.5), (0.99, 0.2), (0.3, 0.95)])
def test_f_values_are_at_least_as_likely_as_a_fine_grid(f):
    rng = np.random.default_rng(int(f[0] * 100))
    target = mixture(rng, f)
    for x in (np.array([0.4, 0.7]), np.array([0.9, 0.2])):
        slope = target(x)[1]
        for c in range(2):
            step = np.eye(2)[c] * 1e-6
            assert math.isclose(slope[c], (target(x + step)[0] - target(x - step)[0]) / 2e-6, rel_tol=1e-4, abs_tol=1e-3)
    _, value = pl.best_f_values(target, np.full(2, 0.98))
    grid = np.linspace(pl.LOW_F, pl.HIGH_F, 60)
    assert value >= max(target(np.array([a, b]))[0] for a in grid for b in grid) - 1e-6


def test_three_copies_and_bounds():
    target = mixture(np.random.default_rng(5), (0.98, 0.9, 0.95), 30, 3)
    x, value = pl.best_f_values(target, np.full(3, 0.98))
    grid = np.linspace(pl.LOW_F, pl.HIGH_F, 9)
    assert value >= max(target(np.array(p))[0] for p in itertools.product(grid, repeat=3)) - 1e-6 and (x >= pl.LOW_F).all() and (x <= pl.HIGH_F).all()
    x, _ = pl.climb(lambda x: (float(x.sum()), np.ones(2)), np.array([0.5, 0.5]))
    assert np.allclose(x, pl.HIGH_F)


def test_correlations_of_what_both_rows_have():
    rng = np.random.default_rng(1)
    share = rng.random((6, 30))
    share[rng.random((6, 30)) < 0.3] = np.nan
    share[5, 4:] = np.nan
    got = pl.masked_correlation(share)
    for i in range(6):
        for j in range(6):
            both = ~np.isnan(share[i]) & ~np.isnan(share[j])
            if i == j or both.sum() < 5:
                assert got[i, j] == 1 if i == j else np.isnan(got[i, j])
            else:
                assert math.isclose(got[i, j], np.corrcoef(share[i, both], share[j, both])[0, 1], abs_tol=1e-9)


def test_a_masked_variant_does_not_move_the_clusters():
    rng = np.random.default_rng(3)
    base = rng.random((2, 40))
    share = np.array([base[k // 7] + rng.normal(0, 0.05, 40) for k in range(14)]).clip(0.02, 0.98)
    counts = np.stack([np.round(share * 50), 50 - np.round(share * 50)], axis=2)
    halves = {tuple(np.flatnonzero(m)) for m in pl.variant_clusters(counts)}
    assert halves == {tuple(range(7)), tuple(range(7, 14))}
    masked = counts.copy()
    masked[13, 3:] = 0
    again = [set(np.flatnonzero(m).tolist()) - {13} for m in pl.variant_clusters(masked)]
    assert {tuple(sorted(x)) for x in again} == {tuple(range(7)), tuple(range(7, 13))}
    assert pl.variant_clusters(counts[:9]) == []
    labels = pl.cluster_two(np.array([[0, 1, 9, 9], [1, 0, 8, 9], [9, 8, 0, 2], [9, 9, 2, 0]], float))
    assert labels.tolist() == [0, 0, 1, 1]

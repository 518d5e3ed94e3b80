"""What covers each place, against each place by itself, and deep stacks, whose pairs would be too many."""

import random
from collections import defaultdict

import pyarrow as pa

from twinspan.operators import calling as ca
from twinspan.operators import cigars as cg
from twinspan.operators import covers as cv
from twinspan.operators import homology as hm
from twinspan.operators import intervals as iv
from twinspan.operators import segments as sg

N = 3000


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _stack(spark):
    """Intervals inside of each other: N * N pairs of a segment and what covers it."""
    return spark.range(N).selectExpr("id AS entry_id", "id % 2 AS sample_id", "7L AS chrom_id", "id AS s", f"{2 * N}L - id AS e", "id % 3 AS cn", "id % 1000 AS qual")


def _random(seed: int, n: int = 300) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = r.choice([r.randrange(-40, 400), 16 * r.randrange(0, 20)])
        rows.append((i, r.randrange(3), r.choice([1, 1, 2]), s, s + r.choice([0, 1, 2, 5, 16, 32, 200]), r.choice([None, 1, 2, 3]), r.choice([None, 5, 9])))
    return rows


SCHEMA = "entry_id long, sample_id long, chrom_id long, s long, e long, cn long, qual long"


def _segments(rows: list[tuple]):
    for chrom in (1, 2):
        own = [r for r in rows if r[2] == chrom]
        ends = sorted({x for r in own for x in r[3:5]})
        for s, e in zip(ends, ends[1:]):
            if here := [r for r in own if r[3] <= s and e <= r[4]]:
                yield chrom, s, e, here


def test_profile_of_a_deep_stack(spark):
    """a stretch and what covers it are never rows of their own."""
    best = sg.copy_profile(_stack(spark))
    assert "Generate explode(covering" not in _plan(best)
    got = {(r["sample_id"], p): r["cn"] for r in best.collect() for p in range(r["s"], r["e"]) if p < 1300}
    want = {(k, p): max(((i % 1000, -i, i % 3) for i in range(k, p + 1, 2)))[2] for k in (0, 1) for p in range(k, 1300, 97)}
    assert all(got[x] == v for x, v in want.items())


def test_matrix_of_a_deep_stack(spark):
    """a row for each stretch, whatever covers it."""
    made = sg.copy_matrix(_stack(spark), [0, 1])
    assert "Generate explode(covering" not in _plan(made)
    rows = {r["s"]: r["values"] for r in made.collect()}
    assert len(rows) == 2 * N - 1 and rows[0] == ["0", "."] and rows[1] == ["0", "1"] and rows[2] == ["!", "1"] and rows[N + 1] == ["!", "!"] and rows[2 * N - 1] == ["0", "."]


def test_segments_by_each_place(spark):
    for seed, width in ((1, 16), (2, 7), (3, None)):
        rows = _random(seed)
        df = spark.createDataFrame(rows, SCHEMA)
        got = sorted(tuple(r) for r in iv.disjoint_regions(df, "entry_id", width=width).collect())
        assert got == sorted((c, s, e, sorted(r[0] for r in here)) for c, s, e, here in _segments(rows))
        rows = [r for r in rows if r[3] < r[4]]
        df = spark.createDataFrame(rows, SCHEMA)
        text = lambda own: "." if not own else own.pop() if len(own) == 1 else "!"
        cells = {tuple(r)[:3]: r["values"] for r in cv.matrix(df.selectExpr("*", "coalesce(string(cn), '?') AS v"), ["chrom_id"], "sample_id", [0, 1, 2], "v", "!", ".", width).collect()}
        assert cells == {(c, s, e): [text({"?" if r[5] is None else str(r[5]) for r in here if r[1] == k}) for k in range(3)] for c, s, e, here in _segments(rows)}
        low = lambda x: (x is not None, x or 0)
        places = defaultdict(list)
        for r in rows:
            for p in range(r[3], r[4]):
                places[r[1], r[2], p].append((low(r[6]), -r[0], r[5]))
        got = {(r["sample_id"], r["chrom_id"], p): r["cn"] for r in sg.copy_profile(df).collect() for p in range(r["s"], r["e"])}
        assert got == {k: max(v, key=lambda x: x[:2])[2] for k, v in places.items()}


def test_ids_of_several_rows_count_once(spark):
    df = spark.createDataFrame([("b", 1, 0, 10), ("b", 1, 5, 20), ("a", 1, 5, 10), (None, 1, 0, 30), ("c", None, 0, 9)], "id string, chrom_id long, s long, e long")
    assert sorted((r["s"], r["e"], r["covering"]) for r in iv.disjoint_regions(df, "id").collect()) == [(0, 5, ["b"]), (5, 10, ["a", "b"]), (10, 20, ["b"])]


def test_copy_numbers_by_pairs(spark):
    """what the pairs give, without the pairs; empty intervals, unknown numbers and long intervals, too."""
    entries, variants = _random(4), [(r[0], *r[2:5]) for r in _random(5, 200)]
    variants.append((0, 2, 0, 5))  # an id of two places
    profile = spark.createDataFrame(entries, SCHEMA)
    df = spark.createDataFrame(variants, "variant_id long, chrom_id long, s long, e long")
    found = defaultdict(set)
    for v, c, s, e in variants:
        for r in entries:
            if r[2] == c and r[3] < e and s < r[4]:
                found[v, r[1]].add(r[5])
    want = {}
    for k, seen in found.items():
        seen -= {None}
        want[k] = (seen.pop(), False) if len(seen) == 1 else (None, True if seen else None)
    for width in (16, 7, None):
        rows = cv.extremes(df, profile.drop("entry_id"), "variant_id", "sample_id", "cn", width).groupBy("variant_id", "sample_id").agg({"low": "min", "high": "max"}).collect()
        assert {(r[0], r[1]): (r["min(low)"] if r["min(low)"] == r["max(high)"] else None, None if r["min(low)"] is None else r["min(low)"] != r["max(high)"]) for r in rows} == want
    made = ca.copy_numbers_of_variants(df, profile)
    assert {(r["variant_id"], r["sample_id"]): (r["cn"], r["conflict"]) for r in made.collect()} == want
    assert "Join" not in _plan(made)


def test_regions_of_a_deep_stack(spark):
    """no join of stretches and intervals; each copy's place is found through its alignment."""
    stack = _stack(spark).filter("entry_id < 400")
    assert "Join" not in _plan(iv.disjoint_regions(stack, "entry_id"))
    dups = stack.selectExpr("entry_id AS hit_id", "chrom_id", "s", "e", "9L AS chrom2", "10000 + s AS s2", "10000 + e - 3 AS e2", "entry_id % 2 = 0 AS forward", "concat(20, '=3D', e - s - 23, '=') AS cigar")
    made = hm.const_regions(dups)
    assert "Join" not in _plan(made)
    rows = {r["s"]: r for r in made.collect()}
    lift = lambda p: p if p <= 20 else max(20, p - 3)
    for s in (0, 1, 21, 22, 30, 399):
        r, want = rows[s], []
        for i in range(s + 1):
            a, b, n = lift(s - i), lift(r["e"] - i), 2 * N - 2 * i - 3
            if b > a:
                want.append((9, 10000 + i + a, 10000 + i + b, True) if i % 2 == 0 else (9, 10000 + i + n - b, 10000 + i + n - a, False))
        assert [tuple(c) for c in r["copies"]] == sorted(want)


def test_alignments_in_arrays(spark):
    texts = ["5=2I3=4D6=", None, "", "3S10=", "x4=7", "12=1X2N5M3H", "0=5=", "4D5="]
    made = cg.Alignments(pa.array(texts))
    for i, text in enumerate(texts):
        places = [(s, e) for s in range(22) for e in range(s + 1, 23) if s < made.ref_length[i] and e <= made.ref_length[i]]
        if not places:
            continue
        df = spark.createDataFrame([(text, s, e) for s, e in places], "c string, s long, e long")
        from pyspark.sql import functions as F

        want = [tuple(r["p"]) for r in df.select(cg.aligned_region(cg.parse_cigar(F.col("c")), F.col("s"), F.col("e")).alias("p")).collect()]
        import numpy as np

        s, e, there = made.regions(np.full(len(places), i), np.array([p[0] for p in places]), np.array([p[1] for p in places]))
        assert there.all() and list(zip(s.tolist(), e.tolist())) == want
    assert made.ref_length.tolist() == [18, 0, 0, 10, 4, 20, 5, 9]


def _table(spark, copies: int):
    r, rows = random.Random(6), []
    for i in range(60):
        s, s2, n = r.randrange(0, 60), r.randrange(0, 60), r.randrange(4, 20)
        rows += [(i + 60 * k, 1, s, s + n, i % 2, 2 + i % 3 // 2, s2, s2 + n) for k in range(copies)]
    return spark.createDataFrame(rows, "hit_id long, chrom_id long, s long, e long, strand long, chrom2 long, s2 long, e2 long")


def test_copies_are_one_in_the_graph(spark, monkeypatch):
    """rows in the same places are looked at once; edges are theirs all the same."""
    seen, real = [], hm.continuations
    monkeypatch.setattr(hm, "continuations", lambda table, *a: seen.append(table.count()) or real(table, *a))
    one, five = _table(spark, 1), _table(spark, 5)
    edges = {(r[0], r[1]): tuple(r[2:]) for r in hm.extensions(one).collect()}
    assert edges and sorted(tuple(r) for r in hm.extensions(five).collect()) == sorted((a + 60 * j, b + 60 * k, *x) for (a, b), x in edges.items() for j in range(5) for k in range(5))
    made = [sorted(map(tuple, hm.combine(t).collect()), key=str) for t in (one, five)]
    n = one.drop("hit_id").distinct().count()
    assert seen == [n] * 4
    drop = lambda rows: sorted((r[1:] for r in rows), key=str)
    assert drop(made[0]) == drop(made[1])


def test_crowded_rows(spark):
    """no join of rows and crowded stretches, which may be as long as a contig."""
    rows = [r for r in _random(8, 200) if r[3] < r[4]]
    df = spark.createDataFrame(rows, SCHEMA)
    made = hm.crowded_ids(df, "entry_id", 12)
    assert "SortMergeJoin" not in _plan(made) and "BroadcastHashJoin" not in _plan(made)
    want = {r[0] for _, _, _, here in _segments(rows) if len(here) > 12 for r in here}
    assert {r[0] for r in made.collect()} == want and 0 < len(want) < len(rows)

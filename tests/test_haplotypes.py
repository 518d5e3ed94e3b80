"""Variants pooled by haplotypes: each haplotype is found again in the records, and kept regions against single positions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from twinspan.operators import haplotypes as hp
from twinspan.operators import intervals as iv
from twinspan.operators.alignment import parse
from twinspan.operators.grouped import columns_as_lists

COPIES = "copy_id long, locus long, chrom_id long, s long, e long, seq2 string, s1 long, e1 long, seq1 string, cigar string, forward boolean"
CALLS = "variant_id long, sample_id long, gt array<int>, phased boolean"


def put_in(seq, edits):
    for s, e, alt in sorted(edits, reverse=True):
        seq = seq[:s] + alt + seq[e:]
    return seq


def some_edits(rng, seq, n):
    out, at = [], rng.randrange(1, 8)
    while at < len(seq) - 12 and len(out) < n:
        k = rng.choice([1, 1, 1, 3])
        ref = seq[at : at + k]
        alt = rng.choice(["ACGT"[("ACGT".index(ref[0]) + 1) % 4] + ref[1:], ref[0], ref + rng.choice(["A", "CG", "TTT"])])
        if alt != ref:
            out.append((at, at + k, alt))
        at += k + rng.randrange(1, 40)
    return out


def test_edits_on_copy_1_give_the_haplotype():
    rng = random.Random(3)
    for trial in range(150):
        seq1 = "".join(rng.choice("ACGT" if trial % 3 else "AC") for _ in range(rng.randrange(40, 300)))
        along, ops = hp.haplotype(seq1, some_edits(rng, seq1, 6))
        cigar, forward = "".join(f"{n}{op}" for n, op in ops if n), rng.random() < 0.5
        seq2 = along if forward else hp.reverse_complement(along)
        own = some_edits(rng, seq2, 5)
        want = put_in(seq2, own)
        found = hp.on_copy_1(seq1, seq2, cigar, forward, own)
        assert put_in(seq1, found) == (want if forward else hp.reverse_complement(want))
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:])) and all(seq1[s:e] != alt for s, e, alt in found)


def test_a_haplotype_equal_to_copy_1_has_no_edits():
    seq1 = "ACGTTGCAACGTAGCTAGCATCGATCGACTAGCTACGATCG"
    seq2 = seq1[:20] + seq1[23:]  # three letters are missing in the copy, and in a sample they aren't
    assert hp.on_copy_1(seq1, seq2, f"20=3D{len(seq1) - 23}=", True, [(19, 20, seq1[19:23])]) == []


def test_composed_alignments():
    assert hp.compose(parse("3=2D4="), parse("2=1I5=")) == [(2, "M"), (1, "I"), (1, "M"), (2, "D"), (4, "M")]
    assert hp.compose(parse("3=2I3="), parse("3=2D3=")) == [(3, "M"), (3, "M")]


def test_kept_stretches_against_positions(spark):
    rng = random.Random(5)
    rows = []
    for part in (1, 2):
        for _ in range(60):
            s = rng.randrange(-20, 400)
            rows.append((part, s, s + rng.choice([0, 1, 5, 60]), rng.choice(["keep", "keep", "discard", "ref"]), 0, 380))
    df = spark.createDataFrame(rows, "part long, s long, e long, kind string, lo long, hi long")
    for by_reference in (False, True):
        for width in (32, 1 << 16):
            got = {(r["part"], p) for r in iv.kept_stretches(df, ["part"], by_reference, width).collect() for p in range(r["s"], r["e"])}
            want = set()
            for part in (1, 2):
                for p in range(0, 380):
                    n = {k: sum(1 for q, s, e, kind, *_ in rows if q == part and kind == k and max(s, 0) <= p < min(e, 380)) for k in ("keep", "discard", "ref")}
                    if not n["discard"] and n["keep"] and n["ref"] == (n["keep"] if by_reference else 0):
                        want.add((part, p))
            assert got == want and want


def fixture(rng):
    seq1 = "".join(rng.choice("ACGT") for _ in range(300))
    along, ops = hp.haplotype(seq1, [(40, 44, seq1[40]), (150, 151, "ACGT"["TGCA".index(seq1[150])])])
    cigar = "".join(f"{n}{op}" for n, op in ops if n)
    reverse = hp.reverse_complement(along)
    copies = [(1, 7, 1, 1000, 1300, seq1, 1000, 1300, seq1, "300=", True), (2, 7, 2, 5000, 5000 + len(along), along, 1000, 1300, seq1, cigar, True),
              (3, 7, 3, 9000, 9000 + len(along), reverse, 1000, 1300, seq1, cigar, False)]
    return seq1, along, reverse, copies


def test_samples_haplotypes_are_found_in_the_pooled_records(spark):
    rng = random.Random(11)
    seq1, along, reverse, copies = fixture(rng)
    records, calls, truth = [], [], {}
    for copy_id, _, chrom, s, _, seq2, *_ in copies:
        edits = some_edits(rng, seq2, 6)
        gts = [[tuple(rng.randrange(2) for _ in range(2)) for _ in edits] for _ in range(3)]
        for i, (a, b, alt) in enumerate(edits):
            records.append((copy_id * 100 + i, chrom, s + a, seq2[a:b], [alt]))
            calls += [(copy_id * 100 + i, sample, list(gts[sample][i]), True) for sample in range(3)]
        for sample in range(3):
            for hap in range(2):
                own = put_in(seq2, [x for x, g in zip(edits, gts[sample]) if g[hap]])
                truth[sample, copy_id, hap] = hp.reverse_complement(own) if copy_id == 3 else own
        truth[9, copy_id, 0] = truth[9, copy_id, 1] = along if copy_id > 1 else seq1
    made = hp.pool_variants(
        spark.createDataFrame(records, "variant_id long, chrom_id long, s long, ref string, alts array<string>"), spark.createDataFrame(calls, CALLS),
        spark.createDataFrame(copies, COPIES), spark.createDataFrame([(s,) for s in (0, 1, 2, 9)], "sample_id long"),
    )
    rows = made["variants"].collect()
    assert len({(r["s"], r["e"]) for r in rows}) >= 8
    for sample in (0, 1, 2, 9):
        own = [r for r in rows if r["sample_id"] == sample]
        assert all(r["cn"] == [2, 2, 2] and r["alleles"][0] == seq1[r["s"] - 1000 : r["e"] - 1000] and len(set(r["alleles"])) == len(r["alleles"]) for r in own)
        for k in range(6):
            edits = [(r["s"] - 1000, r["e"] - 1000, r["alleles"][r["gt"][k]]) for r in own]
            assert put_in(seq1, edits) == truth[sample, k // 2 + 1, k % 2]
    assert [tuple(r) for r in made["regions"].collect()] == [(7, 1000, 1300)]


def test_an_indel_before_a_record_moves_it_right(spark):
    """A record behind the four letters that copy 2 lacks: an offset of the copies would put it three letters too far left."""
    seq1, along, _, copies = fixture(random.Random(2))
    at = 200
    alt = "ACGT"["TGCA".index(along[at])]
    records = spark.createDataFrame([(1, 2, 5000 + at, along[at], [alt])], "variant_id long, chrom_id long, s long, ref string, alts array<string>")
    made = hp.pool_variants(records, spark.createDataFrame([(1, 0, [0, 1], True)], CALLS), spark.createDataFrame(copies[:2], COPIES), spark.createDataFrame([(0,)], "sample_id long"))
    rows = {r["s"]: r for r in made["variants"].collect()}
    assert 1000 + at + 3 in rows and rows[1000 + at + 3]["gt"] == [0, 0, 0, 1] and rows[1000 + at + 3]["alleles"] == [along[at], alt] and 1000 + at not in rows


def test_what_is_discarded(spark):
    seq1, _, _, copies = fixture(random.Random(4))
    one = spark.createDataFrame(copies[:1], COPIES)
    samples = spark.createDataFrame([(0,)], "sample_id long")
    rows = [(1, 1, 1050, seq1[50:54], [seq1[50]]), (2, 1, 1052, seq1[52], ["A" if seq1[52] != "A" else "C"]), (3, 1, 998, "NNN" + seq1[1:2], ["N"]), (4, 1, 1200, seq1[200], ["A" if seq1[200] != "A" else "C"]), (5, 1, 1210, seq1[210], ["A" if seq1[210] != "A" else "C"])]
    records = spark.createDataFrame(rows, "variant_id long, chrom_id long, s long, ref string, alts array<string>")
    calls = lambda phased: spark.createDataFrame([(i, 0, [0, 1], phased) for i in range(1, 6)], CALLS)
    regions = lambda **kw: [tuple(r)[1:] for r in hp.pool_variants(records, kw.pop("calls"), one, samples, **kw)["regions"].orderBy("s").collect()]
    # 3 reaches over the edge, 2 overlaps 1: from one base before the record before it to one behind its end
    assert regions(calls=calls(True)) == [(1003, 1049), (1054, 1300)]
    assert regions(calls=calls(False), distance=20) == [(1003, 1049), (1054, 1199), (1212, 1300)]
    limits = spark.createDataFrame([(1, 1100, 1205)], "chrom_id long, s long, e long")
    assert regions(calls=calls(True), limits=limits) == [(1100, 1205)]
    bad = spark.createDataFrame([(4, 0, [0, 1], True), (5, 0, [0, 1, 1], True)], CALLS)
    with pytest.raises(Exception, match="different copy numbers"):
        hp.pool_variants(records, bad, one, samples)["variants"].collect()


def test_nothing_to_pool(spark):
    _, _, _, copies = fixture(random.Random(4))
    empty = spark.createDataFrame([], "variant_id long, chrom_id long, s long, ref string, alts array<string>")
    made = hp.pool_variants(empty, spark.createDataFrame([], CALLS), spark.createDataFrame(copies[:1], COPIES), spark.createDataFrame([(0,)], "sample_id long"))
    assert made["variants"].count() == 0 and [tuple(r) for r in made["regions"].collect()] == [(7, 1000, 1300)]
    assert made["variants"].select(F.size("gt")).count() == 0


def test_sequences_are_read_once_and_any_copy_may_be_first(spark, monkeypatch):
    """The first copy lies on a part of copy 1 only, and each haplotype has a bucket of its own."""
    monkeypatch.setattr(hp, "BUCKET", 1, raising=False)
    rng = random.Random(8)
    seq1 = "".join(rng.choice("ACGT") for _ in range(300))
    other = lambda c: "ACGT"["TGCA".index(c)]
    copies = [(1, 7, 1, 0, 100, seq1[:100], 1000, 1100, seq1[:100], "100=", True), (2, 7, 2, 5000, 5300, seq1, 1000, 1300, seq1, "300=", True)]
    at = (50, 150, 250)
    records = [(i, 2, 5000 + p, seq1[p], [other(seq1[p])]) for i, p in enumerate(at)]
    calls = [(i, sample, [int(sample == i), int(sample == 3)], True) for i in range(3) for sample in range(4)]
    n_read = spark.sparkContext.accumulator(0)

    def read(seq):
        n_read.add(1)
        return seq

    given = spark.createDataFrame(copies, COPIES).withColumn("seq1", F.udf(read, "string")("seq1"))
    made = hp.pool_variants(spark.createDataFrame(records, "variant_id long, chrom_id long, s long, ref string, alts array<string>"), spark.createDataFrame(calls, CALLS), given, spark.createDataFrame([(s,) for s in range(4)], "sample_id long"))
    rows = {(r["s"] - 1000, r["sample_id"]): (r["alleles"], r["gt"], r["cn"]) for r in made["variants"].collect()}
    want = {(p, s): ([seq1[p], other(seq1[p])], [0, 0] * (p < 100) + [int(s == i), int(s == 3)], [2, 2] if p < 100 else [2]) for i, p in enumerate(at) for s in range(4)}
    assert rows == want and n_read.value == len(copies)


def test_columns_as_lists():
    columns = [[1, None, 3, 4], [1, 2, 3, 4], [1.5, 2.0, float("inf"), 0.0], [True, None, False, True], [[1, 2], None, [], [None, 3]], [["a"], ["b", "c"], None, []], [[{"a": 1}], [], None, [{"a": 2}]]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list("abcdefg"))
    for part in (batch, batch.slice(1), batch.slice(1, 2), batch.slice(4)):
        assert columns_as_lists(part) == [c.to_pylist() for c in part.columns]

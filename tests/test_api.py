"""The commands end to end on small made-up inputs."""

import random

import numpy as np
from pyspark.sql import functions as F
from twinspan import api
from twinspan.operators import variants as vr


def test_pretable_to_examine(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, int(s), int(s + 400), 1, 1, int(s + 5000), int(s + 5400), 0.98) for i, s in enumerate(rng.integers(0, 20_000, 30))]
    rows += [(100, 0, 0, 300, 1, 0, 10, 310, 0.99), (101, 0, 0, 100, 1, 1, 0, 100, 0.99), (102, 0, 50, 450, 1, 0, 400, 800, 0.99)]
    hits = spark.createDataFrame(rows, "hit_id long, chrom_id long, s long, e long, strand long, chrom2 long, s2 long, e2 long, similarity double")
    pre = api.pretable(hits)
    assert {100, 101} & {r["hit_id"] for r in pre.collect()} == set() and pre.filter("hit_id = 102").first()["is_tangled"]
    table = api.table(pre.filter("not is_tangled"))
    assert 0 < table.count() <= 30 and table.agg(F.sum("n_parts")).first()[0] <= 30
    assert api.examine(pre).filter("ref_cn < 4").count() == 0


def test_view_with_regions(spark):
    rows = [("chr1", 0, 50, "+", "chr2", 5, 55, "ALENGTH=50;SS=0.99", False), ("chr1", 500, 520, "-", "chr3", 5, 25, "ALENGTH=20;SS=0.9", False), ("chr2", 0, 9, None, None, None, None, "tangled", True)]
    t = spark.createDataFrame(rows, "chrom1 string, start1 long, end1 long, strand string, chrom2 string, start2 long, end2 long, info string, is_tangled boolean")
    assert [r["start1"] for r in api.view(t, "length > 30").collect()] == [0, 0]
    assert [r["start1"] for r in api.view(t, "length > 30", skip_tangled=True).collect()] == [0]
    regions = spark.createDataFrame([("chr1", 510, 511)], "chrom_id string, s long, e long")
    assert [r["start1"] for r in api.view(t, regions=regions).collect()] == [500]
    assert api.tangled(spark.createDataFrame([("sep=1",)], "info string").select(F.lit("SEP=10;AV_MULT=3").alias("info"), F.lit(False).alias("is_tangled"))).first()["is_tangled"]


def test_depth_and_copy_number(spark):
    rng = np.random.default_rng(2)
    reads, k = [], 0
    for sample in range(4):
        for w in range(60):
            for _ in range(rng.poisson(20 * (1.5 if sample == 0 and 20 <= w < 40 else 1))):
                reads.append((k, sample, int(w * 100 + rng.integers(100)), 60, 0, 0, 0, 0))
                k += 1
    df = spark.createDataFrame(reads, "read_id long, sample_id long, pos long, mapq long, flag int, is_read2 long, clipped int, unpaired int")
    windows = spark.createDataFrame([(w, 35 + w % 6) for w in range(60)], "window_ix long, gc long")
    bg = api.background_depth(df, windows, api.DepthConfig(tail_windows=10, loess_fraction=1.0))
    assert bg.count() == 24
    counts = spark.createDataFrame([(r["sample_id"], r["window_ix"], r["depth1"]) for r in __import__("twinspan.operators.depth", fromlist=["x"]).window_counts(df, 100).collect()], "sample_id long, window_ix long, depth long")
    depths = counts.withColumn("locus", F.lit(0).cast("bigint")).withColumn("nb_n", F.lit(200.0)).withColumn("nb_p", F.lit(200.0 / 210.0))
    cn = {(r["sample_id"], r["window_ix"]): r["cn"] for r in api.copy_number(depths, reference_cn=2).collect()}
    assert np.mean([cn[(0, w)] == 3 for w in range(22, 38)]) > 0.9 and np.mean([cn[(1, w)] == 2 for w in range(60)]) > 0.9
    multipliers = windows.select(F.lit(0).cast("bigint").alias("locus"), "window_ix", F.lit(1.0).alias("multiplier"))
    assert api.copy_number_using(depths, multipliers, reference_cn=2).count() == 240


def test_psvs_calls_and_pooling(spark):
    a = spark.createDataFrame([(0, 2, "3=1X4=", "ACGTACGT", "ACGAACGT"), (0, 3, "3=1X4=", "ACGTACGT", "ACGCACGT")], "locus long, copy long, cigar string, ref string, read string")
    r = api.psvs(a).first()
    assert (r["s"], r["e"], r["alleles"]) == (3, 4, ["T", "A", "C"]) and [(c["copy"], c["allele_ix"]) for c in r["copies"]] == [(2, 1), (3, 2)]
    obs = spark.createDataFrame([(1, 1, k, k % 2, True, -5.0) for k in range(40)] + [(1, 1, 99, 1, True, -0.1)], "variant_id long, sample_id long, read_id long, allele_ix int, is_snp boolean, ln_qual double")
    assert api.call(obs, 4, 2).first()["gt"] == "0/0/1/1"
    copy1 = "ACGTTGCAACGTACCATGCA" * 3
    copies = spark.createDataFrame([(0, 0, 60, copy1, copy1, "60=")], "chrom_id long, s long, e long, copy1 string, copy2 string, cigar string")
    reads = spark.createDataFrame([(7, 0, 20, 40, copy1[20:40], 20)], "read_id long, chrom_id long, s long, e long, seq string, start2 long")
    assert tuple(api.pool(reads, copies).first()) == (7, 20, "20=")
    records = spark.createDataFrame([(1, 0, 5, 6, ["A", "C"], [0, 1]), (2, 0, 105, 106, ["A", "G"], [1, 1])], "variant_id long, chrom_id long, s long, e long, alleles array<string>, gt array<int>")
    places = spark.createDataFrame([(0, 0, 50, 0), (0, 100, 150, 0)], "chrom_id long, s long, e long, offset long")
    assert tuple(api.pool_variants(records, places).first()) == (5, ["A", "C", "G", "G"], ["A", "C", "G"])


def test_reads_of_a_sequence_and_observations(spark):
    s = spark.createDataFrame([(1, "ACGT" * 300), (2, "ACNN" * 300), (3, "AC")], "region_id long, seq string")
    assert [r["start"] for r in api.artificial_reads(s).orderBy("start").collect()] == [0, 150, 300, 450, 600, 750, 900]
    pairs = spark.createDataFrame([(1, 4, "A"), (1, 5, "C"), (2, 5, "G")], "read_id long, ref_pos long, base string")
    psv = spark.createDataFrame([(9, 4, 6)], "psv_id long, s long, e long")
    got = {r["read_id"]: (r["allele"], r["partial"]) for r in vr.allele_observations(pairs, psv).collect()}
    assert got == {1: ("AC", False), 2: ("G", True)}
    moved = vr.remap_alleles(spark.createDataFrame([(1, 0), (1, 1)], "variant_id long, allele_ix int"), spark.createDataFrame([(1, ["A", "C"])], "variant_id long, alleles array<string>"), spark.createDataFrame([(1, ["C", "T"])], "variant_id long, alleles array<string>"))
    assert sorted(r["allele_ix"] for r in moved.collect()) == [-1, 0]


def test_a_table_from_sequences_alone(spark):
    """A stretch of 1,500 letters that stands twice: reads, hits, pretable and table find it."""
    rng = random.Random(50)
    draw = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    core = draw(1500)
    sequences = spark.createDataFrame([(0, draw(900) + core + draw(900)), (1, draw(1200) + core + draw(600))], "seq_id long, seq string")
    config = api.TableConfig(read_len=300, read_step=100)
    pre = api.pretable(api.self_hits(sequences, config), config)
    table = [r for r in api.table(pre).collect() if (r["chrom_id"], r["chrom2"]) == (0, 1)]
    assert len(table) == 1
    r = table[0]
    assert abs(r["s"] - 900) <= 120 and abs(r["e"] - 2400) <= 120 and abs(r["s2"] - 1200) <= 120 and abs(r["e2"] - 2700) <= 120

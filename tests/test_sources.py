"""Text formats: written here, read back."""

import pytest
from pyspark.sql import functions as F
from twinspan.sources import models as md
from twinspan.sources import scratch as sc
from twinspan.sources import text as tx


def write(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content)
    return str(p)


def test_fasta_chunks_and_fetch(spark, tmp_path):
    path = write(tmp_path, "a.fa", ">c1 first\nacgtACGT\nNNAC\n>c2\nTTTT\n")
    chunks = tx.read_fasta(spark, path, 5)
    assert sorted(map(tuple, chunks.collect())) == [("c1", 0, "ACGTA"), ("c1", 1, "CGTNN"), ("c1", 2, "AC"), ("c2", 0, "TTTT")]
    regions = spark.createDataFrame([(1, "c1", 3, 11), (2, "c2", 0, 4)], "region_id long, chrom string, s long, e long")
    assert {r["region_id"]: r["seq"] for r in tx.fetch(chunks, regions, 5).collect()} == {1: "TACGTNNA", 2: "TTTT"}


def test_homology_round_trip(spark, tmp_path):
    line = "chr1\t10\t20\t+\tchr2\t30\t40\tSS=0.9;ALENGTH=10\nchr1\t5\t9\t*\t*\t*\t*\ttangled\n"
    rows = tx.read_homology(spark, write(tmp_path, "t.bed", "# head\n" + line)).orderBy("start1")
    got = rows.collect()
    assert got[0]["is_tangled"] and not got[1]["is_tangled"] and got[1]["m"] == {"SS": "0.9", "ALENGTH": "10"}
    out = str(tmp_path / "out")
    tx.write_homology(rows, out)
    assert sorted(tx.read_homology(spark, out).drop("m").collect()) == sorted(rows.drop("m").collect())
    assert tx.pretty_homology(rows).count() == 2


def test_regions_and_contigs(spark, tmp_path):
    contigs = tx.contigs_of_header(spark, write(tmp_path, "h.txt", "# Chromosomes: chr1:1000, chr2:500\nx\n"))
    assert [tuple(r) for r in contigs.orderBy("chrom_id").collect()] == [(0, "chr1", 1000), (1, "chr2", 500)]
    texts = spark.createDataFrame([("chr1:11-20::a",), ("chr2",), ("chr9:1-2",), ("chr2:401-9,999",)], "region string")
    got = {r["name"]: (r["chrom"], r["s"], r["e"]) for r in tx.read_regions(texts, contigs).collect()}
    assert got == {"a": ("chr1", 10, 20), "chr2": ("chr2", 0, 500), "chr2:401-9,999": ("chr2", 400, 500)}


def test_sam_and_groups(spark, tmp_path):
    path = write(tmp_path, "r.sam", "@HD\tVN:1\n@RG\tID:g1\tSM:s1\nr1\t99\tchr1\t11\t60\t5M\t=\t21\t15\tACGTA\tIIII!\tRG:Z:g1\tNM:i:0\nr2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    r1, r2 = tx.read_sam(spark, path).orderBy("name").collect()
    assert (r1["pos"], r1["mate_chrom"], r1["mate_pos"], r1["qual"], r1["tags"]) == (10, "chr1", 20, [40, 40, 40, 40, 0], {"RG": "g1", "NM": "0"})
    assert r2["chrom"] is None and r2["cigar"] is None and r2["qual"] is None
    assert [tuple(r) for r in tx.read_groups(spark, path).collect()] == [("g1", "s1")]


def test_vcf_round_trip(spark, tmp_path):
    path = write(tmp_path, "v.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\nchr1\t5\t.\tA\tC,G\t9.5\tPASS\tk=1;f\tGT:DP\t0/1:7\n")
    row = tx.read_vcf(spark, path).first()
    assert (row["start"], row["alleles"], row["qual"], row["info"], row["samples"]) == (4, ["A", "C", "G"], 9.5, {"k": "1", "f": None}, [{"GT": "0/1", "DP": "7"}])
    df = spark.createDataFrame([("chr1", 4, ["A", "C"], 9.5, "PASS", "k=1", "GT", "0/1")], "chrom string, start long, alleles array<string>, qual double, filter string, info string, format string, s1 string")
    assert [r["value"] for r in tx.vcf_lines(df, ["s1"], ["##a"]).collect()] == ["##a", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1", "chr1\t5\t.\tA\tC\t9.5\tPASS\tk=1\tGT\t0/1"]


def test_depth_lists_and_overrides(spark, tmp_path):
    d = tx.read_depth(spark, write(tmp_path, "d.csv", "# p\nsample\tgc_content\tread_end\tnbinom_n\tnbinom_p\na\t40\t1\t8\t0.5\na\t40\t2\t9\t0.5\n"))
    assert [tuple(r) for r in d.collect()] == [("a", 40, 4.0, 0.5)] and tx.duplicated_samples(d.union(d)).count() == 1
    assert [tuple(r) for r in tx.read_file_list(spark, write(tmp_path, "l.txt", "a.bam::s1\nb.bam s2\n")).collect()] == [("a.bam", "s1"), ("b.bam", "s2")]
    contigs, samples = spark.createDataFrame([("c", 100)], "name string, length long"), spark.createDataFrame([("x",), ("y",)], "sample string")
    o = tx.read_overrides(spark, write(tmp_path, "o.bed", "c\t0\tinf\t*\t4\nc\t5\t9\tx\t3\n"), contigs, samples)
    assert sorted(map(tuple, o.collect())) == [("c", 0, 100, "x", 4), ("c", 0, 100, "y", 4), ("c", 5, 9, "x", 3)]
    assert tx.genome_name("hg38") == "grch38"


def test_genomes_files_and_headers(spark, tmp_path):
    a = spark.createDataFrame([("c1", 0, "ACGT"), ("c2", 0, "AA")], "chrom string, chunk int, seq string")
    b = spark.createDataFrame([("c2", 0, "TT"), ("c3", 0, "G")], "chrom string, chunk int, seq string")
    assert sorted(map(tuple, tx.merge_sequences(a, b).collect())) == [("c1", 0, "ACGT"), ("c2", 0, "AA"), ("c3", 0, "G")]
    with pytest.raises(ValueError, match="c2"):
        tx.merge_sequences(a, b.withColumn("seq", F.lit("TTT")))
    groups = spark.createDataFrame([("g1", "s1")], "rg string, sample string")
    assert [r["value"] for r in tx.pooled_header("c1", 9, groups, 50).orderBy("ord").collect()] == ["@SQ\tSN:c1\tLN:9", "@RG\tID:g1\tSM:s1", "@CO\tmax_mate_dist=50"]
    prefix = str(tmp_path / "pooled")
    assert tx.pooled_files(spark, prefix) is None
    folder = tmp_path / "pooled"
    folder.mkdir()
    for name in ("0.cram", "0.cram.crai", "1.bam", "1.bam.bai"):
        (folder / name).write_text("")
    assert tx.pooled_files(spark, prefix) is None
    (folder / "success").write_text("")
    assert tx.pooled_files(spark, prefix) == [f"{prefix}/0.cram", f"{prefix}/1.bam"] and tx.pooled_files(spark, prefix, 3) is None
    (tmp_path / "pooled.bam").write_text("")
    (tmp_path / "pooled.bam.bai").write_text("")
    assert tx.pooled_files(spark, prefix) == [f"{prefix}.bam"]
    tx.write_tables({"groups": groups}, str(tmp_path / "debug"))
    assert spark.read.csv(str(tmp_path / "debug/groups"), sep="\t", header=True).collect() == groups.collect()


def test_depth_tables_that_do_not_fit(spark, tmp_path):
    rows = [(s, gc, "1", 5, 1.0, 2.0, 8.0, 0.5) for s in ("a", "b") for gc in (40, 41)]
    df = spark.createDataFrame(rows, "sample string, gc_content int, read_end string, n_windows int, mean double, var double, nbinom_n double, nbinom_p double")
    one, two, other = (str(tmp_path / n) for n in ("one", "two", "other"))
    tx.write_depth(df.filter("sample = 'a'"), one, {"ploidy": 2, "window size": 100})
    tx.write_depth(df.filter("sample = 'b' and gc_content = 40"), two, {"ploidy": 2, "window size": 100})
    tx.write_depth(df.filter("sample = 'b'"), other, {"ploidy": 2, "window size": 50})
    samples = df.select("sample").distinct()
    assert tx.merge_depths(spark, [one], samples.filter("sample = 'a'"), (40, 42)).count() == 2
    for paths, match in (([one, two], "all GC bins: b"), ([one, other], "parameters"), ([one, one], "twice: a")):
        with pytest.raises(ValueError, match=match):
            tx.merge_depths(spark, paths, samples, (40, 42))


def test_models_and_loci(spark, tmp_path):
    entries = spark.createDataFrame(
        [("main", "x", "c1", 0, 100, None, {"version": "1"}), ("const_region", "x", "c1", 0, 50, [("c2", 5, 55, False)], {}), ("const_region", "y", "c1", 60, 90, [], {})], md.ENTRY
    )
    path = str(tmp_path / "model")
    md.write_model(entries, path)
    got = {(r["kind"], r["locus"]): r for r in md.read_model(spark, path).collect()}
    assert got["main", "x"]["info"] == {"version": "1"} and got["const_region", "x"]["regions2"] == [("c2", 5, 55, False)] and got["const_region", "y"]["s"] == 60
    run = entries.filter("kind = 'const_region'").select("locus", "chrom", "s", F.when(F.col("locus") == "y", 91).otherwise(F.col("e")).alias("e"), "regions2")
    assert sorted((r["where"], r["e"]) for r in md.region_mismatches(md.read_model(spark, path), run).collect()) == [("model", 90), ("run", 91)]
    assert {r["locus"] for r in md.select_loci(entries, ["!x"]).collect()} == {"y"} and md.select_loci(entries, ["x"]).count() == 2
    with pytest.raises(ValueError, match="z"):
        md.select_loci(entries, ["z"])
    (tmp_path / "bad" / "locus=q").mkdir(parents=True)
    (tmp_path / "bad" / "locus=q" / "a.txt").write_text("nonsense\tc1:1-2\t*\t*\n")
    with pytest.raises(Exception, match="unexpected entry"):
        md.read_model(spark, str(tmp_path / "bad")).collect()


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    assert sc.scratch_dir(spark)

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        sc.scratch_dir(Session())

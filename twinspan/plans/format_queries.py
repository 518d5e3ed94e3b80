"""Queries of sources and sinks: tables written as text in the shared folder, read back, and held against SQL over the
tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import homology as hm
from ..operators import intervals as iv
from ..sources import models as md
from ..sources import scratch as sc
from ..sources import text as tx
from .analogs import view, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def _text(df: DataFrame, expression: str, name: str) -> str:
    return sc.as_text(df.select(F.expr(expression).alias("value")), name)


_CLEAN = "regexp_replace(seq, '[^ACGT]', 'N', 'g')"


@query(f"""SELECT concat('d', CAST(doc_id AS STRING)) AS chrom, CAST(length(seq) // 3 AS BIGINT) AS s, CAST(2 * length(seq) // 3 + 1 AS BIGINT) AS e,
    md5(substr({_CLEAN}, CAST(length(seq) // 3 + 1 AS INTEGER), CAST(2 * length(seq) // 3 + 1 - length(seq) // 3 AS INTEGER))) AS seq FROM seqs WHERE length(seq) > 0""", "seqs")
def s01_fasta_fetch(spark, d) -> DataFrame:
    """The middle third of each sequence, fetched from FASTA chunks."""
    seqs = view(spark, d, "seqs").filter("length(seq) > 0")
    path = _text(seqs, "concat('>d', doc_id, ' document\\n', regexp_replace(seq, '[^ACGT]', 'N'))", "fasta")
    regions = seqs.select(F.col("doc_id").alias("region_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), F.expr("length(seq) div 3").alias("s"), F.expr("2 * length(seq) div 3 + 1").alias("e"))
    return tx.fetch(tx.read_fasta(spark, path, 1000), regions, 1000).select("chrom", "s", "e", F.md5("seq").alias("seq"))


@query("SELECT lang, count(*) AS contigs, CAST(sum(length(seq)) AS BIGINT) AS letters FROM seqs WHERE length(seq) > 0 GROUP BY 1", "seqs")
def s02_merged_genomes(spark, d) -> DataFrame:
    """Two genomes that share the English sequences: each contig once."""
    seqs = view(spark, d, "seqs").filter("length(seq) > 0").select("lang", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), F.lit(0).alias("chunk"), "seq")
    one = seqs.filter("lang in ('en', 'de')").drop("lang")
    two = seqs.filter("lang <> 'de'").drop("lang")
    merged = tx.merge_sequences(one, two).join(seqs.select("chrom", "lang"), "chrom")
    return merged.groupBy("lang").agg(F.count(F.lit(1)).alias("contigs"), F.sum(F.length("seq")).cast("bigint").alias("letters"))


@query("SELECT row_number() OVER (ORDER BY chrom_id) - 1 AS chrom_id, concat('chr', CAST(chrom_id AS STRING)) AS name, length + chrom_id AS length FROM contigs", "contigs")
def s03_header_contigs(spark, d) -> DataFrame:
    contigs = view(spark, d, "contigs").agg(F.array_sort(F.collect_list(F.struct("chrom_id", "length"))).alias("c"))
    path = _text(contigs, "concat('# Chromosomes: ', array_join(transform(c, x -> concat('chr', x.chrom_id, ':', x.length + x.chrom_id)), ', '))", "header")
    return tx.contigs_of_header(spark, path).select(F.col("chrom_id").cast("bigint").alias("chrom_id"), "name", "length")


_TABLE = "concat_ws('\\t', chrom1, start1, end1, strand, if(is_tangled, '*', chrom2), if(is_tangled, '*', string(start2)), if(is_tangled, '*', string(end2)), info)"


@query("""SELECT DISTINCT chrom1, start1, end1, chrom2, start2, end2, dup_id FROM hom h WHERE NOT is_tangled AND EXISTS (SELECT 1 FROM iv_b JOIN orders ON o_orderkey = b_id WHERE o_orderstatus = 'P'
    AND concat('chr', CAST(CAST(chrom_id % 5 AS BIGINT) AS STRING)) = h.chrom1 AND s < h.end1 AND h.start1 < e)""", "hom", "iv_b")
def s04_regions_of_a_table(spark, d) -> DataFrame:
    """Rows of a homology table in regions that overlap each other: none comes twice."""
    o = view(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("b_id"))
    regions = view(spark, d, "iv_b").join(o, "b_id").select(F.concat(F.lit("chr"), (F.col("chrom_id") % 5).cast("string")).alias("chrom_id"), "s", "e")
    rows = hm.view_table(view(spark, d, "hom").dropDuplicates(["dup_id", "chrom1", "start1", "end1", "chrom2", "start2", "end2"]), regions=regions, skip_tangled=True)
    return rows.select("chrom1", "start1", "end1", "chrom2", "start2", "end2", "dup_id").distinct()


@query("""SELECT concat('chr', CAST(chrom_id AS STRING)) AS chrom, s, least(e, 20000) AS e, concat('r', CAST(b_id AS STRING)) AS name, e > 20000 AS trimmed FROM iv_b WHERE s < 20000 AND chrom_id < 90""", "iv_b")
def s06_region_texts(spark, d) -> DataFrame:
    """Regions as text with names, on contigs of 20,000: trimmed, left out where they lie behind the end."""
    b = view(spark, d, "iv_b")
    texts = b.select(F.concat(F.lit("chr"), F.col("chrom_id").cast("string"), F.lit(":"), F.format_number(F.col("s") + 1, 0), F.lit("-"), F.format_number("e", 0), F.lit("::r"), F.col("b_id").cast("string")).alias("region"))
    contigs = b.filter("chrom_id < 90").select(F.concat(F.lit("chr"), F.col("chrom_id").cast("string")).alias("name")).distinct().withColumn("length", F.lit(20000).cast("bigint"))
    return tx.read_regions(texts, contigs).select("chrom", "s", "e", "name", "trimmed")


@query("""SELECT chrom1, start1, end1, strand, CASE WHEN NOT is_tangled THEN chrom2 END AS chrom2, CASE WHEN NOT is_tangled THEN start2 ELSE -1 END AS start2, CASE WHEN NOT is_tangled THEN end2 ELSE -1 END AS end2, is_tangled,
    regexp_extract(info, 'SEP=([0-9]+)', 1) AS sep, count(*) AS n FROM hom GROUP BY ALL""", "hom")
def s07_homology_round_trip(spark, d) -> DataFrame:
    """The table as text, read, written sorted, and read again."""
    rows = tx.read_homology(spark, _text(view(spark, d, "hom"), _TABLE, "homology"))
    again = sc.scratch_path(spark, "homology")
    tx.write_homology(rows, again)
    return tx.read_homology(spark, again).groupBy("chrom1", "start1", "end1", "strand", "chrom2", F.coalesce("start2", F.lit(-1)).alias("start2"), F.coalesce("end2", F.lit(-1)).alias("end2"), "is_tangled", F.col("m")["SEP"].alias("sep")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT concat(chrom1, ':', CASE WHEN start1 + 1 >= 1000 THEN concat(CAST((start1 + 1) // 1000 AS STRING), ',', lpad(CAST((start1 + 1) % 1000 AS STRING), 3, '0')) ELSE CAST(start1 + 1 AS STRING) END, '-',
    CASE WHEN end1 >= 1000 THEN concat(CAST(end1 // 1000 AS STRING), ',', lpad(CAST(end1 % 1000 AS STRING), 3, '0')) ELSE CAST(end1 AS STRING) END) AS region1, strand, replace(info, ';', '; ') AS info FROM hom""", "hom")
def s08_pretty_table(spark, d) -> DataFrame:
    return tx.pretty_homology(view(spark, d, "hom")).select("region1", "strand", "info")


@query("SELECT concat('r', CAST(user_id AS STRING)) AS name, flag, concat('chr', CAST(sample_id AS STRING)) AS chrom, pos, mapq, CAST(20 + read_id % 7 AS BIGINT) AS first_quality, concat('g', CAST(sample_id AS STRING)) AS rg, concat('chr', CAST(sample_id AS STRING)) AS mate_chrom, pos + 100 AS mate_pos FROM reads", "reads")
def s09_sam_lines(spark, d) -> DataFrame:
    line = "concat_ws('\\t', concat('r', user_id), flag, concat('chr', sample_id), pos + 1, mapq, '4M', '=', pos + 101, 104, 'ACGT', concat(char(int(53 + read_id % 7)), 'III'), concat('RG:Z:g', sample_id), 'NM:i:0')"
    r = tx.read_sam(spark, _text(view(spark, d, "reads"), line, "sam"))
    return r.select("name", "flag", "chrom", "pos", "mapq", F.get("qual", F.lit(0)).cast("bigint").alias("first_quality"), F.col("tags")["RG"].alias("rg"), "mate_chrom", "mate_pos")


@query("SELECT concat(CAST(c_custkey AS STRING), '.sam') AS file, c_name AS sample, CAST(CASE WHEN c_nationkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS fault FROM customer WHERE c_acctbal <= 5000")
def s10_file_selection(spark, d) -> DataFrame:
    """Files and their samples from a list, those of a small enough ratio; a third of the nations lacks a contig."""
    c = view(spark, d, "customer")
    files = tx.read_file_list(spark, _text(c, "concat(c_custkey, '.sam', if(c_custkey % 2 = 0, '::', '\\t'), c_name)", "list"))
    genome = spark.createDataFrame([("chr1", 100), ("chr2", 50)], "name string, length long")
    headers = c.select(F.concat(F.col("c_custkey").cast("string"), F.lit(".sam")).alias("file"), F.explode(F.when(F.col("c_nationkey") % 3 == 0, F.array(F.lit("chr1"))).otherwise(F.array(F.lit("chr1"), F.lit("chr2")))).alias("name"))
    return tx.select_files(files, headers.join(F.broadcast(genome), "name"), genome, c.select(F.col("c_name").alias("sample"), F.col("c_acctbal").alias("ratio")), 5000)


@query("SELECT concat('g', CAST(n_nationkey AS STRING)) AS rg, r_name AS sample, n_name AS given FROM nation JOIN region ON n_regionkey = r_regionkey")
def s11_read_groups(spark, d) -> DataFrame:
    """The header's samples, and a name given by hand put over them."""
    n, r = view(spark, d, "nation"), view(spark, d, "region")
    path = _text(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")), "concat('@RG\\tID:g', n_nationkey, '\\tSM:', r_name, '\\tPL:x')", "groups")
    groups = tx.read_groups(spark, path)
    over = tx.read_groups(spark, path, sample="-").select("rg", F.col("sample").alias("over"))
    names = n.select(F.concat(F.lit("g"), F.col("n_nationkey").cast("string")).alias("rg"), "n_name")
    return groups.join(over, "rg").join(names, "rg").select("rg", "sample", F.when(F.col("over") == "-", F.col("n_name")).alias("given"))


@query(f"""SELECT doc_id AS region_id, s, e, CAST(floor(100.0 * length(regexp_replace(w, '[^GC]', '', 'g')) / 100) AS BIGINT) AS gc FROM (SELECT doc_id, CAST(i * 100 AS BIGINT) AS s, CAST(i * 100 + 100 AS BIGINT) AS e, substr(q, CAST(i * 100 + 1 AS INTEGER), 100) AS w
    FROM (SELECT doc_id, translate(seq, ' ', 'A') AS q, unnest(range(0, length(seq) // 100)) AS i FROM seqs)) WHERE regexp_matches(w, '^[^N]*$')""", "seqs")
def s12_background_windows(spark, d) -> DataFrame:
    """Windows of 100 letters of each sequence with their GC per cent; those with an N are left out."""
    s = view(spark, d, "seqs").withColumn("seq", F.translate("seq", " ", "A")).filter("length(seq) >= 100")
    cut = s.select("doc_id", "seq", F.explode(F.sequence(F.lit(0), F.expr("int(length(seq) div 100) - 1"))).alias("i"))
    rows = cut.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("i").cast("string")).alias("region_id"), "doc_id", (F.col("i") * 100).cast("bigint").alias("s"), F.expr("substring(seq, i * 100 + 1, 100)").alias("seq"))
    windows = tx.background_windows(rows.select("region_id", "doc_id", "s", (F.col("s") + 100).alias("e")), rows.select("region_id", "seq"))
    return windows.select(F.col("doc_id").alias("region_id"), "s", "e", F.col("gc").cast("bigint").alias("gc"))


_DEPTH = "SELECT sample_id, CAST(gc AS BIGINT) AS gc, CAST(count(*) AS BIGINT) AS n_windows, avg(depth1) AS mean FROM win_depth GROUP BY 1, 2"


def _depth_rows(spark, d) -> DataFrame:
    rows = view(spark, d, "win_depth").groupBy("sample_id", "gc").agg(F.count(F.lit(1)).alias("n_windows"), F.avg("depth1").alias("mean"))
    return rows.select(F.concat(F.lit("s"), F.col("sample_id").cast("string")).alias("sample"), F.col("gc").alias("gc_content"), F.explode(F.array(F.lit("1"), F.lit("2"))).alias("read_end"), "n_windows", "mean", F.col("mean").alias("var"), (F.col("n_windows") * 4).alias("nbinom_n"), F.lit(0.25).alias("nbinom_p"))


@query(f"SELECT concat('s', CAST(sample_id AS STRING)) AS sample, gc, n_windows * 2.0 AS nb_n, 0.25 AS nb_p FROM ({_DEPTH})", "win_depth")
def s14_depth_table(spark, d) -> DataFrame:
    """Written with its header of parameters, read for one copy of two."""
    path = sc.scratch_path(spark, "depth")
    tx.write_depth(_depth_rows(spark, d), path, {"ploidy": 2, "window size": 100})
    return tx.read_depth(spark, path).withColumn("gc", F.col("gc").cast("bigint"))


@query(f"SELECT concat('s', CAST(sample_id AS STRING)) AS sample, count(*) AS bins, CAST(sum(n_windows) * 2 AS DOUBLE) AS total FROM ({_DEPTH}) WHERE sample_id < 9 GROUP BY 1", "win_depth")
def s15_merged_depths(spark, d) -> DataFrame:
    """Two files with half of the samples each, of which nine are asked for."""
    rows = _depth_rows(spark, d)
    paths = [sc.scratch_path(spark, "depth") for _ in range(2)]
    for k, path in enumerate(paths):
        tx.write_depth(rows.filter(F.col("sample") < "s5" if k else F.col("sample") >= "s5"), path, {"ploidy": 2, "window size": 100, "file": k})
    gc = rows.agg(F.min("gc_content").alias("a")).first()["a"]
    merged = tx.merge_depths(spark, paths, rows.filter("sample < 's9'").select("sample").distinct(), (gc, gc + 1))
    return merged.groupBy("sample").agg(F.count(F.lit(1)).alias("bins"), F.sum("nb_n").alias("total"))


@query(f"""WITH r AS ({_DEPTH}) SELECT 'samples' AS key, CAST(count(DISTINCT sample_id) AS STRING) AS value FROM r UNION ALL SELECT 'windows', CAST(CAST(sum(n_windows) AS BIGINT) AS STRING) FROM r UNION ALL SELECT 'GC range', concat(CAST(min(gc) AS STRING), '-', CAST(max(gc) AS STRING)) FROM r
    UNION ALL SELECT concat('lines of s', CAST(sample_id AS STRING)), CAST(count(*) * 2 AS STRING) FROM r GROUP BY sample_id""", "win_depth")
def s16_depth_header(spark, d) -> DataFrame:
    """A depth table's parameters, which say what it was made of, and its lines by sample, from the text as it was written."""
    rows, path = _depth_rows(spark, d), sc.scratch_path(spark, "depth")
    made = rows.agg(F.count_distinct("sample").alias("samples"), (F.sum("n_windows") / 2).cast("bigint").alias("windows"), F.concat_ws("-", F.min("gc_content").cast("string"), F.max("gc_content").cast("string")).alias("range")).first()
    tx.write_depth(rows, path, {"samples": made["samples"], "windows": made["windows"], "GC range": made["range"]})
    lines = spark.read.text(path)
    head = lines.filter("value like '# %'").select(F.regexp_extract("value", "^# ([^:]+): ", 1).alias("key"), F.regexp_extract("value", "^# [^:]+: (.*)$", 1).alias("value"))
    own = lines.filter("value not like '#%' and value not like 'sample%'").groupBy(F.split("value", "\t")[0].alias("sample")).agg(F.count(F.lit(1)).alias("n"))
    return head.unionByName(own.select(F.concat(F.lit("lines of "), "sample").alias("key"), F.col("n").cast("string").alias("value")))


def _model(spark, d) -> DataFrame:
    """Entries of a model: a locus for each contig of iv_b, a window and a PSV for each interval."""
    b = view(spark, d, "iv_b").withColumn("locus", F.concat(F.lit("locus"), F.col("chrom_id").cast("string"))).withColumn("chrom", F.concat(F.lit("chr"), F.col("chrom_id").cast("string")))
    copy = F.struct(F.concat(F.lit("chr"), ((F.col("chrom_id") + 1) % 100).cast("string")).alias("chrom"), (F.col("s") + 5).alias("s"), (F.col("e") + 5).alias("e"), (F.col("b_id") % 2 == 0).alias("forward"))
    b = b.withColumn("regions2", F.when(F.col("b_id") % 3 == 0, F.array(copy, copy)).otherwise(F.array(copy)))
    windows = b.select("locus", F.col("b_id").alias("window_ix"), "chrom", "s", "e", "regions2", (F.col("b_id") % 60).alias("gc"), ((F.col("b_id") % 16 + 8) / 16).alias("multiplier"), (F.col("b_id") % 7 != 0).alias("in_hmm"))
    psvs = b.select("locus", "chrom", "s", (F.col("s") + 1).alias("e"), "regions2", F.array((F.col("b_id") % 4 / 4).cast("double"), F.when(F.col("b_id") % 5 != 0, (F.col("b_id") % 8 / 8).cast("double"))).alias("fvalues"), (F.col("b_id") % 2 == 1).alias("reliable"))
    info = F.create_map(F.lit("version"), F.lit("1"), F.lit("n_samples"), F.lit("10"))
    main = b.groupBy("locus", "chrom").agg(F.min("s").alias("s"), F.max("e").alias("e")).select(F.lit("main").alias("kind"), "locus", "chrom", "s", "e", F.lit(None).cast("array<struct<chrom:string,s:bigint,e:bigint,forward:boolean>>").alias("regions2"), info.alias("info"))
    return main.unionByName(md.window_entries(windows)).unionByName(md.psv_entries(psvs))


@query("SELECT concat('locus', CAST(chrom_id AS STRING)) AS locus, b_id AS window_ix, s, e, CAST(b_id % 60 AS BIGINT) AS gc, (b_id % 16 + 8) / 16.0 AS multiplier, b_id % 7 <> 0 AS in_hmm FROM iv_b", "iv_b")
def s17_model_windows(spark, d) -> DataFrame:
    """A model written as text, a folder a locus, and its windows as a run reads them."""
    path = sc.scratch_path(spark, "model")
    md.write_model(_model(spark, d), path)
    return md.model_windows(md.read_model(spark, path))


@query("SELECT concat('locus', CAST(chrom_id AS STRING)) AS locus, s, s + 1 AS e, round(b_id % 4 / 4.0, 6) AS f1, CASE WHEN b_id % 5 <> 0 THEN round(b_id % 8 / 8.0, 6) ELSE -1 END AS f2, b_id % 2 = 1 AS reliable FROM iv_b", "iv_b")
def j14_model_psvs(spark, d) -> DataFrame:
    """The PSVs of a model with their f-values, unknown ones as null."""
    path = sc.scratch_path(spark, "model")
    md.write_model(_model(spark, d), path)
    return md.model_psvs(md.read_model(spark, path)).select("locus", "s", "e", F.get("fvalues", F.lit(0)).alias("f1"), F.coalesce(F.get("fvalues", F.lit(1)), F.lit(-1.0)).alias("f2"), "reliable")


@query("""SELECT b_id, concat('chr', CAST((chrom_id + 1) % 100 AS STRING), ':', CAST(s + 6 AS STRING), '-', CAST(e + 5 AS STRING), CASE WHEN b_id % 2 = 0 THEN ':+' ELSE ':-' END) AS text, s + 5 AS back FROM iv_b""", "iv_b")
def x11_copies_as_text(spark, d) -> DataFrame:
    copy = F.struct(F.concat(F.lit("chr"), ((F.col("chrom_id") + 1) % 100).cast("string")).alias("chrom"), (F.col("s") + 5).alias("s"), (F.col("e") + 5).alias("e"), (F.col("b_id") % 2 == 0).alias("forward"))
    text = view(spark, d, "iv_b").select("b_id", md.regions2_text(F.array(copy)).alias("text"))
    return text.withColumn("back", F.get(md.parse_regions2(F.col("text")), F.lit(0))["s"])


@query("""SELECT concat('chr', CAST(chrom_id AS STRING)) AS chrom, s, CASE WHEN b_id % 4 = 0 THEN 26500 ELSE e END AS e, concat('u', CAST(b_id % 3 AS STRING)) AS sample, CAST(b_id % 7 AS BIGINT) AS cn FROM iv_b WHERE b_id % 2 = 1 AND chrom_id IN (SELECT chrom_id FROM contigs)
    UNION ALL SELECT concat('chr', CAST(chrom_id AS STRING)), s, CASE WHEN b_id % 4 = 0 THEN 26500 ELSE e END, concat('u', CAST(k AS STRING)), CAST(b_id % 7 AS BIGINT) FROM iv_b, (VALUES (0), (1), (2)) t(k) WHERE b_id % 2 = 0 AND chrom_id IN (SELECT chrom_id FROM contigs)""", "iv_b", "contigs")
def s18_copy_numbers_by_hand(spark, d) -> DataFrame:
    """A line for each interval: `inf` for the contig's end, `*` for all samples."""
    line = "concat_ws('\\t', concat('chr', chrom_id), s, if(b_id % 4 = 0, 'inf', string(e)), if(b_id % 2 = 0, '*', concat('u', b_id % 3)), b_id % 7)"
    contigs = view(spark, d, "contigs").select(F.concat(F.lit("chr"), F.col("chrom_id").cast("string")).alias("name"), "length")
    samples = spark.createDataFrame([("u0",), ("u1",), ("u2",)], "sample string")
    return tx.read_overrides(spark, _text(view(spark, d, "iv_b"), line, "overrides"), contigs, samples).withColumn("cn", F.col("cn").cast("bigint"))


@query("SELECT concat('chr', CAST(psv_ix % 5 AS STRING)) AS chrom, psv_ix AS start, 'ACG' AS alleles, round(n0 / 8.0, 2) AS qual, CAST(n1 AS STRING) AS info_n, concat(CAST(n0 % 2 AS STRING), '/', CAST(n1 % 3 AS STRING)) AS gt FROM allele_counts", "allele_counts")
def s19_vcf_round_trip(spark, d) -> DataFrame:
    a = view(spark, d, "allele_counts")
    rows = a.select(
        F.concat(F.lit("chr"), (F.col("psv_ix") % 5).cast("string")).alias("chrom"), F.col("psv_ix").alias("start"), F.array(F.lit("A"), F.lit("C"), F.lit("G")).alias("alleles"), F.round(F.col("n0") / 8, 2).alias("qual"),
        F.lit("PASS").alias("filter"), F.concat(F.lit("n="), F.col("n1").cast("string")).alias("info"), F.lit("GT").alias("format"), F.concat_ws("/", (F.col("n0") % 2).cast("string"), (F.col("n1") % 3).cast("string")).alias("one"),
    )
    path = sc.scratch_path(spark, "vcf")
    tx.write_vcf(rows, path, ["one"], ["##fileformat=VCFv4.2"])
    v = tx.read_vcf(spark, path)
    return v.select("chrom", "start", F.array_join("alleles", "").alias("alleles"), "qual", F.col("info")["n"].alias("info_n"), F.get("samples", F.lit(0))["GT"].alias("gt"))


@query("SELECT concat('chr', CAST(chrom_id AS STRING)) AS chrom, s, e, CAST(b_id AS STRING) AS name FROM iv_b", "iv_b")
def s20_bed_round_trip(spark, d) -> DataFrame:
    path = sc.scratch_path(spark, "bed")
    tx.write_bed(view(spark, d, "iv_b").select(F.concat(F.lit("chr"), F.col("chrom_id").cast("string")).alias("chrom"), "s", "e", "b_id"), path, ("chrom", "s", "e", "b_id"))
    return tx.read_bed(spark, path, ("name",))


@query("SELECT chrom_id AS component, CAST(row_number() OVER (PARTITION BY chrom_id ORDER BY b_id) AS BIGINT) AS line, concat(CAST(b_id AS STRING), ' -> ', CAST(b_id + 1 AS STRING), ';') AS value FROM iv_b", "iv_b")
def s30_graph_lines(spark, d) -> DataFrame:
    edges = view(spark, d, "iv_b").select(F.col("chrom_id").alias("component"), F.col("b_id").alias("id1"), (F.col("b_id") + 1).alias("id2"))
    return tx.dot_lines(edges).withColumn("line", F.col("line").cast("bigint"))


@query("""SELECT psv_ix AS locus, sample_id AS row_ix, 'c2' AS chrom2, CAST(100 + psv_ix + k AS BIGINT) AS pos2, CAST(psv_ix AS DOUBLE) + round(k / (1.0 + n0 % 3), 2) AS pos1, CASE WHEN k = 0 THEN 'A' END AS base1, substr('ACG', CAST(k + 1 AS INTEGER), 1) AS base2
    FROM (SELECT *, unnest(range(0, 1 + n0 % 3)) AS k FROM allele_counts WHERE n1 % 4 > 0) UNION ALL SELECT psv_ix, sample_id, NULL, -1, CAST(psv_ix AS DOUBLE), 'A', NULL FROM allele_counts WHERE n1 % 4 = 0""", "allele_counts")
def s31_position_rows(spark, d) -> DataFrame:
    """Each base of copy 2 beside copy 1: one to three letters at a place, or a gap."""
    a = view(spark, d, "allele_counts")
    cells = a.select(F.col("psv_ix").alias("locus"), F.col("sample_id").alias("row_ix"), F.lit("c1").alias("chrom1"), F.col("psv_ix").cast("double").alias("pos1"), F.lit("A").alias("base1"), F.lit("c2").alias("chrom2"), (F.col("psv_ix") + 100).alias("pos2"),
                     F.when(F.col("n1") % 4 == 0, "-").otherwise(F.expr("substring('ACG', 1, int(1 + n0 % 3))")).alias("text"))
    return tx.position_rows(cells).drop("chrom1").withColumn("pos2", F.coalesce("pos2", F.lit(-1)))


@query("""WITH l AS (SELECT psv_ix AS locus, sample_id AS row_ix, string_agg(CASE WHEN (n0 + k) % 3 = 0 THEN 'G' ELSE 'A' END, '' ORDER BY k) AS line FROM (SELECT *, unnest(range(0, 70)) AS k FROM allele_counts) GROUP BY 1, 2)
    SELECT locus, b AS block, row_ix, concat(rpad(concat('s', CAST(row_ix AS STRING)), 3, ' '), '  ', substr(line, CAST(b * 60 + 1 AS INTEGER), 60)) AS value FROM (SELECT *, unnest(range(0, 2)) AS b FROM l)""", "allele_counts")
def s31_clustal_blocks(spark, d) -> DataFrame:
    """Alignments of 70 columns in blocks of 60, the line of marks left out here."""
    a = view(spark, d, "allele_counts").select(F.col("psv_ix").alias("locus"), F.col("sample_id").alias("row_ix"), F.explode(F.sequence(F.lit(0), F.lit(69))).alias("pos"), "n0")
    columns = a.select("locus", "row_ix", "pos", F.when((F.col("n0") + F.col("pos")) % 3 == 0, "G").otherwise("A").alias("text"))
    names = a.select("locus", "row_ix", F.rpad(F.concat(F.lit("s"), F.col("row_ix").cast("string")), 3, F.lit(" ")).alias("name")).distinct()
    blocks = tx.clustal_blocks(hm.multiple_alignment(columns, "locus"), names)
    return blocks.filter(f"row_ix < {1 << 30}").select("locus", F.col("block").cast("bigint").alias("block"), "row_ix", "value")


@query("SELECT 0 AS ord, '@SQ\tSN:chr1\tLN:1000' AS value UNION ALL SELECT 2, '@CO\tmax_mate_dist=500' UNION ALL SELECT 1, concat('@RG\tID:', n_nationkey, '\tSM:', n_name) FROM nation")
def s32_pooled_header(spark, d) -> DataFrame:
    groups = view(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("rg"), F.col("n_name").alias("sample"))
    return tx.pooled_header("chr1", 1000, groups, 500)


@query("SELECT chrom_id, s, e, b_id FROM iv_b WHERE EXISTS (SELECT 1 FROM contigs c WHERE c.chrom_id = iv_b.chrom_id AND iv_b.s < 13000 AND 12000 < iv_b.e)", "iv_b", "contigs")
def s36_limit_regions(spark, d) -> DataFrame:
    """Intervals that a BED of regions to limit a run to touches: the same stretch of each contig, in two overlapping lines."""
    lines = view(spark, d, "contigs").withColumn("k", F.explode(F.array(F.lit(0), F.lit(500))))
    bed = tx.read_bed(spark, _text(lines, "concat_ws('\\t', chrom_id, 12000 + k, 12500 + k)", "limit")).select(F.col("chrom").cast("bigint").alias("chrom_id"), "s", "e")
    return iv.overlap_semi(view(spark, d, "iv_b"), iv.merge_overlapping(bed).drop("n"), ["b_id"]).select("chrom_id", "s", "e", "b_id")


@query("SELECT concat('chr', CAST(chrom_id AS STRING)) AS chrom, s, e, CAST(b_id % 20 AS STRING) AS sample, CASE WHEN b_id % 9 > 0 THEN CAST(b_id % 9 AS STRING) END AS cn FROM iv_b", "iv_b")
def s35_copy_number_profile(spark, d) -> DataFrame:
    """Named columns of a BED; `*` is null."""
    line = "concat_ws('\\t', concat('chr', chrom_id), s, e, b_id % 20, if(b_id % 9 > 0, string(b_id % 9), '*'))"
    return tx.read_bed(spark, _text(view(spark, d, "iv_b"), line, "profile"), ("sample", "cn"))

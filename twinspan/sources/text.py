"""Text formats as DataFrames: FASTA, BED, homology tables, SAM, VCF, depth tables and lists, and their writers.

Readers split lines with built-in functions, so a file is read by as many tasks as it has splits; gzip files by
one task each, as that codec can't be split. Writers give one folder of part files, sorted where order matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import parse_info
from ..operators.intervals import parse_region
from .scratch import exists

HOMOLOGY = ("chrom1", "start1", "end1", "strand", "chrom2", "start2", "end2", "info")
SAM = ("name", "flag", "chrom", "pos", "mapq", "cigar", "mate_chrom", "mate_pos", "tlen", "seq", "qual")
# Other names of the genomes whose window sets are known.
GENOMES = {"hg19": "grch37", "grch37": "grch37", "hg38": "grch38", "grch38": "grch38"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _columns(lines: DataFrame, n: int) -> tuple[DataFrame, list[Column]]:
    split = lines.withColumn("_f", F.split("value", "\t"))
    none = lambda c: F.nullif(c, F.lit("*"))
    return split, [none(F.get("_f", F.lit(i))) for i in range(n)]


def read_fasta(spark: SparkSession, path: str, width: int = 10_000) -> DataFrame:
    """(chrom, chunk, seq): upper-case chunks of one width. Records are told apart by splitting at `>`, so a record
    is one row before it is cut: contigs of up to 2 GB, as a string is."""
    records = spark.read.option("lineSep", ">").text(path).filter("trim(value) <> ''")
    name = F.regexp_extract("value", r"^(\S+)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", ""))
    whole = records.select(name.alias("chrom"), seq.alias("seq"))
    n = F.floor((F.length("seq") + width - 1) / width).cast("int")
    cut = whole.filter("length(seq) > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    return cut.select("chrom", "chunk", F.substring("seq", F.col("chunk") * width + 1, F.lit(width)).alias("seq"))


def fetch(chunks: DataFrame, regions: DataFrame, width: int = 10_000) -> DataFrame:
    """Sequences of regions (region_id, chrom, s, e): an equi join on the chunks that each touches."""
    wanted = regions.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("s") / width).cast("int"), F.floor((F.col("e") - 1) / width).cast("int"))))
    parts = wanted.join(chunks, ["chrom", "chunk"]).withColumn("_from", F.greatest(F.lit(0), F.col("s") - F.col("chunk") * width))
    piece = F.substring("seq", (F.col("_from") + 1).cast("int"), (F.least(F.lit(width), F.col("e") - F.col("chunk") * width) - F.col("_from")).cast("int"))
    joined = parts.groupBy("region_id", "chrom", "s", "e").agg(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("p")))).alias("_p"))
    return joined.select("region_id", "chrom", "s", "e", F.array_join(F.transform("_p", lambda x: x["p"]), "").alias("seq"))


def merge_sequences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Chunks of two genomes as one. A contig that both have must have the same length in both; its chunks are taken from a."""
    sizes = lambda x, n: x.groupBy("chrom").agg(F.sum(F.length("seq")).alias(n))
    both = sizes(a, "na").join(sizes(b, "nb"), "chrom")
    wrong = both.filter("na <> nb").select(F.array_sort(F.collect_list("chrom")).alias("c")).first()["c"]  # names of contigs
    if wrong:
        raise ValueError(f"contigs of different length in the two genomes: {', '.join(wrong[:10])}")
    return a.unionByName(b.join(both.select("chrom"), "chrom", "left_anti"))


def contigs_of_header(spark: SparkSession, path: str) -> DataFrame:
    """(chrom_id, name, length) of a `# Chromosomes: name:length, ...` line."""
    head = _lines(spark, path).filter("value rlike '^# *Chromosomes:'").select(F.posexplode(F.split(F.regexp_replace("value", r"^# *Chromosomes:\s*", ""), r",\s*")).alias("chrom_id", "v"))
    return head.select("chrom_id", F.substring_index("v", ":", 1).alias("name"), F.substring_index("v", ":", -1).cast("bigint").alias("length"))


def read_bed(spark: SparkSession, path: str, names: tuple[str, ...] = ()) -> DataFrame:
    """chrom, s, e and further named columns; comments and blank lines are skipped."""
    rows, c = _columns(_lines(spark, path).filter("value <> '' and not startswith(value, '#')"), 3 + len(names))
    return rows.select(c[0].alias("chrom"), c[1].try_cast("bigint").alias("s"), c[2].try_cast("bigint").alias("e"), *(x.alias(n) for x, n in zip(c[3:], names)))


def write_bed(df: DataFrame, path: str, columns: tuple[str, ...], order: tuple[str, ...] = ("chrom", "s", "e")) -> None:
    """Tab-separated, range-partitioned and sorted, so that the part files in order are the sorted table."""
    text = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in columns))
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(text.alias("value")).write.mode("overwrite").text(path)


def read_homology(spark: SparkSession, path: str) -> DataFrame:
    """Homology rows with info as text and as the map m; rows without a second region are tangled."""
    rows, c = _columns(_lines(spark, path).filter("value <> '' and not startswith(value, '#')"), 8)
    typed = [x.try_cast("bigint") if n[:-1] in ("start", "end") else x for x, n in zip(c, HOMOLOGY)]
    out = rows.select(*(x.alias(n) for x, n in zip(typed, HOMOLOGY)))
    return out.withColumn("is_tangled", F.col("chrom2").isNull()).withColumn("m", parse_info(F.coalesce("info", F.lit(""))))


def write_homology(df: DataFrame, path: str) -> None:
    write_bed(df, path, HOMOLOGY, ("chrom1", "start1", "end1"))


def pretty_homology(df: DataFrame) -> DataFrame:
    """Rows for reading: thousands separators and the info keys one by one."""
    place = lambda c, s, e: F.concat(F.col(c), F.lit(":"), F.format_number(F.col(s) + 1, 0), F.lit("-"), F.format_number(e, 0))
    return df.select(place("chrom1", "start1", "end1").alias("region1"), "strand", place("chrom2", "start2", "end2").alias("region2"), F.replace(F.col("info"), F.lit(";"), F.lit("; ")).alias("info"))


def read_regions(texts: DataFrame, contigs: DataFrame, column: str = "region") -> DataFrame:
    """`chrom`, `chrom:s-e`, each with `::name`: trimmed to the contig (name, length), which `trimmed` tells; unknown contigs and
    regions behind a contig's end are left out."""
    named = texts.withColumn("name", F.when(F.instr(column, "::") > 0, F.substring_index(column, "::", -1)).otherwise(F.col(column))).withColumn("_r", parse_region(F.substring_index(column, "::", 1)))
    joined = named.join(contigs.select(F.col("name").alias("_c"), "length"), F.col("_r.chrom") == F.col("_c"))
    return joined.select(F.col("_r.chrom").alias("chrom"), F.coalesce("_r.start", F.lit(0)).alias("s"), F.least(F.coalesce("_r.end", "length"), F.col("length")).alias("e"), "name", F.coalesce(F.col("_r.end") > F.col("length"), F.lit(False)).alias("trimmed")).filter("s < e").dropDuplicates(["name"])


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines: 0-based positions, qualities as an array, tags as a map."""
    rows, _ = _columns(_lines(spark, path).filter("value <> '' and not startswith(value, '@')"), 0)
    f = lambda i: F.get("_f", F.lit(i))
    integers = {"flag", "pos", "mapq", "mate_pos", "tlen"}
    base = {n: (f(i).try_cast("bigint") if n in integers else F.nullif(f(i), F.lit("*"))) for i, n in enumerate(SAM)}
    base["pos"], base["mate_pos"] = base["pos"] - 1, base["mate_pos"] - 1
    base["mate_chrom"] = F.when(f(6) == "=", f(2)).otherwise(F.nullif(f(6), F.lit("*")))
    base["qual"] = F.transform(F.split(F.nullif(f(10), F.lit("*")), ""), lambda q: F.ascii(q) - 33)
    tags = F.slice("_f", 12, F.greatest(F.size("_f") - 11, F.lit(0)))
    as_map = F.map_from_entries(F.transform(F.filter(tags, lambda t: t.rlike("^[^:]+:[^:]:")), lambda t: F.struct(F.substring_index(t, ":", 1).alias("k"), F.regexp_extract(t, "^[^:]*:[^:]*:(.*)$", 1).alias("v"))))
    return rows.select(*(x.alias(n) for n, x in base.items()), as_map.alias("tags"))


def read_groups(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """(rg, sample) of a SAM header; a given sample is put over the header's."""
    head = _lines(spark, path).filter("startswith(value, '@RG')")
    tag = lambda k: F.nullif(F.regexp_extract("value", rf"\t{k}:([^\t]*)", 1), F.lit(""))
    return head.select(tag("ID").alias("rg"), (F.lit(sample) if sample else tag("SM")).alias("sample"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Long form: one row a variant, with alleles, info as a map and samples as an array of (format key, value) maps."""
    rows = _lines(spark, path).filter("value <> '' and not startswith(value, '#')").withColumn("_f", F.split("value", "\t"))
    f = lambda i: F.get("_f", F.lit(i))
    keys = F.split(f(8), ":")
    alts = F.when(f(4) == ".", F.array().cast("array<string>")).otherwise(F.split(f(4), ","))
    samples = F.transform(F.slice("_f", 10, F.greatest(F.size("_f") - 9, F.lit(0))), lambda x: F.map_from_entries(F.zip_with(keys, F.split(x, ":"), lambda k, v: F.struct(k.alias("k"), v.alias("v")))))
    return rows.select(
        f(0).alias("chrom"), (f(1).cast("bigint") - 1).alias("start"), F.nullif(f(2), F.lit(".")).alias("id"), F.concat(F.array(f(3)), alts).alias("alleles"),
        f(5).try_cast("double").alias("qual"), F.split(f(6), ";").alias("filter"), parse_info(f(7)).alias("info"), samples.alias("samples"),
    )


def vcf_lines(df: DataFrame, samples: list[str], header: list[str] = ()) -> DataFrame:
    """(ord, value) lines of a wide table chrom, start, alleles, qual, filter, info (text), format, sample columns."""
    spark = df.sparkSession
    head = [*header, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]
    top = spark.createDataFrame([(i - len(head), "", -1, h) for i, h in enumerate(head)], "ord int, chrom string, start bigint, value string")
    alt = F.when(F.size("alleles") > 1, F.array_join(F.slice("alleles", 2, 1000), ",")).otherwise(".")
    line = F.concat_ws("\t", "chrom", (F.col("start") + 1).cast("string"), F.lit("."), F.get("alleles", F.lit(0)), alt, F.coalesce(F.round("qual", 2).cast("string"), F.lit(".")), "filter", "info", "format", *samples)
    return top.unionByName(df.select(F.lit(0).alias("ord"), "chrom", "start", line.alias("value"))).orderBy("ord", "chrom", "start")


def write_vcf(df: DataFrame, path: str, samples: list[str], header: list[str] = ()) -> None:
    """vcf_lines() as text: the part files in order are the sorted file, its header first."""
    vcf_lines(df, samples, header).select("value").write.mode("overwrite").text(path)


def read_depth(spark: SparkSession, path: str, ploidy: int = 2) -> DataFrame:
    """Background rows of the first read end: sample, gc, nb_n of one copy, nb_p."""
    rows = spark.read.csv(path, sep="\t", header=True, comment="#", inferSchema=False)
    return rows.filter("read_end = '1'").select("sample", F.col("gc_content").cast("int").alias("gc"), (F.col("nbinom_n").cast("double") / ploidy).alias("nb_n"), F.col("nbinom_p").cast("double").alias("nb_p"))


def depth_header(spark: SparkSession, path: str) -> dict[str, str]:
    """The `# key: value` lines of a depth table: its parameters, a few."""
    lines = _lines(spark, path).filter("value rlike '^# [^:]+:'").select(F.regexp_extract("value", "^# ([^:]+):", 1).alias("k"), F.trim(F.regexp_extract("value", "^# [^:]+:(.*)$", 1)).alias("v"))
    return {r["k"]: r["v"] for r in lines.collect()}


DEPTH_COLUMNS = ("sample", "gc_content", "read_end", "n_windows", "mean", "var", "nbinom_n", "nbinom_p")


def write_depth(df: DataFrame, path: str, parameters: dict[str, object]) -> None:
    """A depth table with its parameters as `# key: value` lines and its header line first; rows by sample, GC and read end."""
    spark = df.sparkSession
    head = [*(f"# {k}: {v}" for k, v in parameters.items()), "\t".join(DEPTH_COLUMNS)]
    top = spark.createDataFrame([(i - len(head), "", 0, "", x) for i, x in enumerate(head)], "ord int, sample string, gc_content int, read_end string, value string")
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in DEPTH_COLUMNS))
    rows = df.select(F.lit(0).alias("ord"), F.col("sample").cast("string").alias("sample"), F.col("gc_content").cast("int").alias("gc_content"), F.col("read_end").cast("string").alias("read_end"), line.alias("value"))
    top.unionByName(rows).orderBy("ord", "sample", "gc_content", "read_end").select("value").write.mode("overwrite").text(path)


def merge_depths(spark: SparkSession, paths: list[str], samples: DataFrame, gc_range: tuple[int, int], same: tuple[str, ...] = ("window size", "ploidy"), ploidy: int = 2) -> DataFrame:
    """Depth tables of several files as one, for the samples asked for. An error where parameters in `same` differ, a sample
    comes twice, or a sample lacks a GC bin of the range (low, and one behind the high end)."""
    headers = [depth_header(spark, p) for p in paths]
    for p, h in zip(paths[1:], headers[1:]):
        if any(h.get(k) != headers[0].get(k) for k in same):
            raise ValueError(f"parameters of {paths[0]} and {p} differ")
    out = read_depth(spark, paths[0], ploidy)
    for p in paths[1:]:
        out = out.unionByName(read_depth(spark, p, ploidy))
    out = out.join(samples.select("sample").distinct(), "sample", "left_semi")
    if twice := [r["sample"] for r in duplicated_samples(out).orderBy("sample").limit(10).collect()]:
        raise ValueError(f"samples that come twice: {', '.join(twice)}")
    have = out.filter((F.col("gc") >= gc_range[0]) & (F.col("gc") < gc_range[1]) & ~F.isnan("nb_n") & ~F.isnan("nb_p")).groupBy("sample").agg(F.count_distinct("gc").alias("n"))
    short = samples.select("sample").distinct().join(have, "sample", "left").filter(F.coalesce("n", F.lit(0)) < gc_range[1] - gc_range[0])
    if lacking := [r["sample"] for r in short.orderBy("sample").limit(10).collect()]:
        raise ValueError(f"samples without values of all GC bins: {', '.join(lacking)}")
    return out


def duplicated_samples(depths: DataFrame) -> DataFrame:
    """Samples with more than one row of a GC bin; a merge of depth tables must give none."""
    return depths.groupBy("sample", "gc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("sample").distinct()


def read_overrides(spark: SparkSession, path: str, contigs: DataFrame, samples: DataFrame) -> DataFrame:
    """Copy numbers given by hand: (chrom, s, e, sample, cn); `inf` is the contig's end, `*` all samples."""
    rows, c = _columns(_lines(spark, path).filter("value <> '' and not startswith(value, '#')"), 5)
    names = F.get("_f", F.lit(3))
    typed = rows.select(c[0].alias("chrom"), c[1].cast("bigint").alias("s"), F.get("_f", F.lit(2)).alias("_e"), names.alias("_n"), c[4].cast("int").alias("cn"))
    ends = typed.join(contigs.select(F.col("name").alias("chrom"), "length"), "chrom").withColumn("e", F.when(F.col("_e") == "inf", F.col("length")).otherwise(F.col("_e").try_cast("bigint")))
    some = ends.filter("_n <> '*'").withColumn("sample", F.explode(F.split("_n", ",")))
    every = ends.filter("_n = '*'").join(samples.select("sample"), F.lit(True))  # a few lines of a hand-written file
    return some.select("chrom", "s", "e", "sample", "cn").unionByName(every.select("chrom", "s", "e", "sample", "cn"))


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """(file, sample) of lines `file sample` or `file::sample`."""
    lines = _lines(spark, path).filter("trim(value) <> '' and not startswith(value, '#')").withColumn("_p", F.split(F.regexp_replace(F.trim("value"), "::", " "), r"\s+"))
    return lines.select(F.get("_p", F.lit(0)).alias("file"), F.get("_p", F.lit(1)).alias("sample"))


def select_files(files: DataFrame, contigs: DataFrame, genome: DataFrame, vmr: DataFrame | None = None, most: float | None = None) -> DataFrame:
    """files: file, sample; contigs: file, name, length of each file's header; genome: name, length. Files whose samples have a
    variance-to-mean ratio (vmr: sample, ratio) of at most `most`, and `fault`: how many of the genome's contigs a
    file lacks or has with another length. A file with faults must not be read."""
    kept = files if vmr is None else files.join(vmr.filter(F.col("ratio") <= most).select("sample").distinct(), "sample", "left_semi")
    n = genome.agg(F.count(F.lit(1)).alias("n"))
    right = contigs.join(genome, ["name", "length"]).groupBy("file").agg(F.count_distinct("name").alias("right"))
    return kept.join(right, "file", "left").join(F.broadcast(n)).select("file", "sample", (F.col("n") - F.coalesce("right", F.lit(0))).alias("fault"))


def pooled_header(contig: str, length: int, groups: DataFrame, max_mate_distance: int) -> DataFrame:
    """(ord, value) header lines of pooled reads: the contig, each read group (rg, sample) and the mate distance as a comment."""
    spark = groups.sparkSession
    ends = spark.createDataFrame([(0, f"@SQ\tSN:{contig}\tLN:{length}"), (2, f"@CO\tmax_mate_dist={max_mate_distance}")], "ord int, value string")
    return ends.unionByName(groups.select(F.lit(1).alias("ord"), F.concat(F.lit("@RG\tID:"), "rg", F.lit("\tSM:"), "sample").alias("value")))


def pooled_files(spark: SparkSession, prefix: str, n: int | None = None) -> list[str] | None:
    """Files of pooled reads: `prefix.bam` or `prefix.cram` with its index, or the numbered ones in the folder `prefix` if it
    holds `success`, `n` of them or as far as they go. None where there is no such set."""
    indexed = lambda base: next((f"{base}.{k}" for k, ix in (("cram", "crai"), ("bam", "bai")) if exists(spark, f"{base}.{k}") and exists(spark, f"{base}.{k}.{ix}")), None)
    if one := indexed(prefix):
        return [one]
    if not exists(spark, f"{prefix}/success"):
        return None
    out: list[str] = []
    while n is None or len(out) < n:
        name = indexed(f"{prefix}/{len(out)}")
        if name is None:
            return out if n is None and out else None
        out.append(name)
    return out


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as a tab-separated folder with a header line, for looking into a run."""
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{folder}/{name}", sep="\t", header=True)


def position_rows(columns: DataFrame) -> DataFrame:
    """columns: locus, row_ix, chrom1, pos1, base1, chrom2, pos2, text (what stands there in copy 2: bases, or `-`). One row a
    base: chrom2, pos2, chrom1, pos1, base1, base2; a deleted base has nulls for copy 2, an inserted one a place between two
    of copy 1 and no base there."""
    size = F.length("text")
    cells = columns.withColumn("_k", F.explode(F.sequence(F.lit(0), size - 1)))
    gone = F.col("text") == "-"
    return cells.select(
        "locus", "row_ix", F.when(~gone, F.col("chrom2")).alias("chrom2"), F.when(~gone, F.abs(F.col("pos2") + F.col("_k"))).alias("pos2"), "chrom1",
        F.round(F.col("pos1") + F.col("_k") / size, 2).alias("pos1"), F.when(F.col("_k") == 0, F.col("base1")).alias("base1"), F.when(~gone, F.expr("substring(text, _k + 1, 1)")).alias("base2"),
    )


def clustal_blocks(lines: DataFrame, names: DataFrame, width: int = 60) -> DataFrame:
    """lines: locus, row_ix, line (of homology.multiple_alignment, -1 the marks); names: locus, row_ix, name. (locus, block, row_ix,
    value): each block the names, padded to the longest, and `width` columns of every row, the marks last."""
    named = lines.join(names, ["locus", "row_ix"], "left").withColumn("name", F.coalesce("name", F.lit("")))
    widest = named.groupBy("locus").agg(F.max(F.length("name")).alias("_w"))
    cut = named.join(widest, "locus").withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.length("line") - 1) / width).cast("int"))))
    row = F.when(F.col("row_ix") < 0, F.lit(1 << 30)).otherwise(F.col("row_ix"))
    return cut.select("locus", "block", row.cast("bigint").alias("row_ix"), F.concat(F.rpad("name", F.col("_w"), F.lit(" ")), F.lit("  "), F.expr(f"substring(line, block * {width} + 1, {width})")).alias("value"))


def background_windows(bed: DataFrame, sequences: DataFrame) -> DataFrame:
    """Windows (chrom, s, e) with their GC per cent; those with an N are left out. sequences: region_id, seq."""
    joined = bed.join(sequences, "region_id").filter(F.instr("seq", "N") == 0)
    return joined.withColumn("gc", F.floor(100 * (F.length("seq") - F.length(F.translate("seq", "GC", ""))) / F.length("seq"))).drop("seq")


def one_width(windows: DataFrame) -> bool:
    """Whether all windows have the same width; only that count comes to the driver."""
    return windows.select(F.count_distinct(F.col("e") - F.col("s"))).first()[0] <= 1


def genome_name(alias: str) -> str:
    if alias.lower() not in GENOMES:
        raise ValueError(f"unknown genome {alias!r}: {', '.join(sorted(GENOMES))}")
    return GENOMES[alias.lower()]


def dot_lines(edges: DataFrame) -> DataFrame:
    """Graphviz lines of each component's edges (component, id1, id2)."""
    w = Window.partitionBy("component").orderBy("id1", "id2")
    return edges.select("component", F.row_number().over(w).alias("line"), F.concat(F.col("id1").cast("string"), F.lit(" -> "), F.col("id2").cast("string"), F.lit(";")).alias("value"))

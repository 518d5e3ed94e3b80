"""The commands as functions from DataFrames to DataFrames, with the defaults that define what they compute.

Inputs are the tables of sources/text.py or of the same columns; nothing is written unless a sink is called.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.expressions import compile_expression
from .operators import alignment, calling, chain, cigars, copynumber, depth, haplotypes, homology, intervals, paralog, relational, segments, selfalign, variants
from .sources import models


@dataclass(frozen=True)
class TableConfig:
    min_aln_len: int = 250
    min_seq_sim: float = 0.96
    max_homologies: int = 10
    read_len: int = 900
    read_step: int = 150
    exclude: str = "length < 500 && seq_sim < 0.97"
    tangled: str = "sep < 5000 && av_mult > 2"


@dataclass(frozen=True)
class DepthConfig:
    window: int = 100
    low_mapq: float = 0.1
    clipped: float = 0.1
    unpaired: float = 0.1
    neighbours: int = 1
    loess_fraction: float = 0.2
    tail_windows: int = 1000
    ploidy: int = 2


@dataclass(frozen=True)
class CallConfig:
    error: float = 0.01
    base_quality: float = 10
    limit_pooled: float = 1e-5
    least_psv_quality: float = 20


def artificial_reads(sequences: DataFrame, config: TableConfig = TableConfig()) -> DataFrame:
    """Reads of a sequence database to be aligned against itself: region_id, start, seq."""
    reads = sequences.select("region_id", F.explode(cigars.sliding_reads(F.col("seq"), config.read_len, config.read_step, config.min_aln_len)).alias("r"))
    return reads.select("region_id", "r.start", "r.seq")


def self_hits(sequences: DataFrame, config: TableConfig = TableConfig(), most_places: int | None = None) -> DataFrame:
    """Where artificial reads of sequences (seq_id, seq) lie in them, as hits for pretable(): hit_id, chrom_id, s, e (of the
    read), strand, chrom2, s2, e2, similarity, cigar. Takes the place of an external aligner."""
    reads = artificial_reads(sequences.withColumnRenamed("seq_id", "region_id"), config)
    reads = reads.withColumn("read_id", F.xxhash64("region_id", "start"))
    found = selfalign.hits(reads.select(F.col("read_id").alias("seq_id"), "seq"), sequences, config.min_seq_sim, most_places=most_places)
    own = reads.select("read_id", F.col("region_id").cast("bigint").alias("chrom_id"), F.col("start").cast("bigint").alias("s"), (F.col("start") + F.length("seq")).cast("bigint").alias("e"))
    made = found.withColumnsRenamed({"seq_id": "chrom2", "s": "s2", "e": "e2"}).join(own, "read_id")
    return made.select(
        F.xxhash64("read_id", "chrom2", "s2", "forward").alias("hit_id"), "chrom_id", "s", "e", F.col("forward").cast("bigint").alias("strand"), "chrom2", "s2", "e2", "similarity", "cigar"
    )


def pretable(hits: DataFrame, config: TableConfig = TableConfig()) -> DataFrame:
    return homology.pretable(hits, config.max_homologies, config.min_aln_len, config.min_seq_sim)


def table(pretable_rows: DataFrame, id_col: str = "hit_id") -> DataFrame:
    """Overlapping duplications joined along their graph."""
    return homology.combine(pretable_rows, id_col)


def tangled(rows: DataFrame, config: TableConfig = TableConfig(), info: str = "info") -> DataFrame:
    return homology.mark_tangled(rows, compile_expression(config.tangled, info, as_text=True))


def view(rows: DataFrame, include: str | None = None, exclude: str | None = None, regions: DataFrame | None = None, skip_tangled: bool = False) -> DataFrame:
    return homology.view_table(rows, include, exclude, regions, skip_tangled)


def examine(rows: DataFrame, id_col: str = "hit_id") -> DataFrame:
    return homology.examine(rows, id_col)


def background_depth(reads: DataFrame, windows: DataFrame, config: DepthConfig = DepthConfig()) -> DataFrame:
    """reads -> window counts -> passing windows without failing neighbours -> the background model by sample and GC.
    windows: window_ix, gc."""
    counts = depth.window_counts(reads, config.window).join(windows, "window_ix")
    bad = counts.withColumn("_bad", ~relational.window_passes(config.low_mapq, config.clipped, config.unpaired))
    kept = bad.withColumn("_out", intervals.elementwise_neighbours(bad, ["sample_id"], "window_ix", "_bad", config.neighbours, config.window)).filter(~F.col("_out"))
    usable = depth.gc_range(kept, config.tail_windows).filter("usable").select("gc")
    model = depth.background(kept.join(usable, "gc", "left_semi"), "depth1", config.loess_fraction)
    return model.withColumn("nb_n", F.col("nb_n") / config.ploidy)


def copy_number(window_depths: DataFrame, config: copynumber.HmmConfig = copynumber.HmmConfig(), reference_cn: int = 4) -> DataFrame:
    """Aggregate copy numbers of each locus, sample and window."""
    return copynumber.copy_number_profiles(window_depths, config, ("locus",), reference_cn)


def copy_number_with_model(window_depths: DataFrame, entries: DataFrame, config: copynumber.HmmConfig = copynumber.HmmConfig(), reference_cn: int = 4) -> DataFrame:
    """The same with the windows of a model as sources.models.read_model() gives it; those that it keeps out of the chain
    are left out."""
    return copy_number_using(window_depths, models.model_windows(entries).filter("in_hmm"), config, reference_cn)


def copy_number_using(window_depths: DataFrame, multipliers: DataFrame, config: copynumber.HmmConfig = copynumber.HmmConfig(), reference_cn: int = 4) -> DataFrame:
    """The same with window multipliers of a given model: they go into the background, and nothing is fitted."""
    from dataclasses import replace

    scaled = window_depths.join(multipliers.select("locus", "window_ix", "multiplier"), ["locus", "window_ix"]).withColumn("nb_n", F.col("nb_n") * F.col("multiplier")).drop("multiplier")
    return copynumber.copy_number_profiles(scaled, replace(config, least_samples=1 << 30), ("locus",), reference_cn)


def paralog_segments(window_depths: DataFrame, psvs: DataFrame, forced: DataFrame | None = None, hmm: copynumber.HmmConfig = copynumber.HmmConfig(), config: segments.SegmentConfig = segments.SegmentConfig(), reference_cn: int = 4) -> DataFrame:
    """The whole of `cn`: runs of one aggregate number, forced by hand or refined by their variants, linked and split up over the
    copies. window_depths with region_ix, ws and we; see operators.segments."""
    return segments.paralog_segments(copynumber.segment_copy_numbers(window_depths, hmm, ("locus",), reference_cn), psvs, forced, config)


def pool_vcf(records: DataFrame, calls: DataFrame, copies: DataFrame, samples: DataFrame, limits: DataFrame | None = None, unphased_distance: int = 500) -> dict[str, DataFrame]:
    """Records of all copies on copy 1 by way of haplotypes, and the regions in which they hold: see operators.haplotypes."""
    return haplotypes.pool_variants(records, calls, copies, samples, limits, unphased_distance)


def paralog_copy_number(allele_counts: DataFrame) -> DataFrame:
    return paralog.paralog_copy_numbers(allele_counts)


def psvs(alignments: DataFrame) -> DataFrame:
    """alignments: locus, copy, cigar, ref, read. Records of the variants between copy 1 and the others."""
    rows = alignments.withColumn("_ops", cigars.parse_cigar(F.col("cigar")))
    found = cigars.differences(rows, "_ops", ["locus", "copy"]).join(alignments.select("locus", "copy", "ref", "read"), ["locus", "copy"])
    cut = lambda seq, s, e: F.substring(F.col(seq), (F.col(s) + 1).cast("int"), (F.col(e) - F.col(s)).cast("int"))
    return variants.combine_psvs(found.select("locus", "copy", F.col("ref_s").alias("s"), F.col("ref_e").alias("e"), cut("ref", "ref_s", "ref_e").alias("ref"), cut("read", "read_s", "read_e").alias("allele")))


def msa(columns: DataFrame) -> DataFrame:
    return homology.multiple_alignment(columns, "locus")


def pool(reads: DataFrame, copies: DataFrame) -> DataFrame:
    """reads: read_id, chrom_id, s, e, seq, start2 (place inside its copy); copies: chrom_id, s, e, copy1, copy2, cigar.
    Reads of the other copies put on copy 1: read_id, pos, cigar."""
    pairs = intervals.overlap_join(reads, copies, 1 << 14)

    @F.pandas_udf("struct<pos:bigint,cigar:string>")
    def moved(c2: pd.Series, c1: pd.Series, cigar: pd.Series, start: pd.Series, seq: pd.Series) -> pd.DataFrame:
        rows = [alignment.move_read(*x) or (None, None) for x in zip(c2, c1, cigar, start.astype(int), seq)]
        return pd.DataFrame(rows, columns=["pos", "cigar"]).astype({"pos": "Int64"})

    return pairs.withColumn("_m", moved("b_copy2", "b_copy1", "b_cigar", "start2", "seq")).filter("_m.pos is not null").select("read_id", F.col("_m.pos").alias("pos"), F.col("_m.cigar").alias("cigar"))


def call(observations: DataFrame, copies: int, n_alleles: int, config: CallConfig = CallConfig()) -> DataFrame:
    """observations: variant_id, sample_id, read_id, allele_ix, is_snp, ln_qual. Pooled genotypes with AN, AC, AF."""
    good = calling.quality_filter(observations, config.base_quality, config.base_quality)
    counts = good.groupBy("variant_id", "sample_id", "allele_ix").agg(F.count(F.lit(1)).alias("n"))
    return calling.pooled_genotypes(counts, copies, n_alleles, config.error, config.limit_pooled)


def call_samples(observations: DataFrame, copy_numbers: DataFrame, psvs: DataFrame, n_alleles: int, config: chain.ChainConfig = chain.ChainConfig()) -> dict[str, DataFrame]:
    """Calling sample by sample, down to a genotype of every copy: see operators.chain."""
    return chain.call_samples(observations, copy_numbers, psvs, n_alleles, config)


def pool_variants(records: DataFrame, copies: DataFrame) -> DataFrame:
    """records: variant_id, chrom_id, s, e, alleles, gt (array) of single copies; copies: chrom_id, s, e, offset (where the
    copy lies on copy 1). Records of all copies on copy 1's places, with genotypes put together."""
    on = intervals.overlap_join(records, copies, residual=(F.col("b_s") <= F.col("s")) & (F.col("b_e") >= F.col("e")))
    placed = on.select("variant_id", (F.col("s") - F.col("b_s") + F.col("b_offset")).alias("pos"), "alleles", "gt")
    called = placed.select("pos", F.transform("gt", lambda i: F.get(F.col("alleles"), i)).alias("g"), "alleles")
    return called.groupBy("pos").agg(F.array_sort(F.flatten(F.collect_list("g"))).alias("gt"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("alleles")))).alias("alleles"))

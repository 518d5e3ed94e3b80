"""Genotype arithmetic over arrays: enumeration, multinomial likelihoods, qualities, allele statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lambdas import let
from ..functions.logmath import LN10, genotypes, log_normalize, phred_of_best

ERROR = 0.01


def genotype_table(n_alleles: int, ploidy: int) -> Column:
    """Literal array of all genotypes as arrays of counts, (ploidy, 0, ...) first: a few dozen at most."""
    return F.array(*(F.array(*(F.lit(k) for k in g)) for g in genotypes(n_alleles, ploidy)))


def genotype_text(counts: Column) -> Column:
    """(2, 1) -> 0/0/1."""
    return F.array_join(F.flatten(F.transform(counts, lambda k, i: F.array_repeat(i, k.cast("int")))), "/")


def log_likelihoods(observed: Column, n_alleles: int, ploidy: int, error: float = ERROR) -> Column:
    """ln P(genotype | counts) of every genotype under an even prior: allele probabilities are
    max(copies, error * ploidy), normalized. The multinomial coefficient is the same for all, and cancels."""

    def of(g: Column) -> Column:
        weights = F.transform(g, lambda k: F.greatest(k.cast("double"), F.lit(error * ploidy)))
        total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
        return F.aggregate(F.zip_with(observed, weights, lambda n, w: n * F.ln(w / total)), F.lit(0.0), lambda a, x: a + x)

    return log_normalize(F.transform(genotype_table(n_alleles, ploidy), of))


def call_genotypes(df: DataFrame, counts: Sequence[str], ploidy: int, error: float = ERROR) -> DataFrame:
    """Adds gt and gq: the likeliest genotype (the first of equals) and its Phred quality."""
    n = len(counts)
    logs = df.withColumn("_logs", log_likelihoods(F.array(*(F.col(c).cast("double") for c in counts)), n, ploidy, error))
    best = logs.withColumn("_best", (F.array_position("_logs", F.array_max("_logs")) - 1).cast("int"))
    table = genotype_table(n, ploidy)
    return best.select(*df.columns, genotype_text(F.get(table, F.col("_best"))).alias("gt"), phred_of_best(F.col("_logs"), F.col("_best")).alias("gq"))


def usable_alleles(counts: Column, partial: Column, other: Column, most: float = 0.1) -> Column:
    """False where partial or other observations are this share of all or more."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x) + partial + other
    return (total > 0) & (partial < most * total) & (other < most * total)


def allele_statistics(df: DataFrame, by: str, alleles: Column) -> DataFrame:
    """AN, AC and AF of each allele over called genotypes (arrays of allele numbers)."""
    each = df.select(by, F.explode(alleles).alias("allele")).groupBy(by, "allele").agg(F.count(F.lit(1)).alias("ac"))
    total = each.groupBy(by).agg(F.sum("ac").alias("an"))
    return each.join(total, by).withColumn("af", F.col("ac") / F.col("an"))


def site_quality(p_reference: Column) -> Column:
    """-10 log10 of the product of all samples' P(0/0), given as ln; an aggregate, at most 10000."""
    return F.least(F.lit(10000.0), F.lit(-10 / LN10) * F.sum(p_reference))


def allele_coverage(alleles: Column, read_length: int) -> Column:
    """How likely a read covers each allele, relative to the easiest one: max(0.1, read length - its length - 1)."""
    room = F.transform(alleles, lambda a: F.greatest(F.lit(0.1), (read_length - F.length(a) - 1).cast("double")))
    return let(room, lambda r: F.transform(r, lambda x: x / F.array_max(r)))


def reliable(fvalues: Column, least: float) -> Column:
    return F.forall(fvalues, lambda x: F.coalesce(x >= least, F.lit(False)))


def cn_text(cn: Column, low: Column, high: Column, reference: Column) -> Column:
    """A copy number, `<n` or `>n` at the end of the range that was tried, unless that end is a natural one."""
    return F.when((cn <= low) & (low > 0), F.concat(F.lit("<"), (cn + 1).cast("string"))).when(cn >= high, F.concat(F.lit(">"), (cn - 1).cast("string"))).otherwise(cn.cast("string"))


def paralog_text(cns: Column, quals: Column, total: Column, least_quality: float = 5.0) -> Column:
    """Copies' numbers joined by commas, `?` below a quality; a `?` is 0 where the others make up the total."""
    known = F.zip_with(cns, quals, lambda c, q: F.when(q >= least_quality, c))
    rest = total - F.aggregate(known, F.lit(0).cast("bigint"), lambda a, c: a + F.coalesce(c, F.lit(0)))
    some = F.exists(known, lambda c: c.isNotNull())
    return F.array_join(F.transform(known, lambda c: F.when(c.isNotNull(), c.cast("string")).when(some & (rest == 0), F.lit("0")).otherwise(F.lit("?"))), ",")

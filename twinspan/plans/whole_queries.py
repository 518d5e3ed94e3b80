"""Queries of two-role operators and of sequence operators, over whole tables and whole texts. Where an operator needs
two roles they are split by o_orderstatus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lambdas import let
from ..operators import cigars as cg
from ..operators import homology as hm
from ..operators import intervals as iv
from ..operators import relational as rel
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


def _with_status(spark, d) -> DataFrame:
    o = view(spark, d, "orders").select(F.col("o_orderkey").alias("b_id"), F.col("o_orderstatus").alias("status"))
    return view(spark, d, "iv_b").join(o, "b_id")


@query("SELECT locus, s, e, cn, printf('%02d-%02d', cn, g) AS region_group FROM (SELECT *, CAST(sum(nw) OVER (PARTITION BY locus, cn ORDER BY s, b_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS g FROM (SELECT chrom_id AS locus, s, e, b_id, b_id % 3 * 2 + 2 AS cn, CASE WHEN s - lag(e) OVER (PARTITION BY chrom_id, b_id % 3 ORDER BY s, b_id) < 500 THEN 0 ELSE 1 END AS nw FROM iv_b))", "iv_b")
def w09_region_groups(spark, d) -> DataFrame:
    r = view(spark, d, "iv_b").select(F.col("chrom_id").alias("locus"), "s", "e", (F.col("b_id") % 3 * 2 + 2).alias("cn"))
    return hm.region_groups(r, 500)


@query("SELECT chrom_id, s, e, b_id FROM iv_b x JOIN orders o ON o.o_orderkey = x.b_id WHERE o.o_orderstatus <> 'O' AND NOT EXISTS (SELECT 1 FROM iv_b y JOIN orders p ON p.o_orderkey = y.b_id WHERE p.o_orderstatus = 'O' AND y.chrom_id = x.chrom_id AND y.s < x.e AND x.s < y.e)", "iv_b")
def p21_result_regions(spark, d) -> DataFrame:
    """Regions of orders that aren't open, without those that one of an open order touches."""
    b = _with_status(spark, d)
    out = iv.merge_overlapping(b.filter("status = 'O'").select("chrom_id", "s", "e"))
    return iv.overlap_semi(b.filter("status <> 'O'").drop("status"), out, ["b_id"], anti=True).select("chrom_id", "s", "e", "b_id")


@query("WITH e AS (SELECT DISTINCT l_suppkey % 60 AS a, l_partkey % 60 AS b FROM lineitem WHERE l_suppkey % 60 < l_partkey % 60) SELECT a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM e x JOIN e y ON x.b = y.a WHERE x.a = e.a AND y.b = e.b)")
def u05_transitive_reduction(spark, d) -> DataFrame:
    e = view(spark, d, "lineitem").select((F.col("l_suppkey") % 60).alias("a"), (F.col("l_partkey") % 60).alias("b")).filter("a < b").distinct()
    return rel.transitive_reduction(e)


@query("""WITH ov AS (SELECT chrom_id, s, e, b_id % 7 AS cn FROM iv_b JOIN orders ON o_orderkey = b_id WHERE o_orderstatus = 'O') SELECT a.b_id, count(o.cn) AS n_entries,
    CAST(CASE WHEN count(o.cn) = 0 THEN 2 WHEN count(o.cn) = 1 THEN min(o.cn) ELSE -1 END AS BIGINT) AS cn FROM iv_b a LEFT JOIN ov o ON a.chrom_id = o.chrom_id AND o.s <= a.s AND o.e >= a.e GROUP BY 1""", "iv_b")
def j20_cn_lookup_default(spark, d) -> DataFrame:
    """All regions looked up in the list of those of open orders."""
    entries = _with_status(spark, d).filter("status = 'O'").select("chrom_id", "s", "e", (F.col("b_id") % 7).cast("bigint").alias("cn"))
    return iv.lookup_with_default(view(spark, d, "iv_b"), entries, "cn", 2, ["b_id"]).select("b_id", "n_entries", F.coalesce("cn", F.lit(-1)).cast("bigint").alias("cn"))


@query("""SELECT dup_id, chrom2, start2, end2 FROM hom h WHERE EXISTS (SELECT 1 FROM (SELECT concat('chr', CAST(CAST(chrom_id % 5 AS BIGINT) AS STRING)) AS c, s, e FROM iv_b JOIN orders ON o_orderkey = b_id WHERE o_orderstatus = 'P') r
    WHERE r.c = h.chrom2 AND r.s < h.end2 AND h.start2 < r.e)""", "hom", "iv_b")
def p04_second_region_overlap(spark, d) -> DataFrame:
    """All rows against the list of regions of orders in part filled."""
    regions = _with_status(spark, d).filter("status = 'P'").select(F.concat(F.lit("chr"), (F.col("chrom_id") % 5).cast("string")).alias("chrom_id"), "s", "e")
    hom = view(spark, d, "hom").select("dup_id", F.col("chrom2").alias("chrom_id"), F.col("start2").alias("s"), F.col("end2").alias("e"))
    found = iv.overlap_semi(hom, iv.merge_overlapping(regions).drop("n"), ["dup_id", "chrom_id", "s", "e"], width=512)
    return found.select("dup_id", F.col("chrom_id").alias("chrom2"), F.col("s").alias("start2"), F.col("e").alias("end2"))


@query("""WITH k AS (SELECT doc_id, substr(seq, CAST(i AS INTEGER), 4) AS w FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - 2)) AS i FROM seqs)), c AS (SELECT doc_id, count(*) AS n, count(DISTINCT w) AS u FROM k WHERE regexp_matches(w, '^[ACGT]+$') GROUP BY 1)
    SELECT doc_id, n, u AS distinct_kmers, round(CAST(u AS DOUBLE) / least(n, 256), 6) AS complexity, round(CAST(n AS DOUBLE) / u, 6) AS multiplicity FROM c""", "seqs")
def g12_kmer_complexity(spark, d) -> DataFrame:
    sizes = let(cg.kmers(F.col("seq"), 4), lambda k: F.struct(F.size(k).cast("bigint").alias("n"), F.size(F.array_distinct(k)).cast("bigint").alias("distinct_kmers")))
    counted = view(spark, d, "seqs").select("doc_id", F.inline(F.array(sizes))).filter("n > 0")
    u, n = F.col("distinct_kmers"), F.col("n")
    return counted.withColumn("complexity", F.round(u / F.least(n, F.lit(256)), 6)).withColumn("multiplicity", F.round(n / u, 6))


@query("SELECT doc_id, md5(translate(reverse(regexp_replace(seq, '[^ACGTN]', 'X', 'g')), 'ACGT', 'TGCA')) AS rc, CAST(length(regexp_replace(seq, '[^GC]', '', 'g')) AS BIGINT) AS gc FROM seqs", "seqs")
def f01_revcomp_gc(spark, d) -> DataFrame:
    return view(spark, d, "seqs").select("doc_id", F.md5(cg.reverse_complement(F.col("seq"))).alias("rc"), cg.gc_count(F.col("seq")).cast("bigint").alias("gc"))


@query("SELECT doc_id, CAST(i AS BIGINT) AS start, length(substr(seq, CAST(i + 1 AS INTEGER), 900)) AS len FROM (SELECT doc_id, seq, unnest(range(0, length(seq) - 299, 150)) AS i FROM seqs) WHERE regexp_matches(substr(translate(seq, ' ', 'A'), CAST(i + 1 AS INTEGER), 900), '^[ACGT]+$')", "seqs")
def s24_artificial_reads(spark, d) -> DataFrame:
    s = view(spark, d, "seqs").withColumn("seq", F.translate("seq", " ", "A"))
    r = s.select("doc_id", F.explode(cg.sliding_reads(F.col("seq"), 900, 150, 300)).alias("r"))
    return r.select("doc_id", F.col("r.start").cast("bigint").alias("start"), F.length("r.seq").cast("bigint").alias("len"))


@query("SELECT doc_id, length(seq) AS len, length(seq) - length(translate(seq, 'ACGT', '')) AS known, CAST(length(translate(seq, 'ACGT', '')) AS DOUBLE) / greatest(length(seq), 1) > 0.1 AS too_unknown FROM seqs", "seqs")
def p18_unknown_fraction(spark, d) -> DataFrame:
    known = F.length("seq") - F.length(F.translate("seq", "ACGT", ""))
    return view(spark, d, "seqs").select("doc_id", F.length("seq").cast("bigint").alias("len"), known.cast("bigint").alias("known"), ((F.length("seq") - known) / F.greatest(F.length("seq"), F.lit(1)) > 0.1).alias("too_unknown"))


@query("SELECT doc_id, CAST(p AS BIGINT) AS pos FROM (SELECT doc_id, seq, unnest(range(0, length(seq) - 2)) AS p FROM seqs) WHERE substr(seq, CAST(p + 2 AS INTEGER), 1) = substr(seq, CAST(p + 3 AS INTEGER), 1)", "seqs")
def p16_homopolymers(spark, d) -> DataFrame:
    """Every place of the whole sequence, in blocks that share what a place looks ahead at."""
    starts = F.sequence(F.lit(0), F.length("seq") - 3, F.lit(1000))
    blocks = view(spark, d, "seqs").filter("length(seq) > 2").select("doc_id", "seq", F.explode(starts).alias("start"))
    cut = blocks.select("doc_id", "start", F.expr("substring(seq, start + 1, 1002)").alias("block"))
    return cut.select("doc_id", "start", F.explode(cg.homopolymer_places(F.col("block"), 2)).alias("i")).select("doc_id", (F.col("start") + F.col("i")).cast("bigint").alias("pos"))

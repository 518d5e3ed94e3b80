"""Queries of calling, of what it needs to know about copies and reads, and of functions without another query."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import api
from ..functions import logmath as lm
from ..operators import calling as ca
from ..operators import chain
from ..operators import genotypes as gt
from ..operators import homology as hm
from ..operators import intervals as iv
from ..operators import paralog as pl
from ..operators import relational as rel
from ..operators import variants as vr
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


def _numbers(spark, d) -> DataFrame:
    return view(spark, d, "allele_counts")


# ------------------------------------------------------------------ functions
@query("SELECT psv_ix, sample_id, round(-10 * log10(0.9 * (1 - (n0 + 1.0) / (n0 + n1 + n2 + 3)) + 0.1), 6) AS quality FROM allele_counts", "allele_counts")
def f05_extended_phred(spark, d) -> DataFrame:
    total = F.col("n0") + F.col("n1") + F.col("n2") + 3
    values = F.array(*(F.ln((F.col(c) + 1) / total) for c in ("n0", "n1", "n2")))
    return _numbers(spark, d).select("psv_ix", "sample_id", F.round(lm.extended_phred(values, 0, F.lit(math.log(0.1))), 6).alias("quality"))


@query("""WITH n AS (SELECT psv_ix, sample_id, CAST(1 + (n0 + n1 + n2) % 8 AS INTEGER) AS total FROM allele_counts)
    SELECT psv_ix, sample_id, total, concat_ws(',', CAST(a AS STRING), CAST(b AS STRING), CAST(total - a - b AS STRING)) AS cns FROM n, range(0, 9) y(a), range(0, 9) z(b) WHERE a + b <= total""", "allele_counts")
def f11_copy_tuples(spark, d) -> DataFrame:
    """All ways in which each variant's copies in a sample may be dealt to three places; the ways of a total are a table to join with."""
    n = _numbers(spark, d).select("psv_ix", "sample_id", (1 + (F.col("n0") + F.col("n1") + F.col("n2")) % 8).cast("int").alias("total"))
    ways = pl.split_table(spark, range(1, 9), 3)
    return n.join(F.broadcast(ways), "total").select("psv_ix", "sample_id", "total", F.concat_ws(",", F.transform("cns", lambda c: c.cast("string"))).alias("cns"))


@query("""SELECT psv_ix, sample_id, round(pow(1 - f, 2) * pow(g, 2), 9) AS none, round(pow(f, 2) * pow(1 - g, 2), 9) AS full_, 1.0 AS total FROM (SELECT *, 0.5 + n0 % 10 / 20.0 AS f, 0.5 + n1 % 10 / 20.0 AS g FROM allele_counts)""", "allele_counts")
def f15_allele_distribution(spark, d) -> DataFrame:
    """How many alleles of copy 1 two copies of two chromosomes have, by their f-values: none, all four, and all ways."""
    rows = _numbers(spark, d).select("psv_ix", "sample_id", F.array(F.lit(2), F.lit(2)).alias("k"), F.array(0.5 + F.col("n0") % 10 / 20, 0.5 + F.col("n1") % 10 / 20).alias("f"))
    p = pl.with_allele_distribution(rows, "k", "f", "p")
    return p.select("psv_ix", "sample_id", F.round(F.get("p", F.lit(0)), 9).alias("none"), F.round(F.get("p", F.lit(4)), 9).alias("full_"), F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice = 0 THEN 0.0 ELSE floor(o_totalprice / 7919 * pow(10, greatest(0, 2 - floor(log10(o_totalprice / 7919)))) + 0.5) / pow(10, greatest(0, 2 - floor(log10(o_totalprice / 7919)))) END AS quality FROM orders")
def f18_rounded_quality(spark, d) -> DataFrame:
    return view(spark, d, "orders").select("o_orderkey", lm.round_significant(F.col("o_totalprice").cast("double") / 7919, 3).alias("quality"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, strftime(o_orderdate, '%Y-%m-01') AS m, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, o_orderstatus AS status FROM orders")
def f25_dates_and_json(spark, d) -> DataFrame:
    """Parts and differences of dates, and a field written as JSON and read back."""
    o = view(spark, d, "orders").withColumn("j", F.to_json(F.struct("o_orderstatus", "o_orderkey")))
    return o.select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("y"), F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd").alias("m"), F.datediff("o_orderdate", F.lit("1992-01-01")).cast("bigint").alias("days"), F.get_json_object("j", "$.o_orderstatus").alias("status"))


@query("""SELECT psv_ix, sample_id, round(-1.5 * ln(10) * (abs(a - 2) + abs(b - 2)) - ln(z), 6) + 0.0 AS prior FROM (SELECT *, (SELECT sum(exp(-1.5 * ln(10) * (abs(k - 2) + abs(t - k - 2)))) FROM range(0, 9) r(k) WHERE k <= t) AS z
    FROM (SELECT psv_ix, sample_id, CAST(n0 % 4 AS BIGINT) AS a, CAST(1 + n1 % 4 AS BIGINT) AS b, CAST(n0 % 4 + 1 + n1 % 4 AS BIGINT) AS t FROM allele_counts))""", "allele_counts")
def m14_pscn_prior(spark, d) -> DataFrame:
    """The prior of each split of a total copy number over two copies."""
    table = pl.split_table(spark, range(1, 9), 2)
    rows = _numbers(spark, d).select("psv_ix", "sample_id", F.array((F.col("n0") % 4).cast("int"), (1 + F.col("n1") % 4).cast("int")).alias("cns"))
    return rows.join(F.broadcast(table), "cns").select("psv_ix", "sample_id", (F.round("prior", 6) + F.lit(0.0)).alias("prior"))


# ------------------------------------------------------------------ reads and observations
@query("""WITH l AS (SELECT l_orderkey AS r, l_linenumber % 2 AS m, CAST(l_suppkey % 3 AS BIGINT) AS copy, CAST(l_partkey AS BIGINT) AS pos, -CAST(l_quantity AS DOUBLE) / 4 AS p FROM lineitem),
    k AS (SELECT x.r AS read_id, x.copy AS copy1, y.copy AS copy2, x.p + y.p + CASE WHEN x.copy = y.copy AND abs(x.pos - y.pos) <= 500 THEN 0 ELSE -5 * ln(10) END AS score FROM l x JOIN l y ON x.r = y.r AND x.m = 1 AND y.m = 0)
    SELECT read_id, copy1, copy2, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY score DESC, copy1, copy2) AS rn FROM k) WHERE rn = 1""")
def j25_mate_places(spark, d) -> DataFrame:
    """The best pair of places of each read's two mates."""
    x = view(spark, d, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(2).alias("mate"), (F.col("l_suppkey") % 3).cast("bigint").alias("copy"), F.col("l_partkey").cast("bigint").alias("pos"), (-F.col("l_quantity").cast("double") / 4).alias("ln_prob"))
    return ca.join_mates(x, 500).select("read_id", "best.copy1", "best.copy2", F.round("score", 6).alias("score"))


@query("""SELECT a_id AS variant_id, b.b_id % 5 AS sample_id, CASE WHEN min(b.b_id % 3) = max(b.b_id % 3) THEN min(b.b_id % 3) ELSE -1 END AS cn, min(b.b_id % 3) <> max(b.b_id % 3) AS conflict
    FROM (SELECT DISTINCT a_id, chrom_id, s, e FROM iv_a) a JOIN iv_b b ON a.chrom_id = b.chrom_id AND a.s < b.e AND b.s < a.e GROUP BY 1, 2""", "iv_a", "iv_b")
def j27_copy_numbers_of_variants(spark, d) -> DataFrame:
    variants = view(spark, d, "iv_a").distinct().withColumnRenamed("a_id", "variant_id")
    profile = view(spark, d, "iv_b").select((F.col("b_id") % 5).alias("sample_id"), "chrom_id", "s", "e", (F.col("b_id") % 3).alias("cn"))
    return ca.copy_numbers_of_variants(variants, profile).withColumn("cn", F.coalesce("cn", F.lit(-1)))


_LETTERS = "(SELECT l_orderkey AS r, CAST(l_linenumber AS BIGINT) AS p, min(l_returnflag) AS b FROM lineitem GROUP BY 1, 2)"


def _letters(spark, d) -> DataFrame:
    """A read for each order with a letter at up to seven places."""
    return view(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").cast("bigint").alias("ref_pos")).agg(F.min("l_returnflag").alias("base"))


def _psvs(spark) -> DataFrame:
    return spark.createDataFrame([(1, 1, 3), (2, 3, 4), (3, 4, 7)], "psv_id long, s long, e long")


_OBSERVED = f"SELECT r AS read_id, psv_id, string_agg(b, '' ORDER BY p) AS allele, count(*) < max(e - s) AS partial FROM {_LETTERS}, (VALUES (1, 1, 3), (2, 3, 4), (3, 4, 7)) v(psv_id, s, e) WHERE p >= s AND p < e GROUP BY 1, 2"


@query(_OBSERVED)
def g03_allele_observations(spark, d) -> DataFrame:
    return vr.allele_observations(_letters(spark, d), _psvs(spark))


@query(f"SELECT CAST(psv_id AS BIGINT) AS psv_id, CASE WHEN partial THEN 'partial' WHEN allele = 'AA' OR allele = 'A' OR allele = 'AAA' THEN '0' WHEN allele = 'NN' OR allele = 'N' OR allele = 'NNN' THEN '1' ELSE 'other' END AS allele_ix, count(*) AS n FROM ({_OBSERVED}) GROUP BY 1, 2")
def g04_observed_counts(spark, d) -> DataFrame:
    alleles = spark.createDataFrame([(1, ["AA", "NN"]), (2, ["A", "N"]), (3, ["AAA", "NNN"])], "psv_id long, alleles array<string>")
    return vr.observed_counts(vr.allele_observations(_letters(spark, d), _psvs(spark)), alleles)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE CASE WHEN l_linenumber % 2 = 0 THEN -CAST(l_quantity AS DOUBLE) / 10 <= -ln(10) * 2 ELSE -CAST(l_quantity AS DOUBLE) / 10 <= -ln(10) END")
def p17_quality_filter(spark, d) -> DataFrame:
    x = view(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 2 == 0).alias("is_snp"), (-F.col("l_quantity").cast("double") / 10).alias("ln_qual"))
    return ca.quality_filter(x, snp=20, indel=10).select("l_orderkey", "l_linenumber")


_READS = "(SELECT l_suppkey % 20 AS s, l_orderkey AS h, CAST(l_partkey % 50 AS BIGINT) AS k, l_returnflag = 'A' AS c FROM lineitem)"


@query(f"SELECT CAST(x.s AS BIGINT) AS sample_id, x.k AS rank, y.k AS rank2, count(*) AS n, count(*) FILTER (x.c <> y.c) AS conflicts FROM {_READS} x JOIN {_READS} y ON x.s = y.s AND x.h = y.h AND y.k > x.k AND y.k - x.k <= 10 GROUP BY 1, 2, 3")
def j12_common_reads(spark, d) -> DataFrame:
    """Pairs of variants that a sample's reads link, by the reads' keys, and how many of the reads disagree."""
    x = view(spark, d, "lineitem").select((F.col("l_suppkey") % 20).cast("bigint").alias("sample_id"), F.col("l_orderkey").alias("read_hash"), (F.col("l_partkey") % 50).cast("bigint").alias("rank"), (F.col("l_returnflag") == "A").alias("copy"))
    return ca.common_reads(x, 10)


@query("""SELECT psv_ix, sample_id, n > 0 AND list_sum(list_transform(range(0, n - b + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.95) + (n - i) * ln(0.05)))) <= 0.001 AS conflict
    FROM (SELECT psv_ix, sample_id, CAST(n0 + n1 AS INTEGER) AS n, CAST(least(n1, (n0 + n1) // 4) AS INTEGER) AS b FROM allele_counts)""", "allele_counts")
def m25_conflicts(spark, d) -> DataFrame:
    """Whether so many reads that disagree are too unlikely for a pair of variants."""
    x = _numbers(spark, d).select("psv_ix", "sample_id", (F.col("n0") + F.col("n1")).alias("n"), F.least("n1", F.floor((F.col("n0") + F.col("n1")) / 4)).alias("conflicts"))
    return ca.conflicting(x).select("psv_ix", "sample_id", "conflict")


@query("SELECT psv_ix, sample_id, CAST(CASE n0 % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -1 END AS BIGINT) AS allele_ix FROM allele_counts", "allele_counts")
def x14_remapped_alleles(spark, d) -> DataFrame:
    """Observations of a record with alleles A, C, G by the numbers of one with C, A."""
    ids = _numbers(spark, d).select(F.col("psv_ix").alias("variant_id")).distinct()
    old, new = (ids.withColumn("alleles", F.array(*map(F.lit, x))) for x in ("ACG", "CA"))
    seen = _numbers(spark, d).select(F.col("psv_ix").alias("variant_id"), "sample_id", (F.col("n0") % 3).cast("int").alias("allele_ix"))
    return vr.remap_alleles(seen, old, new).select(F.col("variant_id").alias("psv_ix"), "sample_id", F.col("allele_ix").cast("bigint").alias("allele_ix"))


@query("SELECT DISTINCT user_id AS sample FROM (SELECT user_id, mapq FROM reads GROUP BY 1, 2 HAVING count(*) > 1)", "reads")
def x05_duplicate_samples(spark, d) -> DataFrame:
    """Samples with several rows of one GC bin, which a merge of depth tables must not have."""
    return tx.duplicated_samples(view(spark, d, "reads").select(F.col("user_id").alias("sample"), F.col("mapq").alias("gc")))


# ------------------------------------------------------------------ copies
@query("SELECT sample_id, psv_ix, n0, n1, n2 FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY least(n0, n1) DESC, n0 DESC, n1 DESC, psv_ix DESC) AS rn FROM allele_counts) WHERE rn = 1", "allele_counts")
def t09_best_of_copies(spark, d) -> DataFrame:
    return vr.best_of_copies(_numbers(spark, d), ["sample_id"], "n0", "n1")


@query("SELECT b_id, CASE WHEN b_id % 3 <> 0 THEN CAST(b_id % 4 AS BIGINT) ELSE -1 END AS first, CAST(1 AS BIGINT) AS second FROM iv_b", "iv_b")
def j19_matched_alleles(spark, d) -> DataFrame:
    """Alleles by the copies that hold a record's places; of a reverse place the last base counts."""
    b = view(spark, d, "iv_b")
    place = lambda at, forward, ix, n: F.struct(F.col("chrom_id"), at.alias("pos"), F.lit(forward).alias("forward"), ix.cast("bigint").alias("allele_ix"), F.lit(n).alias("length"))
    places = F.array(place(F.col("s") + F.when(F.col("b_id") % 3 == 0, -1).otherwise(0), True, F.col("b_id") % 4, 1), place(F.col("s") - 2, False, F.lit(1), 3))
    copy = lambda forward: F.struct(F.col("chrom_id"), F.col("s"), F.col("e"), F.lit(forward).alias("forward"))
    found = vr.match_copies(places, F.array(copy(True), copy(False)))
    return b.select("b_id", F.coalesce(F.get(found, F.lit(0)), F.lit(-1)).alias("first"), F.coalesce(F.get(found, F.lit(1)), F.lit(-1)).alias("second"))


@query("""SELECT b_id, CASE WHEN b_id % 3 = 0 THEN '-' ELSE concat(CAST(s AS STRING), '-', CAST(e + 20 AS STRING), ',', CAST(s - 30 AS STRING), '-', CAST(e AS STRING)) END AS spans FROM iv_b""", "iv_b")
def j18_continued_copies(spark, d) -> DataFrame:
    """Copies of a region, one forward and one reverse, continued by those of the next; a third lies too far away."""
    b = view(spark, d, "iv_b")
    span = lambda s, e, forward: F.struct(F.col("chrom_id"), s.alias("s"), e.alias("e"), F.lit(forward).alias("forward"))
    far = F.when(F.col("b_id") % 3 == 0, 1000).otherwise(0)
    first = F.array(span(F.col("s"), F.col("e"), True), span(F.col("s"), F.col("e"), False))
    second = F.array(span(F.col("s") - 30, F.col("s") - 5, False), span(F.col("e") + 5 + far, F.col("e") + 20 + far, True))
    found = vr.continued_copies(first, second, 100)
    text = F.array_join(F.transform(found, lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",")
    return b.select("b_id", F.coalesce(text, F.lit("-")).alias("spans"))


_COMBINED = """WITH d AS (SELECT b_id, chrom_id AS locus, s, least(e, s + 4) AS e, b_id % 2 AS copy, 'A' || CAST(b_id % 3 AS STRING) AS allele FROM iv_b), m AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY locus ORDER BY s, e, b_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM d),
    g AS (SELECT *, sum(nw) OVER (PARTITION BY locus ORDER BY s, e, b_id ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT locus, min(s) AS s, max(e) AS e, CAST(count(DISTINCT allele) + 1 AS INTEGER) AS alleles, CAST(count(DISTINCT (copy, allele)) AS INTEGER) AS copies FROM g GROUP BY locus, g"""


@query(_COMBINED, "iv_b")
def w20_combined_psvs(spark, d) -> DataFrame:
    """Overlapping differences of several copies as one record."""
    b = view(spark, d, "iv_b")
    differences = b.select(F.col("chrom_id").alias("locus"), (F.col("b_id") % 2).alias("copy"), "s", F.least("e", F.col("s") + 4).alias("e"), F.concat(F.lit("A"), (F.col("b_id") % 3).cast("string")).alias("allele"), F.lit("ref").alias("ref"))
    return vr.combine_psvs(differences).select("locus", "s", "e", F.size("alleles").alias("alleles"), F.size("copies").alias("copies"))


@query("SELECT sample_id, window_ix, CAST(coalesce((lag(window_ix) OVER w + window_ix + 1) // 2, -1) AS BIGINT) AS left_bound, CAST(coalesce((lead(window_ix) OVER w + window_ix + 1) // 2, -1) AS BIGINT) AS right_bound FROM win_depth WINDOW w AS (PARTITION BY sample_id ORDER BY window_ix)", "win_depth")
def w25_window_boundaries(spark, d) -> DataFrame:
    w = Window.partitionBy("sample_id").orderBy("window_ix")
    half = lambda f: F.coalesce(F.floor((f("window_ix").over(w) + F.col("window_ix") + 1) / 2), F.lit(-1))
    return view(spark, d, "win_depth").select("sample_id", "window_ix", half(F.lag).alias("left_bound"), half(F.lead).alias("right_bound"))


@query("""SELECT psv_ix, sample_id, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER t AS BIGINT) AS nt, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM allele_counts
    WINDOW w AS (PARTITION BY sample_id ORDER BY n0), t AS (PARTITION BY sample_id ORDER BY n0, psv_ix)""", "allele_counts")
def w27_ranks(spark, d) -> DataFrame:
    w, t = Window.partitionBy("sample_id").orderBy("n0"), Window.partitionBy("sample_id").orderBy("n0", "psv_ix")
    ranks = (F.rank().over(w).cast("bigint").alias("r"), F.dense_rank().over(w).cast("bigint").alias("dr"), F.ntile(4).over(t).cast("bigint").alias("nt"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"))
    return _numbers(spark, d).select("psv_ix", "sample_id", *ranks)


_SEGMENTS = "WITH p AS (SELECT chrom_id, s AS x, 1 AS d FROM iv_b UNION ALL SELECT chrom_id, e, -1 FROM iv_b), q AS (SELECT chrom_id, x, sum(d) AS d FROM p GROUP BY 1, 2), c AS (SELECT chrom_id, x AS s, lead(x) OVER w AS e, CAST(sum(d) OVER w AS BIGINT) AS n FROM q WINDOW w AS (PARTITION BY chrom_id ORDER BY x))"


@query(_SEGMENTS + """, k AS (SELECT *, CASE WHEN s = lag(e) OVER (PARTITION BY chrom_id ORDER BY s) THEN 0 ELSE 1 END AS nw FROM c WHERE n > 2), g AS (SELECT *, sum(nw) OVER (PARTITION BY chrom_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM k)
    SELECT chrom_id, min(s) AS s, max(e) AS e FROM g GROUP BY chrom_id, g""", "iv_b")
def g25_crowded_stretches(spark, d) -> DataFrame:
    """Stretches that more than two intervals share, touching ones as one."""
    return iv.merge_overlapping(iv.coverage(view(spark, d, "iv_b")).filter("depth > 2").select("chrom_id", "s", "e")).select("chrom_id", "s", "e")


@query(_SEGMENTS + """, j AS (SELECT c.chrom_id, c.s, c.e, b.b_id, CASE WHEN b.b_id % 2 = 0 THEN b.s + 7 + (c.s - b.s) ELSE b.e + 7 - (c.e - b.s) END AS s2, CASE WHEN b.b_id % 2 = 0 THEN b.s + 7 + (c.e - b.s) ELSE b.e + 7 - (c.s - b.s) END AS e2 FROM c JOIN iv_b b ON b.chrom_id = c.chrom_id AND b.s <= c.s AND b.e >= c.e WHERE c.n > 0)
    SELECT chrom_id, s, e, 2 + 2 * count(*) AS cn, e - s < 20 AND count(*) < 3 AS skip, CAST(sum(s2) AS BIGINT) AS starts, CAST(sum(e2) AS BIGINT) AS ends FROM j GROUP BY chrom_id, s, e""", "iv_b")
def w08_const_regions(spark, d) -> DataFrame:
    """Regions of one reference copy number with their other copies: places go through each duplication's alignment."""
    b = view(spark, d, "iv_b")
    dup = b.select("b_id", "chrom_id", "s", "e", ((F.col("chrom_id") + 1) % 100).alias("chrom2"), (F.col("s") + 7).alias("s2"), (F.col("e") + 7).alias("e2"), (F.col("b_id") % 2 == 0).alias("forward"), F.concat((F.col("e") - F.col("s")).cast("string"), F.lit("=")).alias("cigar"))
    r = hm.const_regions(dup, "b_id", min_size=20, max_ref_cn=6)
    total = lambda c: F.aggregate("copies", F.lit(0).cast("bigint"), lambda a, x: a + x[c])
    return r.select("chrom_id", "s", "e", F.col("cn").cast("bigint").alias("cn"), "skip", total("s").alias("starts"), total("e").alias("ends"))


_ISLANDS = """o AS (SELECT chrom_id, s, e, max(e) OVER (PARTITION BY chrom_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM iv_b), k AS (SELECT *, sum(CASE WHEN pe IS NOT NULL AND s <= pe THEN 0 ELSE 1 END) OVER (PARTITION BY chrom_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o),
    m AS (SELECT chrom_id, min(s) AS s, max(e) AS e FROM k GROUP BY chrom_id, k)"""


@query(f"""WITH {_ISLANDS}, g AS (SELECT chrom_id, coalesce(lag(e) OVER (PARTITION BY chrom_id ORDER BY s), 0) AS s, s AS e FROM m UNION ALL SELECT c.chrom_id, coalesce(max(m.e), 0), c.length FROM contigs c LEFT JOIN m ON c.chrom_id = m.chrom_id GROUP BY c.chrom_id, c.length),
    u AS (SELECT * FROM g WHERE s < e AND chrom_id IN (SELECT chrom_id FROM contigs)) SELECT r.a_id, CAST(sum(least(r.e, u.e) - greatest(r.s, u.s)) AS BIGINT) AS unique_bases FROM (SELECT DISTINCT a_id, chrom_id, s, e FROM iv_a) r JOIN u ON r.chrom_id = u.chrom_id AND r.s < u.e AND u.s < r.e GROUP BY 1""", "iv_b", "contigs", "iv_a")
def j26_unique_bases(spark, d) -> DataFrame:
    """How much of each interval lies in what no duplication covers."""
    unique = iv.unique_regions(view(spark, d, "iv_b"), view(spark, d, "contigs"))
    pairs = iv.overlap_join(view(spark, d, "iv_a").distinct(), unique)
    return pairs.groupBy("a_id").agg(F.sum(iv.overlap_size(F.col("s"), F.col("e"), F.col("b_s"), F.col("b_e"))).cast("bigint").alias("unique_bases"))


@query("""WITH p AS (SELECT b_id, chrom_id, s, s + 2 AS e, s + 5 + b_id % 3 AS s2, b_id % 2 AS f FROM iv_b), r AS (SELECT DISTINCT chrom_id, s // 50 * 50 AS s, s // 50 * 50 + 50 AS e, s // 50 * 50 + 5 AS s2, s // 50 * 50 + 56 AS e2, s // 50 % 2 AS f FROM iv_b)
    SELECT DISTINCT p.b_id FROM p JOIN r ON p.chrom_id = r.chrom_id AND p.s >= r.s AND p.e <= r.e AND p.s2 >= r.s2 AND p.s2 + 2 <= r.e2 AND p.f = r.f""", "iv_b")
def j17_consistent_copies(spark, d) -> DataFrame:
    """Variants all copies of which lie in a copy of the region around them."""
    b = view(spark, d, "iv_b")
    copy = lambda s, e, f: F.array(F.struct(F.col("chrom_id"), s.alias("s"), e.alias("e"), f.alias("strand"))).alias("copies")
    psvs = b.select("b_id", "chrom_id", "s", (F.col("s") + 2).alias("e"), copy(F.col("s") + 5 + F.col("b_id") % 3, F.col("s") + 7 + F.col("b_id") % 3, F.col("b_id") % 2))
    at = b.select("chrom_id", (F.floor(F.col("s") / 50) * 50).alias("s")).distinct()
    regions = at.select("chrom_id", "s", (F.col("s") + 50).alias("e"), copy(F.col("s") + 5, F.col("s") + 56, F.col("s") / 50 % 2))
    return vr.consistent_copies(psvs, regions).select("b_id").distinct()


@query("SELECT sample_id, round(avg(50 + mapq), 6) AS mean_length FROM reads WHERE flag & 3844 = 0 GROUP BY 1", "reads")
def g22_mean_read_length(spark, d) -> DataFrame:
    """Over primary reads, 50 and their mapping quality long here."""
    return rel.primary_reads(view(spark, d, "reads")).groupBy("sample_id").agg(F.round(F.avg(50 + F.col("mapq")), 6).alias("mean_length"))


@query("SELECT sample_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM reads WHERE sample_id IN (SELECT r_regionkey FROM region) GROUP BY 1", "reads")
def s22_read_store(spark, d) -> DataFrame:
    """Reads kept by sample, of which those are read that a table names: folders in place of an index."""
    path = sc.scratch_path(spark, "reads")
    view(spark, d, "reads").repartition("sample_id").write.partitionBy("sample_id").parquet(path)
    kept = spark.read.schema("read_id long, user_id long, pos long, mapq long, is_read2 long, sample_id long").parquet(path)
    kept = kept.join(F.broadcast(view(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("sample_id"))), "sample_id")
    return kept.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").cast("bigint").alias("places"))


@query("SELECT item_id * 100000 + k AS read_id, CAST(k + 3 AS BIGINT) AS pos, '60=' AS cigar FROM (SELECT item_id, unnest(range(12, length(text) - 62, 40)) AS k FROM benchmark WHERE length(text) >= 75)")
def m36_pooled_reads(spark, d) -> DataFrame:
    """Reads of 60 letters from all along a copy of each passage, which lacks three letters behind the first ten, put on the
    passage itself."""
    b = view(spark, d, "benchmark").filter("length(text) >= 75").withColumn("text", F.translate("text", "\n", " ")).withColumn("copy2", F.expr("concat(substring(text, 1, 10), substring(text, 14))"))
    cut = b.select("item_id", "copy2", F.explode(F.sequence(F.lit(12), F.length("copy2") - 60, F.lit(40))).alias("k"))
    item = F.col("item_id").cast("bigint")
    reads = cut.select((item * 100000 + F.col("k")).alias("read_id"), item.alias("chrom_id"), F.col("k").cast("bigint").alias("s"), (F.col("k") + 60).cast("bigint").alias("e"), F.expr("substring(copy2, k + 1, 60)").alias("seq"), F.col("k").cast("bigint").alias("start2"))
    copies = b.select(item.alias("chrom_id"), F.lit(0).cast("bigint").alias("s"), F.length("copy2").cast("bigint").alias("e"), F.col("text").alias("copy1"), "copy2", F.concat(F.lit("10=3D"), (F.length("text") - 13).cast("string"), F.lit("=")).alias("cigar"))
    return api.pool(reads, copies)


@query("SELECT o_orderkey AS locus, CAST(1 + o_custkey % 9 AS BIGINT) AS s, CAST(2 + o_custkey % 9 AS BIGINT) AS e, 'C,G' AS alleles FROM orders")
def m37_psv_records(spark, d) -> DataFrame:
    """The one difference between two copies of each locus, from their alignment."""
    o = view(spark, d, "orders").select(F.col("o_orderkey").alias("locus"), (F.col("o_custkey") % 9 + 1).cast("int").alias("q"))
    text = lambda letter: F.concat(F.expr("repeat('A', q)"), F.lit(letter + "TTTTT"))
    rows = o.select("locus", F.lit(1).alias("copy"), F.concat(F.col("q").cast("string"), F.lit("=1X5=")).alias("cigar"), text("C").alias("ref"), text("G").alias("read"))
    return api.psvs(rows).select("locus", "s", "e", F.array_join("alleles", ",").alias("alleles"))


# ------------------------------------------------------------------ the whole chain
@query()
def x07_sample_calls(spark, d) -> DataFrame:
    """Every step of calling for each sample: lines as reads' observations, three copies' numbers by sample."""
    x = view(spark, d, "lineitem")
    obs = x.select((F.col("l_partkey") % 50).cast("bigint").alias("variant_id"), (F.col("l_suppkey") % 20).cast("bigint").alias("sample_id"), F.col("l_orderkey").cast("bigint").alias("read_id"), F.when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("allele_ix"))
    cns = obs.select("variant_id", "sample_id").distinct().select("*", F.lit(4).alias("agcn"), F.array(F.lit(2), F.lit(2)).alias("pscn"))
    psvs = obs.filter("variant_id % 5 = 0").select("variant_id").distinct().select("variant_id", F.floor(F.col("variant_id") / 25).alias("locus"), (F.col("variant_id") / 5).cast("int").alias("rank"), F.array(F.lit(0), F.lit(1)).alias("copy_alleles"), F.array(F.lit(0.99), F.lit(0.99)).alias("f_values"))
    out = chain.call_samples(obs, cns, psvs, 2)["variants"]
    return out.select("variant_id", "sample_id", "depth", "gt", F.round("gq", 4).alias("gq"), "paralog_gt", F.round("paralog_gq", 3).alias("paralog_gq"), "filter")

"""Queries of the iterative and statistical operators, each over its whole analog table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.logmath import genotypes
from ..operators import alignment as al
from ..operators import calling as ca
from ..operators import copynumber as cn
from ..operators import depth as dp
from ..operators import homology as hm
from ..operators import paralog as pl
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


def hits(spark, d) -> DataFrame:
    """The homology analog as alignment hits."""
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("bigint")
    h = view(spark, d, "hom")
    ss = F.regexp_extract("info", r"SS=([\d.]+)", 1).cast("double")
    made = F.struct(
        F.col("dup_id").alias("hit_id"), number("chrom1").alias("chrom_id"), F.col("start1").alias("s"), F.col("end1").alias("e"), F.when(F.col("strand") == "+", 1).otherwise(0).cast("bigint").alias("strand"),
        number("chrom2").alias("chrom2"), F.col("start2").alias("s2"), F.col("end2").alias("e2"), ss.alias("similarity"),
    )
    return h.select(F.inline(F.array(made)))  # once a row: the optimizer would copy the texts into each use of a number


_SS = "CAST(regexp_extract(info, 'SS=([0-9.]+)', 1) AS DOUBLE)"
_SELF = "CASE WHEN chrom1 = chrom2 THEN greatest(0, least(end1, end2) - greatest(start1, start2)) ELSE 0 END"


@query(f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN {_SELF} >= 0.9 * (end1 - start1) THEN 'itself' WHEN {_SELF} > 0 THEN 'tangled' WHEN end1 - start1 < 10 THEN 'short' WHEN {_SS} < 0.96 THEN 'dissimilar' ELSE 'kept' END AS reason FROM hom) GROUP BY 1", "hom")
def l18_hit_reasons(spark, d) -> DataFrame:
    return hm.classify_hits(hits(spark, d), 10, 0.96).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH c AS (SELECT dup_id, CAST(regexp_extract(chrom1, '([0-9]+)$', 1) AS BIGINT) AS chrom_id, start1 AS s, end1 AS e, CAST(CASE WHEN strand = '+' THEN 1 ELSE 0 END AS BIGINT) AS strand, CAST(regexp_extract(chrom2, '([0-9]+)$', 1) AS BIGINT) AS chrom2, start2 AS s2, end2 AS e2,
    CASE WHEN {_SELF} >= 0.9 * (end1 - start1) THEN 'itself' WHEN {_SELF} > 0 THEN 'tangled' WHEN end1 - start1 < 10 THEN 'short' WHEN {_SS} < 0.96 THEN 'dissimilar' ELSE 'kept' END AS reason FROM hom), k AS (SELECT * FROM c WHERE reason IN ('kept', 'tangled')),
    p AS (SELECT chrom_id, s AS x, 1 AS d FROM k UNION ALL SELECT chrom_id, e, -1 FROM k), q AS (SELECT chrom_id, x, sum(d) AS d FROM p GROUP BY 1, 2), z AS (SELECT chrom_id, x AS s, lead(x) OVER w AS e, sum(d) OVER w AS n FROM q WINDOW w AS (PARTITION BY chrom_id ORDER BY x)), crowded AS (SELECT * FROM z WHERE n > 10),
    out AS (SELECT DISTINCT dup_id FROM k JOIN crowded z ON z.chrom_id = k.chrom_id AND z.s < k.e AND k.s < z.e)
    SELECT dup_id AS hit_id, chrom_id, s, e, strand, chrom2, s2, e2, reason = 'tangled' AS is_tangled FROM k WHERE dup_id NOT IN (SELECT dup_id FROM out)""", "hom")
def pretable_hits(spark, d) -> DataFrame:
    """Duplications of hits, without stretches that too many share."""
    return hm.pretable(hits(spark, d), max_homologies=10, shortest=10).select("hit_id", "chrom_id", "s", "e", "strand", "chrom2", "s2", "e2", "is_tangled")


@query()
def m01_combined_table(spark, d) -> DataFrame:
    """The homology table: overlapping duplications joined along their graph."""
    return hm.combine(rel.one_of_each(hits(spark, d).filter("similarity >= 0.96"), "hit_id"))


@query()
def m10_agcn_profile(spark, d) -> DataFrame:
    """Copy numbers of 12-hour windows: a background by GC, then the hidden Markov model over each locus."""
    w = view(spark, d, "win_depth")
    bg = dp.background(w, "depth1", 0.5).select("sample_id", "gc", (F.col("nb_n") / 2).alias("nb_n"), "nb_p")
    depths = w.join(bg, ["sample_id", "gc"]).select(F.floor(F.col("window_ix") / 30).alias("locus"), "sample_id", "window_ix", F.col("depth1").alias("depth"), "nb_n", "nb_p")
    return cn.copy_number_profiles(depths, cn.HmmConfig(least_samples=5, iterations=10), reference_cn=2).withColumn("cn_qual", F.round("cn_qual", 3)).withColumn("multiplier", F.round("multiplier", 4))


@query()
def m11_path_weights(spark, d) -> DataFrame:
    return cn.path_weights(m10_agcn_profile(spark, d))


def _alleles(spark, d) -> DataFrame:
    a = view(spark, d, "allele_counts")
    return a.select(F.floor(F.col("psv_ix") / 10).alias("locus"), "psv_ix", "sample_id", F.col("n0").alias("n1"), F.col("n1").alias("n2"), F.lit(4).cast("bigint").alias("agcn"))


@query()
def m17_reliable_psvs(spark, d) -> DataFrame:
    return pl.f_values(_alleles(spark, d)).select("locus", "psv_ix", F.round("f1", 3).alias("f1"), F.round("f2", 3).alias("f2"), F.round("info", 6).alias("info"), "reliable")


@query()
def m20_pscn(spark, d) -> DataFrame:
    return pl.paralog_copy_numbers(_alleles(spark, d))


_GT = "(VALUES " + ", ".join(f"({k}, {g[0]}, {g[1]}, {g[2]}, '{'/'.join(str(i) for i, n in enumerate(g) for _ in range(n))}')" for k, g in enumerate(genotypes(3, 4))) + ") g(k, g0, g1, g2, gt)"
_W = [f"greatest(CAST(g{i} AS DOUBLE), 0.04)" for i in range(3)]


@query(f"""WITH l AS (SELECT psv_ix, sample_id, k, gt, {' + '.join(f'n{i} * ln({_W[i]} / ({" + ".join(_W)}))' for i in range(3))} AS ll FROM allele_counts, {_GT}),
    n AS (SELECT *, ll - m - ln(sum(exp(ll - m)) OVER (PARTITION BY psv_ix, sample_id)) AS lp FROM (SELECT *, max(ll) OVER (PARTITION BY psv_ix, sample_id) AS m FROM l)),
    r AS (SELECT *, row_number() OVER (PARTITION BY psv_ix, sample_id ORDER BY round(lp, 9) DESC, k) AS rn FROM n)
    SELECT psv_ix AS variant_id, sample_id, max(gt) FILTER (rn = 1) AS gt, round(least(10000, -10 * log10(sum(exp(lp)) FILTER (rn > 1))), 4) AS gq, count(*) FILTER (exp(lp) >= 1e-5) AS n_likely FROM r GROUP BY 1, 2""", "allele_counts")
def m28_pooled_genotypes(spark, d) -> DataFrame:
    a = view(spark, d, "allele_counts").select(F.col("psv_ix").alias("variant_id"), "sample_id", F.posexplode(F.array("n0", "n1", "n2")).alias("allele_ix", "n"))
    return ca.pooled_genotypes(a, 4, 3).withColumn("gq", F.round("gq", 4))


@query("""WITH c AS (SELECT psv_ix AS variant_id, CAST(sum(n0) AS BIGINT) AS a0, CAST(sum(n1) AS BIGINT) AS a1, CAST(sum(n2) AS BIGINT) AS a2 FROM allele_counts GROUP BY 1), t AS (SELECT variant_id, unnest([a0, a1]) AS x, unnest([a1, a2]) AS y, a0 + a1 AS tx, a1 + a2 AS ty FROM c),
    k AS (SELECT *, unnest(range(greatest(0, x + y + tx - tx - ty), least(x + y, tx) + 1)) AS k FROM t), l AS (SELECT *, lgamma(x + y + 1) + lgamma(tx + ty - x - y + 1) + lgamma(tx + 1) + lgamma(ty + 1) - lgamma(tx + ty + 1) - lgamma(k + 1) - lgamma(x + y - k + 1) - lgamma(tx - k + 1) - lgamma(ty - x - y + k + 1) AS p FROM k),
    s AS (SELECT *, max(CASE WHEN k = x THEN p END) OVER (PARTITION BY variant_id, x, y) AS own FROM l), q AS (SELECT variant_id, x, y, least(1, sum(exp(p)) FILTER (p <= own + 1e-7)) AS p FROM s GROUP BY 1, 2, 3)
    SELECT variant_id, round(max(abs(-10 * log10(greatest(p, 1e-300)))), 4) AS bias FROM q GROUP BY 1""", "allele_counts")
def g19_strand_bias(spark, d) -> DataFrame:
    c = view(spark, d, "allele_counts").groupBy(F.col("psv_ix").alias("variant_id")).agg(F.sum("n0").alias("a0"), F.sum("n1").alias("a1"), F.sum("n2").alias("a2"))
    counts = c.select("variant_id", F.posexplode(F.array(F.struct(F.col("a0").alias("f"), F.col("a1").alias("r")), F.struct(F.col("a1").alias("f"), F.col("a2").alias("r")))).alias("allele_ix", "v"))
    return ca.bias(counts.select("variant_id", "allele_ix", F.col("v.f").alias("fwd"), F.col("v.r").alias("rev")), ("fwd", "rev")).withColumn("bias", F.round("bias", 4))


@query("""WITH RECURSIVE v AS (SELECT b_id AS variant_id, chrom_id, s, least(e, s + 12) AS e, CAST(b_id % 101 AS BIGINT) AS quality FROM iv_b), m AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY chrom_id ORDER BY s, e, variant_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM v), g AS (SELECT *, sum(nw) OVER (PARTITION BY chrom_id ORDER BY s, e, variant_id ROWS UNBOUNDED PRECEDING) AS g FROM m), o AS (SELECT variant_id, chrom_id, s, e, quality, g, row_number() OVER (PARTITION BY chrom_id, g ORDER BY quality DESC, s, variant_id) AS i FROM g),
    r AS (SELECT *, [{'s': s, 'e': e}] AS kept, true AS stays FROM o WHERE i = 1 UNION ALL SELECT o.*, CASE WHEN len(list_filter(r.kept, lambda k: o.e > k.s AND o.s < k.e)) = 0 THEN list_append(r.kept, {'s': o.s, 'e': o.e}) ELSE r.kept END, len(list_filter(r.kept, lambda k: o.e > k.s AND o.s < k.e)) = 0 FROM r JOIN o ON o.chrom_id = r.chrom_id AND o.g = r.g AND o.i = r.i + 1)
    SELECT variant_id, chrom_id, s, e, quality FROM r WHERE stays""", "iv_b")
def w15_resolved_variants(spark, d) -> DataFrame:
    v = view(spark, d, "iv_b").select(F.col("b_id").alias("variant_id"), "chrom_id", "s", F.least("e", F.col("s") + 12).alias("e"), (F.col("b_id") % 101).alias("quality"))
    return ca.resolve_overlaps(v)


@query("""WITH RECURSIVE v AS (SELECT b_id AS variant_id, chrom_id, s, (b_id % 101) / 100.0 AS info, b_id % 2 = 0 AS is_snp FROM iv_b), m AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY chrom_id ORDER BY s, variant_id) <= 40 THEN 0 ELSE 1 END AS nw FROM v), g AS (SELECT *, sum(nw) OVER (PARTITION BY chrom_id ORDER BY s, variant_id ROWS UNBOUNDED PRECEDING) AS g FROM m), o AS (SELECT variant_id, chrom_id, s, info, is_snp, g, row_number() OVER (PARTITION BY chrom_id, g ORDER BY info DESC, NOT is_snp, s, variant_id) AS i FROM g),
    r AS (SELECT *, [s] AS kept, true AS stays FROM o WHERE i = 1 UNION ALL SELECT o.*, CASE WHEN len(list_filter(r.kept, lambda k: abs(o.s - k) <= 40)) = 0 THEN list_append(r.kept, o.s) ELSE r.kept END, len(list_filter(r.kept, lambda k: abs(o.s - k) <= 40)) = 0 FROM r JOIN o ON o.chrom_id = r.chrom_id AND o.g = r.g AND o.i = r.i + 1)
    SELECT variant_id, chrom_id, s, info, is_snp FROM r WHERE stays""", "iv_b")
def w16_suppressed_variants(spark, d) -> DataFrame:
    v = view(spark, d, "iv_b").select(F.col("b_id").alias("variant_id"), "chrom_id", "s", ((F.col("b_id") % 101) / 100).alias("info"), (F.col("b_id") % 2 == 0).alias("is_snp"))
    return ca.suppress_close(v, 40)


@query()
def l12_alignment(spark, d) -> DataFrame:
    """Global alignments of each benchmark passage with the one after it."""
    b = view(spark, d, "benchmark").select("item_id", F.col("text").alias("a"))
    c = view(spark, d, "benchmark").select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("b"))
    return al.align_pairs(b.join(c, "item_id"), "a", "b").select("item_id", "cigar", "score")


@query("SELECT variant_id, sample_id, copy, round(w - max(w) OVER k - ln(sum(exp(w - m)) OVER k), 9) AS ln_prob FROM (SELECT *, max(w) OVER (PARTITION BY variant_id, sample_id) AS m FROM (SELECT psv_ix AS variant_id, sample_id, unnest([0, 1, 2]) AS copy, unnest([-n0 / 5.0, -n1 / 5.0, -n2 / 5.0]) AS w FROM allele_counts)) WINDOW k AS (PARTITION BY variant_id, sample_id)", "allele_counts")
def m27_location_probabilities(spark, d) -> DataFrame:
    weights = view(spark, d, "allele_counts").select("sample_id", F.col("psv_ix").alias("read_id"), F.posexplode(F.array(*(-F.col(c) / 5 for c in ("n0", "n1", "n2")))).alias("copy", "ln_weight"))
    return ca.location_probabilities(weights).select(F.col("read_id").alias("variant_id"), "sample_id", "copy", F.round("ln_prob", 9).alias("ln_prob"))


_NB = "lgamma(d + n) - lgamma(n) - lgamma(d + 1) + n * ln(0.3) + d * ln(0.7)"


@query(f"""WITH e AS (SELECT sample_id, window_ix, c, {_NB} AS x FROM (SELECT sample_id, window_ix, CAST(depth1 AS DOUBLE) AS d, c, gc / 10.0 * CASE WHEN c = 0 THEN 0.01 ELSE c END AS n FROM win_depth, range(0, 5) t(c)))
    SELECT sample_id, window_ix, c AS cn, round(x - m - ln(sum(exp(x - m)) OVER (PARTITION BY sample_id, window_ix)), 6) AS ln_p FROM (SELECT *, max(x) OVER (PARTITION BY sample_id, window_ix) AS m FROM e)""", "win_depth")
def m07_emissions(spark, d) -> DataFrame:
    """Negative binomial emissions of each window's depth for up to four copies."""
    w = view(spark, d, "win_depth").select("sample_id", "window_ix", "depth1", (F.col("gc") / 10).alias("n"), F.lit(0.3).alias("p"))
    return cn.with_emissions(w, "depth1", "n", "p", 5).select("sample_id", "window_ix", F.posexplode("emissions").alias("cn", "ln_p")).withColumn("cn", F.col("cn").cast("bigint")).withColumn("ln_p", F.round("ln_p", 6))


_LSE = "greatest({a}, {b}) + ln(1 + exp(-abs({a} - ({b}))))"
_STEP = {k: {"a": f"r.{k}0 + ln(0.9)", "b": f"r.{k}1 + ln(0.1)"} for k in "av"}
_BACK = {k: {"a": f"r.{k}0 + ln(0.1)", "b": f"r.{k}1 + ln(0.9)"} for k in "av"}


@query(f"""WITH RECURSIVE w AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY window_ix) AS i, count(*) OVER (PARTITION BY sample_id) AS n, -depth1 / 10.0 AS e0, -pow(depth1 - 8, 2) / 20.0 AS e1 FROM win_depth),
    r AS (SELECT sample_id, i, n, ln(0.5) + e0 AS a0, ln(0.5) + e1 AS a1, ln(0.5) + e0 AS v0, ln(0.5) + e1 AS v1 FROM w WHERE i = 1
    UNION ALL SELECT w.sample_id, w.i, w.n, w.e0 + {_LSE.format(**_STEP['a'])}, w.e1 + {_LSE.format(**_BACK['a'])}, w.e0 + greatest({_STEP['v']['a']}, {_STEP['v']['b']}), w.e1 + greatest({_BACK['v']['a']}, {_BACK['v']['b']}) FROM r JOIN w ON w.sample_id = r.sample_id AND w.i = r.i + 1)
    SELECT sample_id, round({_LSE.format(a='a0', b='a1')}, 6) AS total, round(greatest(v0, v1), 6) AS best FROM r WHERE i = n""", "win_depth")
def m04_chain_likelihoods(spark, d) -> DataFrame:
    """Forward, Viterbi and path likelihoods of a chain with two states over each sample's windows."""
    e = F.array(-F.col("depth1") / 10, -F.pow(F.col("depth1") - 8, F.lit(2.0)) / 20)
    scores = cn.chain_scores(view(spark, d, "win_depth").select("sample_id", "window_ix", e.alias("e")), ["sample_id"], "window_ix", "e", 0.9)
    return scores.select("sample_id", F.round("total", 6).alias("total"), F.round("best", 6).alias("best"))


@query("SELECT psv_ix, sample_id, concat(CAST(4 - k AS STRING), ',', CAST(k AS STRING)) AS split, round(n0 * ln(greatest(0.01, least(0.99, (4 - k) / 4.0))) + n1 * ln(greatest(0.01, least(0.99, k / 4.0))), 6) AS ln_p FROM allele_counts, range(0, 5) t(k)", "allele_counts")
def m13_psv_support(spark, d) -> DataFrame:
    """ln P(counts | split) of every variant and sample, where each copy always has its own allele."""
    rows = pl.with_psv_support(view(spark, d, "allele_counts").withColumn("f", F.array(F.lit(1.0), F.lit(1.0))), "n0", "n1", "f", 4)
    each = rows.select("psv_ix", "sample_id", F.posexplode("support").alias("k", "p"))
    return each.select("psv_ix", "sample_id", F.concat_ws(",", (4 - F.col("k")).cast("string"), F.col("k").cast("string")).alias("split"), F.round("p", 6).alias("ln_p"))

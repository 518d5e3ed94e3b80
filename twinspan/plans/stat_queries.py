"""Queries of aggregations, depth models, genotypes, sequences and CIGAR algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import logmath as lm
from ..operators import cigars as cg
from ..operators import depth as dp
from ..operators import genotypes as gt
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


# ----------------------------------------------------------------depth and aggregates
@query("""SELECT sample_id, CAST(floor(pos / 43200.0) AS BIGINT) AS window_ix, count(*) FILTER (is_read2 = 0) AS depth1, count(*) FILTER (is_read2 = 1) AS depth2, count(*) FILTER (mapq < 10) AS low_mapq,
    count(*) FILTER (clipped = 1) AS clipped, count(*) FILTER (unpaired = 1) AS unpaired FROM reads WHERE flag & 3844 = 0 GROUP BY 1, 2""", "reads")
def g01_window_counts(spark, d) -> DataFrame:
    return dp.window_counts(view(spark, d, "reads"), 43200)


_NB = "CASE WHEN var > mean + 0.01 THEN var ELSE mean + 0.01 END"


@query(f"""WITH m AS (SELECT sample_id, gc, avg(depth1) AS mean, var_pop(depth1) AS var FROM win_depth GROUP BY 1, 2), c AS (SELECT sample_id, gc, mean, mean * mean / ({_NB} - mean) AS n, mean / ({_NB}) AS p FROM m)
    SELECT w.sample_id, w.window_ix, round(w.depth1 / (c.n * (1 - c.p) / c.p), 6) AS norm_cn1 FROM win_depth w JOIN c ON w.sample_id = c.sample_id AND w.gc = c.gc WHERE c.mean > 0""", "win_depth")
def g02_normalized_depth(spark, d) -> DataFrame:
    w = view(spark, d, "win_depth")
    m = w.groupBy("sample_id", "gc").agg(F.avg("depth1").alias("mean"), F.var_pop("depth1").alias("var")).filter("mean > 0")
    n, p = dp.nb_parameters(F.col("mean"), F.col("var"))
    return w.join(m, ["sample_id", "gc"]).select("sample_id", "window_ix", F.round(dp.normalized_cn(F.col("depth1"), n, p), 6).alias("norm_cn1"))


@query("SELECT psv_ix, sample_id, n0, n1, n2, CAST(n0 + n1 + n2 AS BIGINT) AS total, n0 + n1 > 0 AND n2 < 0.4 * (n0 + n1 + n2) AS usable FROM allele_counts", "allele_counts")
def g04_allele_counts(spark, d) -> DataFrame:
    a = view(spark, d, "allele_counts")
    usable = gt.usable_alleles(F.array("n0", "n1"), F.lit(0).cast("bigint"), F.col("n2"), 0.4) & (F.col("n0") + F.col("n1") > 0)
    return a.select("psv_ix", "sample_id", "n0", "n1", "n2", (F.col("n0") + F.col("n1") + F.col("n2")).alias("total"), usable.alias("usable"))


@query("SELECT sample_id, gc, count(*) AS n_windows, round(avg(depth1), 6) AS mean, round(var_pop(depth1), 6) AS var, quantile_cont(depth1, 0.25) AS q1, quantile_cont(depth1, 0.5) AS q2, quantile_cont(depth1, 0.75) AS q3 FROM win_depth GROUP BY 1, 2", "win_depth")
def g05_gc_stats(spark, d) -> DataFrame:
    s = dp.gc_stats(view(spark, d, "win_depth"))
    return s.select("sample_id", "gc", "n_windows", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"), *(F.col("quartiles")[i].alias(f"q{i}") for i in (1, 2, 3)))


@query("SELECT gc, n, below, above, below >= 50 AND above >= 50 AS usable FROM (SELECT gc, n, CAST(sum(n) OVER (ORDER BY gc) AS BIGINT) AS below, CAST(sum(n) OVER (ORDER BY gc DESC) AS BIGINT) AS above FROM (SELECT gc, count(*) AS n FROM win_depth GROUP BY 1))", "win_depth")
def g06_histogram_range(spark, d) -> DataFrame:
    return dp.gc_range(view(spark, d, "win_depth"), 50)


@query()
def g07_loess(spark, d) -> DataFrame:
    """Local fits by GC: grouped code over at most 101 bins a sample, checked against direct fits in the tests."""
    return dp.smooth_by_gc(view(spark, d, "win_depth"), "depth1", 0.4).select("sample_id", "gc", F.round("mean_loess", 6).alias("mean_loess"), F.round("var_loess", 6).alias("var_loess"))


@query(f"""WITH m AS (SELECT sample_id, avg(depth1) AS mean, var_pop(depth1) AS var FROM win_depth GROUP BY 1) SELECT sample_id, round(mean * mean / ({_NB} - mean), 5) AS nb_n, round(mean / ({_NB}), 8) AS nb_p FROM m""", "win_depth")
def g09_nb_fit(spark, d) -> DataFrame:
    m = view(spark, d, "win_depth").groupBy("sample_id").agg(F.avg("depth1").alias("mean"), F.var_pop("depth1").alias("var"))
    n, p = dp.nb_parameters(F.col("mean"), F.col("var"))
    return m.select("sample_id", F.round(n, 5).alias("nb_n"), F.round(p, 8).alias("nb_p"))


@query("WITH v AS (SELECT sample_id, var_pop(depth1) / avg(depth1) AS vmr FROM win_depth WHERE gc = 37 GROUP BY 1) SELECT sample_id, round(vmr, 6) AS vmr, vmr <= (SELECT quantile_cont(vmr, 0.6) FROM v) AS kept FROM v", "win_depth")
def g10_vmr_filter(spark, d) -> DataFrame:
    s = dp.gc_stats(view(spark, d, "win_depth"))
    return dp.variance_to_mean(s, 37, percentile=60).withColumn("vmr", F.round("vmr", 6))


@query("SELECT l_returnflag AS reason, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 6) AS percent FROM lineitem GROUP BY 1")
def g11_reason_histogram(spark, d) -> DataFrame:
    counts = view(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))  # over the few reasons
    return counts.withColumn("percent", F.round(100 * share, 6))


@query("SELECT chrom_id, cn, round(w / sum(w) OVER (PARTITION BY chrom_id), 9) AS freq FROM (SELECT a.chrom_id, b.b_id % 5 AS cn, CAST(sum(least(a.e,b.e)-greatest(a.s,b.s)) AS DOUBLE) AS w FROM iv_a a JOIN iv_b b ON a.chrom_id = b.chrom_id AND a.s < b.e AND b.s < a.e GROUP BY 1, 2)", "iv_a", "iv_b")
def g13_weighted_frequency(spark, d) -> DataFrame:
    """Copy numbers of a region weighted by the bases that each covers."""
    pairs = iv.overlap_join(view(spark, d, "iv_a"), view(spark, d, "iv_b"))
    size = iv.overlap_size(F.col("s"), F.col("e"), F.col("b_s"), F.col("b_e"))
    w = pairs.groupBy("chrom_id", (F.col("b_b_id") % 5).alias("cn")).agg(F.sum(size).cast("double").alias("w"))
    return w.select("chrom_id", "cn", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("chrom_id")), 9).alias("freq"))


@query("SELECT psv_ix, round(max(lp) + ln(sum(exp(lp - m))), 9) AS total FROM (SELECT psv_ix, -n0 / 10.0 AS lp, max(-n0 / 10.0) OVER (PARTITION BY psv_ix) AS m FROM allele_counts) GROUP BY 1", "allele_counts")
def g14_logsumexp(spark, d) -> DataFrame:
    """Two aggregations and a join on the key; values are never gathered."""
    a = view(spark, d, "allele_counts").select("psv_ix", (-F.col("n0") / 10).alias("lp"))
    top = a.groupBy("psv_ix").agg(F.max("lp").alias("m"))
    return a.join(top, "psv_ix").groupBy("psv_ix").agg(F.round(F.max("m") + F.ln(F.sum(F.exp(F.col("lp") - F.col("m")))), 9).alias("total"))


@query("SELECT chrom_id, cn FROM (SELECT chrom_id, cn, row_number() OVER (PARTITION BY chrom_id ORDER BY w DESC, cn) AS rn FROM (SELECT chrom_id, b_id % 5 AS cn, sum(e - s) AS w FROM iv_b GROUP BY 1, 2)) WHERE rn = 1", "iv_b")
def g15_mode_by_length(spark, d) -> DataFrame:
    w = view(spark, d, "iv_b").groupBy("chrom_id", (F.col("b_id") % 5).alias("cn")).agg(F.sum(F.col("e") - F.col("s")).alias("w"))
    return w.groupBy("chrom_id").agg(F.max_by("cn", F.struct(F.col("w"), -F.col("cn"))).alias("cn"))


@query("SELECT psv_ix, round(avg(CAST(n1 + n2 AS DOUBLE) / (n0 + n1 + n2)), 9) AS info FROM allele_counts GROUP BY 1", "allele_counts")
def g16_information_content(spark, d) -> DataFrame:
    alt = (F.col("n1") + F.col("n2")) / (F.col("n0") + F.col("n1") + F.col("n2"))
    return view(spark, d, "allele_counts").groupBy("psv_ix").agg(F.round(F.avg(alt), 9).alias("info"))


_PASS = "(depth1 + depth2 = 0 OR CAST(low_mapq AS DOUBLE)/(depth1+depth2) <= 0.2 AND CAST(clipped AS DOUBLE)/(depth1+depth2) <= 0.1 AND CAST(unpaired AS DOUBLE)/(depth1+depth2) <= 0.1)"


@query(f"SELECT window_ix, count(*) AS n, count(*) FILTER (NOT {_PASS}) AS failed, count(*) FILTER (NOT {_PASS}) > 0.1 * count(*) AS drop FROM win_depth GROUP BY 1", "win_depth")
def g18_failed_windows(spark, d) -> DataFrame:
    return dp.failed_windows(view(spark, d, "win_depth"), rel.window_passes(low_mapq=0.2))


@query("SELECT l_partkey % 50 AS psv_ix, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS a_f FROM lineitem GROUP BY 1")
def g20_allele_pivot(spark, d) -> DataFrame:
    of = lambda c, k: F.count_if(c).alias(k)
    flag = F.col("l_returnflag")
    return view(spark, d, "lineitem").groupBy((F.col("l_partkey") % 50).alias("psv_ix")).agg(of(flag == "A", "a"), of(flag == "N", "n"), of(flag == "R", "r"), of((flag == "A") & (F.col("l_linestatus") == "F"), "a_f"))


@query("""WITH x AS (SELECT psv_ix, unnest([CASE WHEN n0 >= n1 THEN 0 ELSE 1 END, CASE WHEN n2 > n0 THEN 2 ELSE 0 END]) AS allele FROM allele_counts)
    SELECT psv_ix, CAST(allele AS BIGINT) AS allele, count(*) AS ac, sum(count(*)) OVER (PARTITION BY psv_ix)::BIGINT AS an, round(count(*) / sum(count(*)) OVER (PARTITION BY psv_ix), 9) AS af FROM x GROUP BY 1, 2""", "allele_counts")
def g21_an_ac_af(spark, d) -> DataFrame:
    called = F.array(F.when(F.col("n0") >= F.col("n1"), 0).otherwise(1), F.when(F.col("n2") > F.col("n0"), 2).otherwise(0))
    return gt.allele_statistics(view(spark, d, "allele_counts"), "psv_ix", called).withColumn("af", F.round("af", 9)).withColumn("allele", F.col("allele").cast("bigint"))


@query("SELECT psv_ix, round(least(10000, -10 / ln(10) * sum(ln((n0 + 1.0) / (n0 + n1 + n2 + 3)))), 6) AS quality FROM allele_counts GROUP BY 1", "allele_counts")
def g21_site_quality(spark, d) -> DataFrame:
    """How sure it is that some sample isn't the reference, where each has it with the share of its allele."""
    ln_reference = F.ln((F.col("n0") + 1) / (F.col("n0") + F.col("n1") + F.col("n2") + 3))
    return view(spark, d, "allele_counts").groupBy("psv_ix").agg(F.round(gt.site_quality(ln_reference), 6).alias("quality"))


@query("SELECT sample_id, round(avg(depth1 + depth2), 6) AS mean_depth, CAST(floor(min(depth1)) AS BIGINT) AS low, CAST(ceil(max(depth1)) AS BIGINT) AS high FROM win_depth GROUP BY 1", "win_depth")
def g23_mean_depth(spark, d) -> DataFrame:
    return view(spark, d, "win_depth").groupBy("sample_id").agg(F.round(F.avg(F.col("depth1") + F.col("depth2")), 6).alias("mean_depth"), F.min("depth1").alias("low"), F.max("depth1").alias("high"))


@query("SELECT window_ix, " + ", ".join(f"CAST(sum(CASE WHEN sample_id = {k} THEN depth1 ELSE 0 END) AS BIGINT) AS s{k}" for k in range(10)) + " FROM win_depth GROUP BY 1", "win_depth")
def g24_depth_matrix(spark, d) -> DataFrame:
    p = view(spark, d, "win_depth").groupBy("window_ix").pivot("sample_id", list(range(10))).agg(F.sum("depth1"))
    return p.select("window_ix", *(F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(f"s{k}") for k in range(10)))


@query("SELECT sample_id, state, count(*) AS n FROM cn_runs GROUP BY 1, 2", "cn_runs")
def g27_state_frequency(spark, d) -> DataFrame:
    return view(spark, d, "cn_runs").groupBy("sample_id", "state").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@query("SELECT sample_id, quantile_cont(depth1, 0.5) AS median FROM win_depth GROUP BY 1", "win_depth")
def g28_median_depth(spark, d) -> DataFrame:
    return view(spark, d, "win_depth").groupBy("sample_id").agg(F.median("depth1").alias("median"))


@query("SELECT sample_id, CAST((rn - 1) // 5 AS BIGINT) AS block, round(avg(depth1), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY window_ix) AS rn FROM win_depth) GROUP BY 1, 2", "win_depth")
def g29_block_averages(spark, d) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("sample_id").orderBy("window_ix"))
    blocks = view(spark, d, "win_depth").withColumn("block", F.floor((rn - 1) / 5))
    return blocks.groupBy("sample_id", "block").agg(F.round(F.avg("depth1"), 6).alias("mean"))


@query("SELECT state, nxt, count(*) AS n FROM (SELECT state, lead(state) OVER (PARTITION BY sample_id ORDER BY ix) AS nxt FROM cn_runs) WHERE nxt IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5", "cn_runs")
def g30_transitions(spark, d) -> DataFrame:
    w = Window.partitionBy("sample_id").orderBy("ix")
    return view(spark, d, "cn_runs").withColumn("nxt", F.lead("state").over(w)).filter("nxt is not null").groupBy("state", "nxt").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


# ----------------------------------------------------------------scalar functions and genotypes
@query("""WITH x AS (SELECT psv_ix, sample_id, unnest([-n0/10.0, -n1/10.0, -n2/10.0]) AS lp, unnest([0, 1, 2]) AS k FROM allele_counts), m AS (SELECT *, max(lp) OVER (PARTITION BY psv_ix, sample_id) AS m, max(lp) FILTER (k <> 0) OVER (PARTITION BY psv_ix, sample_id) AS o FROM x),
    t AS (SELECT psv_ix, sample_id, max(m) + ln(sum(exp(lp - m))) AS total, max(o) + ln(sum(exp(lp - o)) FILTER (k <> 0)) AS others FROM m GROUP BY 1, 2)
    SELECT psv_ix, sample_id, round(total, 9) AS total, round(least(10000, (total - others) * 10 / ln(10)), 6) AS phred FROM t""", "allele_counts")
def f04_phred(spark, d) -> DataFrame:
    values = F.array(*(-F.col(c) / 10 for c in ("n0", "n1", "n2")))
    return view(spark, d, "allele_counts").select("psv_ix", "sample_id", F.round(lm.logsumexp(values), 9).alias("total"), F.round(lm.phred_of_best(values, 0), 6).alias("phred"))


@query("SELECT psv_ix, sample_id, round(ln(1 - (exp(-1 - n0) + exp(-1 - n1) )), 9) + 0.0 AS rest FROM allele_counts", "allele_counts")
def f06_log1m_sum(spark, d) -> DataFrame:
    return view(spark, d, "allele_counts").select("psv_ix", "sample_id", (F.round(lm.log1m_sum(F.array(-1.0 - F.col("n0"), -1.0 - F.col("n1"))), 9) + F.lit(0.0)).alias("rest"))


@query("SELECT sample_id, window_ix, round(pow(1 - pow(least(abs((gc - 40) / 8.0), 1), 3), 3), 9) AS w FROM win_depth", "win_depth")
def f07_tricube(spark, d) -> DataFrame:
    return view(spark, d, "win_depth").select("sample_id", "window_ix", F.round(lm.tricube((F.col("gc") - 40) / 8), 9).alias("w"))


@query("SELECT o_orderkey, CASE WHEN v < 1000 THEN CAST(v AS STRING) || ' bp' WHEN v < 1000000 THEN CAST(v // 1000 AS STRING) || '.' || CAST(v % 1000 // 100 AS STRING) || ' kb' ELSE CAST(v // 1000000 AS STRING) || '.' || CAST(v % 1000000 // 100000 AS STRING) || ' Mb' END AS text FROM (SELECT o_orderkey, CAST(o_orderkey * 37 AS BIGINT) AS v FROM orders)")
def f08_length_text(spark, d) -> DataFrame:
    return view(spark, d, "orders").select("o_orderkey", cg.length_text((F.col("o_orderkey") * 37).cast("bigint")).alias("text"))


_GT = "(VALUES " + ", ".join(f"({k}, {g[0]}, {g[1]}, {g[2]})" for k, g in enumerate(lm.genotypes(3, 4))) + ") g(k, g0, g1, g2)"
_W = [f"greatest(CAST(g{i} AS DOUBLE), 0.04)" for i in range(3)]


@query(f"""WITH l AS (SELECT psv_ix, sample_id, k, g0, g1, g2, {' + '.join(f'n{i} * ln({_W[i]} / ({" + ".join(_W)}))' for i in range(3))} AS ll FROM allele_counts, {_GT}),
    n AS (SELECT *, ll - max(ll) OVER s - ln(sum(exp(ll - m)) OVER s) AS lp FROM (SELECT *, max(ll) OVER (PARTITION BY psv_ix, sample_id) AS m FROM l) WINDOW s AS (PARTITION BY psv_ix, sample_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY psv_ix, sample_id ORDER BY round(lp, 9) DESC, k) AS rn FROM n)
    SELECT psv_ix, sample_id, array_to_string(list_concat(list_concat(CAST([0 FOR x IN range(g0)] AS VARCHAR[]), CAST([1 FOR x IN range(g1)] AS VARCHAR[])), CAST([2 FOR x IN range(g2)] AS VARCHAR[])), '/') AS gt,
    round(lp, 6) + 0.0 AS best_log FROM r WHERE rn = 1""", "allele_counts")
def f12_genotype_likelihood(spark, d) -> DataFrame:
    a = view(spark, d, "allele_counts")
    logs = a.withColumn("_l", gt.log_likelihoods(F.array(*(F.col(f"n{i}").cast("double") for i in range(3))), 3, 4))
    rounded = F.transform("_l", lambda x: F.round(x, 9))
    best = logs.select("psv_ix", "sample_id", "_l", (F.array_position(rounded, F.array_max(rounded)) - 1).cast("int").alias("_b"))
    return best.select("psv_ix", "sample_id", gt.genotype_text(F.get(gt.genotype_table(3, 4), F.col("_b"))).alias("gt"), (F.round(F.get("_l", F.col("_b")), 6) + F.lit(0.0)).alias("best_log"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, round(lgamma(l_linenumber + l_suppkey % 9 + 1) - lgamma(l_linenumber + 1) - lgamma(l_suppkey % 9 + 1), 6) AS log_coefficient FROM lineitem")
def f13_multinomial_coeff(spark, d) -> DataFrame:
    counts = F.array(F.col("l_linenumber").cast("bigint"), (F.col("l_suppkey") % 9).cast("bigint"))
    return view(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.round(lm.multinomial_coefficient(counts), 6).alias("log_coefficient"))


@query("SELECT psv_ix, sample_id, CASE WHEN n0 <= 1 AND 1 > 0 THEN '<2' WHEN n0 >= 8 THEN '>7' ELSE CAST(n0 AS STRING) END AS cn FROM allele_counts", "allele_counts")
def f20_cn_text(spark, d) -> DataFrame:
    cn = gt.cn_text(F.col("n0"), F.lit(1), F.lit(8), F.lit(4))
    return view(spark, d, "allele_counts").select("psv_ix", "sample_id", F.when(F.col("n0") < 1, F.lit("<2")).when(F.col("n0") > 8, F.lit(">7")).otherwise(cn).alias("cn"))


@query("SELECT p_partkey, regexp_replace(p_name, '[^0-9a-zA-Z_:-]', '_', 'g') AS name FROM part")
def f21_safe_name(spark, d) -> DataFrame:
    return view(spark, d, "part").select("p_partkey", F.regexp_replace("p_name", "[^0-9a-zA-Z_:-]", "_").alias("name"))


@query("SELECT sample_id, state, start_ix, end_ix FROM (WITH c AS (SELECT *, CASE WHEN lag(state) OVER w = state THEN 0 ELSE 1 END AS ch FROM cn_runs WINDOW w AS (PARTITION BY sample_id ORDER BY ix)), r AS (SELECT *, sum(ch) OVER (PARTITION BY sample_id ORDER BY ix ROWS UNBOUNDED PRECEDING) AS k FROM c) SELECT sample_id, min(state) AS state, min(ix) AS start_ix, max(ix) + 1 AS end_ix FROM r GROUP BY sample_id, k) WHERE end_ix - start_ix >= 2", "cn_runs")
def w21_compatible_rows(spark, d) -> DataFrame:
    """Adjacent rows of one sample and state merged, single ones left out."""
    return iv.run_lengths(view(spark, d, "cn_runs"), "sample_id", "ix", "state").filter("end_ix - start_ix >= 2")


@query("SELECT chrom_id, s, e, n, 2 + 2 * n AS ref_cn FROM (WITH p AS (SELECT chrom_id, s AS x, 1 AS d FROM iv_b UNION ALL SELECT chrom_id, e, -1 FROM iv_b), q AS (SELECT chrom_id, x, sum(d) AS d FROM p GROUP BY 1, 2) SELECT chrom_id, x AS s, lead(x) OVER w AS e, CAST(sum(d) OVER w AS BIGINT) AS n FROM q WINDOW w AS (PARTITION BY chrom_id ORDER BY x)) WHERE n > 0", "iv_b")
def m35_examine(spark, d) -> DataFrame:
    """Disjoint regions with their reference copy number."""
    return iv.coverage(view(spark, d, "iv_b")).select("chrom_id", "s", "e", F.col("depth").alias("n"), (2 + 2 * F.col("depth")).alias("ref_cn"))


@query("SELECT sample_id, psv_ix, cns[k] AS cn, CAST(k AS BIGINT) AS copy FROM (SELECT sample_id, psv_ix, [n0, n1, n2] AS cns, unnest([1, 2, 3]) AS k FROM allele_counts)", "allele_counts")
def m33_paralog_rows(spark, d) -> DataFrame:
    """One row a copy of each paralog-specific result."""
    return view(spark, d, "allele_counts").select("sample_id", "psv_ix", F.posexplode(F.array("n0", "n1", "n2")).alias("p", "cn")).select("sample_id", "psv_ix", "cn", (F.col("p") + 1).cast("bigint").alias("copy"))


@query("SELECT psv_ix, count(*) AS n, CASE WHEN count(DISTINCT n0 > n1) = 1 THEN CAST(min(n0 > n1) AS STRING) ELSE '!' END AS value FROM allele_counts GROUP BY 1", "allele_counts")
def m34_matrix_value(spark, d) -> DataFrame:
    """A matrix cell: the one value of a region, or `!` where its rows disagree."""
    v = F.col("n0") > F.col("n1")
    return view(spark, d, "allele_counts").groupBy("psv_ix").agg(F.count(F.lit(1)).alias("n"), F.when(F.min(v) == F.max(v), F.min(v).cast("string")).otherwise("!").alias("value"))

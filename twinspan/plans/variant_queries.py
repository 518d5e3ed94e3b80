"""Queries of variant upkeep, read places and the remaining filters and functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calling as ca
from ..operators import genotypes as gt
from ..operators import variants as vr
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


@query("SELECT * FROM customer WHERE c_nationkey IN (1, 3, 5) AND c_nationkey <> 3")
def p09_locus_subset(spark, d) -> DataFrame:
    return view(spark, d, "customer").filter(F.col("c_nationkey").isin(1, 3, 5) & ~F.col("c_nationkey").isin(3))


@query("SELECT DISTINCT o_custkey AS missing FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def p10_missing_samples(spark, d) -> DataFrame:
    known = view(spark, d, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("missing"))
    return view(spark, d, "orders").select(F.col("o_custkey").alias("missing")).distinct().join(known, "missing", "left_anti")


@query("""SELECT psv_ix, sample_id, CASE WHEN tags = '' THEN 'PASS' ELSE tags END AS filter FROM (SELECT psv_ix, sample_id, concat_ws(';', CASE WHEN n2 > 8 THEN 'HighCN' END, CASE WHEN n0 % 5 = 0 THEN 'NoReliable' END,
    CASE WHEN n0 % 5 IN (1, 2) THEN 'FewReliable' END, CASE WHEN n1 / 40.0 < 0.99 THEN 'NoComplReliable' END, CASE WHEN n2 / 10.0 < 0.9 THEN 'LowInfoContent' END) AS tags FROM allele_counts)""", "allele_counts")
def p12_paralog_filters(spark, d) -> DataFrame:
    tags = vr.paralog_filters(F.col("n0") % 5, F.col("n1") / 40, F.col("n2") / 10, F.col("n2"))
    return view(spark, d, "allele_counts").select("psv_ix", "sample_id", tags.alias("filter"))


@query("""SELECT psv_ix, sample_id, CASE WHEN tags = '' THEN 'PASS' ELSE tags END AS filter FROM (SELECT psv_ix, sample_id, concat_ws(';', CASE WHEN n0 < 3 THEN 'LowReadDepth' END, CASE WHEN n0 > 2000 THEN 'HighReadDepth' END,
    CASE WHEN n1 > 30 THEN 'StrandBias' END, CASE WHEN n2 > 30 THEN 'UnpairedBias' END, CASE WHEN n2 % 3 = 0 THEN 'UnknownAgCN' END, CASE WHEN n2 % 3 <> 0 AND n1 % 4 = 0 THEN 'UnknownPsCN' END,
    CASE WHEN n1 % 4 = 1 THEN 'ZeroPsCN' END, CASE WHEN n0 % 6 = 5 THEN 'ConflictingCN' END, CASE WHEN n1 % 9 = 8 THEN 'OutOfBounds' END) AS tags FROM allele_counts)""", "allele_counts")
def p13_variant_filters(spark, d) -> DataFrame:
    agcn = F.when(F.col("n2") % 3 != 0, F.col("n2"))
    pscn = F.when(F.col("n1") % 4 == 1, 0).when(F.col("n1") % 4 != 0, F.col("n1"))
    return view(spark, d, "allele_counts").select("psv_ix", "sample_id", ca.variant_filters(F.col("n0"), F.col("n1"), F.col("n2"), agcn, pscn, F.col("n0") % 6 == 5, F.col("n1") % 9 == 8).alias("filter"))


@query("SELECT psv_ix, sample_id, CASE WHEN n0 % 7 = 0 THEN 'skip' WHEN n1 % 5 = 0 THEN 'zero_agcn' WHEN n2 % 4 = 0 THEN 'unknown_pscn' WHEN n0 % 3 = 0 THEN 'one_allele' WHEN n1 < 20 THEN 'low_reference_quality' ELSE 'ok' END AS reason FROM allele_counts", "allele_counts")
def p14_psv_usability(spark, d) -> DataFrame:
    reason = vr.usability(F.col("n1") % 5, F.when(F.col("n2") % 4 != 0, F.col("n2")), F.when(F.col("n0") % 3 == 0, 1).otherwise(2), F.col("n1"), F.col("n0") % 7 == 0)
    return view(spark, d, "allele_counts").select("psv_ix", "sample_id", reason.alias("reason"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_totalprice >= 100000")
def p15_low_quality_removal(spark, d) -> DataFrame:
    o = view(spark, d, "orders").select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("has_psv"), F.col("o_totalprice").alias("qual"))
    return vr.keep_variants(o, 100000).select("o_orderkey")


@query("SELECT psv_ix, sample_id FROM allele_counts WHERE n0 >= 18 AND n1 >= 18 AND n2 >= 18", "allele_counts")
def p20_reliable_mask(spark, d) -> DataFrame:
    return view(spark, d, "allele_counts").filter(gt.reliable(F.array("n0", "n1", "n2"), 18)).select("psv_ix", "sample_id")


@query("SELECT user_id, is_read2 = 1 AS is_first, pos + 50 AS pos FROM reads r WHERE NOT EXISTS (SELECT 1 FROM reads m WHERE m.user_id = r.user_id AND m.is_read2 = 1 - r.is_read2 AND m.pos = r.pos + 50)", "reads")
def j08_missing_mates(spark, d) -> DataFrame:
    """Mates expected 50 further on that aren't among the reads."""
    r = view(spark, d, "reads").select(F.col("user_id").alias("name"), (F.col("is_read2") == 0).alias("is_first"), "pos", (F.col("pos") + 50).alias("mate_pos"))
    return vr.missing_mates(r).select(F.col("name").alias("user_id"), "is_first", "pos")


@query("""WITH RECURSIVE o AS (SELECT user_id, is_read2, read_id, pos, row_number() OVER (PARTITION BY user_id, is_read2 ORDER BY pos, read_id) AS i FROM reads),
    r AS (SELECT *, pos AS last, true AS kept FROM o WHERE i = 1 UNION ALL SELECT o.*, CASE WHEN o.pos - r.last > 3600 THEN o.pos ELSE r.last END, o.pos - r.last > 3600 FROM r JOIN o ON o.user_id = r.user_id AND o.is_read2 = r.is_read2 AND o.i = r.i + 1)
    SELECT user_id AS name, is_read2 = 0 AS is_first, pos, read_id FROM r WHERE kept""", "reads")
def j10_near_repeats(spark, d) -> DataFrame:
    r = view(spark, d, "reads").select(F.col("user_id").alias("name"), (F.col("is_read2") == 0).alias("is_first"), "pos", "read_id")
    return vr.drop_near_repeats(r, 3600)


@query("SELECT l_orderkey, l_linenumber, l_quantity, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < DATE '1997-01-01'")
def j15_merge_streams(spark, d) -> DataFrame:
    """Two start-ordered streams on their common start: an equi join, extra rows of either side left out."""
    o = view(spark, d, "orders").filter("o_orderdate < date '1997-01-01'").select("o_orderkey", "o_totalprice")
    return view(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(o, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


@query("SELECT read_id, CASE WHEN clipped = 1 THEN 'unknown' WHEN pos % 40 < 20 THEN 'unique' WHEN mapq >= 50 THEN 'original' ELSE 'unknown' END AS location FROM reads", "reads")
def m26_read_locations(spark, d) -> DataFrame:
    """Reads of length 20 against unique stretches, which are the first half of every 40 positions of contig 0."""
    r = view(spark, d, "reads").select("read_id", F.lit(0).cast("bigint").alias("chrom_id"), "pos", "mapq", (F.col("clipped") == 1).alias("clipped"), F.lit("x").alias("oa"))
    s = F.floor(F.col("pos") / 40) * 40 + F.when(F.col("pos") % 40 < 20, 0).otherwise(20)
    r = r.withColumn("s", s).withColumn("e", F.col("s") + 20)
    unique = r.select("chrom_id", (F.floor(F.col("pos") / 40) * 40).alias("s")).distinct().withColumn("e", F.col("s") + 20)
    return ca.read_location(r, unique).select("read_id", "location")


@query("SELECT sample_id, psv_ix, CASE WHEN n0 >= n1 AND n0 >= n2 THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END AS state FROM allele_counts", "allele_counts")
def t03_probable_states(spark, d) -> DataFrame:
    """The best of the states that are likely enough, or of the best two."""
    p = view(spark, d, "allele_counts").select("sample_id", "psv_ix", F.posexplode(F.array(*(F.ln((F.col(c) + 0.0) / (F.col("n0") + F.col("n1") + F.col("n2"))) for c in ("n0", "n1", "n2")))).alias("state", "lp"))
    return vr.best_two(p.filter("lp is not null"), ["sample_id", "psv_ix"], "state", "lp").select("sample_id", "psv_ix", F.get("states", F.lit(0))["state"].alias("state"))


@query("""WITH RECURSIVE x AS (SELECT sample_id, window_ix, depth1, lag(depth1) OVER w AS l, lead(depth1) OVER w AS n FROM win_depth WINDOW w AS (PARTITION BY sample_id ORDER BY window_ix)),
    o AS (SELECT sample_id, window_ix, depth1, row_number() OVER (PARTITION BY sample_id ORDER BY depth1 DESC, window_ix) AS i FROM x WHERE depth1 >= 5 AND (l IS NULL OR depth1 >= l) AND (n IS NULL OR depth1 > n)),
    r AS (SELECT *, [window_ix] AS kept, true AS stays FROM o WHERE i = 1 UNION ALL SELECT o.*, CASE WHEN len(list_filter(r.kept, lambda k: abs(k - o.window_ix) < 5)) = 0 THEN list_append(r.kept, o.window_ix) ELSE r.kept END,
    len(list_filter(r.kept, lambda k: abs(k - o.window_ix) < 5)) = 0 FROM r JOIN o ON o.sample_id = r.sample_id AND o.i = r.i + 1) SELECT sample_id, window_ix, depth1 FROM r WHERE stays""", "win_depth")
def w07_peaks(spark, d) -> DataFrame:
    return vr.pick_peaks(view(spark, d, "win_depth"), "sample_id", "window_ix", "depth1", 5, 5)


@query()
def w14_smoothed_runs(spark, d) -> DataFrame:
    return vr.smooth_runs(view(spark, d, "win_depth").withColumn("high", F.col("depth1") > 8), "sample_id", "window_ix", "high", 3)


@query("""WITH RECURSIVE o AS (SELECT user_id, pos, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS i FROM reads),
    r AS (SELECT *, pos AS first, 1 AS g FROM o WHERE i = 1 UNION ALL SELECT o.*, CASE WHEN o.pos - r.pos <= 20000 AND o.pos - r.first <= 60000 THEN r.first ELSE o.pos END, r.g + CASE WHEN o.pos - r.pos <= 20000 AND o.pos - r.first <= 60000 THEN 0 ELSE 1 END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
    SELECT user_id, greatest(0, min(pos) - 10) AS s, max(pos) + 11 AS e, count(*) AS n FROM r GROUP BY user_id, g""", "reads")
def w18_read_clusters(spark, d) -> DataFrame:
    return vr.read_clusters(view(spark, d, "reads").select("user_id", "pos"), "user_id", "pos", 20_000, 60_000, 10)


@query("""WITH RECURSIVE o AS (SELECT chrom_id, b_id, s, e, row_number() OVER (PARTITION BY chrom_id ORDER BY s, b_id, e) AS i FROM iv_b),
    r AS (SELECT *, 0 AS g, e - s AS held FROM o WHERE i = 1 UNION ALL SELECT o.*, CASE WHEN r.e - r.s >= 95 OR o.e - o.s >= 95 OR r.held + o.e - o.s > 500 THEN r.g + 1 ELSE r.g END, CASE WHEN r.e - r.s >= 95 OR o.e - o.s >= 95 OR r.held + o.e - o.s > 500 THEN o.e - o.s ELSE r.held + o.e - o.s END
    FROM r JOIN o ON o.chrom_id = r.chrom_id AND o.i = r.i + 1) SELECT chrom_id, b_id, s, e, CAST(g AS BIGINT) AS group_ix FROM r""", "iv_b")
def w19_grouped_regions(spark, d) -> DataFrame:
    return vr.group_small_regions(view(spark, d, "iv_b").select("chrom_id", "b_id", "s", "e"), "chrom_id", 500, 95)


@query("SELECT psv_ix, array_to_string([CAST(n0 AS STRING), CASE WHEN n1 >= 5 THEN CAST(n1 AS STRING) WHEN n0 + n1 = n0 + n2 THEN '0' ELSE '?' END], ',') AS text, sample_id FROM allele_counts WHERE n1 <> n2 AND n0 >= 5 OR n0 >= 5 AND n1 >= 5", "allele_counts")
def f19_paralog_text(spark, d) -> DataFrame:
    a = view(spark, d, "allele_counts").filter("n1 <> n2 and n0 >= 5 or n0 >= 5 and n1 >= 5")
    text = gt.paralog_text(F.array("n0", "n1"), F.array(F.col("n0").cast("double"), F.col("n1").cast("double")), F.col("n0") + F.col("n2") + 1000)
    return a.select("psv_ix", text.alias("text"), "sample_id")


@query("SELECT o_orderkey, round(greatest(0.1, 20 - length(o_orderpriority) - 1) / greatest(greatest(0.1, 20 - length(o_orderpriority) - 1), greatest(0.1, 20 - length(o_orderstatus) - 1)), 9) AS p1, round(greatest(0.1, 20 - length(o_orderstatus) - 1) / greatest(greatest(0.1, 20 - length(o_orderpriority) - 1), greatest(0.1, 20 - length(o_orderstatus) - 1)), 9) AS p2 FROM orders")
def f14_allele_coverage(spark, d) -> DataFrame:
    p = gt.allele_coverage(F.array("o_orderpriority", "o_orderstatus"), 20)
    return view(spark, d, "orders").select("o_orderkey", F.inline(F.array(F.struct(p.alias("p"))))).select("o_orderkey", F.round(F.get("p", F.lit(0)), 9).alias("p1"), F.round(F.get("p", F.lit(1)), 9).alias("p2"))

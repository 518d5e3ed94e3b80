"""Queries of the interval algebra, joins, sweeps, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import info_value
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


_INFO = "CAST(regexp_extract(info, '(^|;){k}=([^;]*)', 2) AS DOUBLE)"
_SS, _LEN, _SEP, _MULT = (_INFO.format(k=k) for k in ("SS", "ALENGTH", "SEP", "av_mult"))


@query(f"""SELECT dup_id, chrom1, start1, end1, strand, chrom2, start2, end2 FROM hom
    WHERE is_tangled OR (({_LEN} >= 20 AND {_SS} > 0.95 OR strand = '-') AND NOT ({_LEN} < 5 AND {_SS} < 0.92))""", "hom")
def p01_expression_filter(spark, d) -> DataFrame:
    """View of the homology table: include and exclude expressions, which tangled rows bypass."""
    hom = view(spark, d, "hom")
    kept = rel.filter_homology(hom, include="length >= 20 && seq_sim > 0.95 || strand == '-'", exclude="length < 5 && seq_sim < 0.92")
    return kept.select("dup_id", "chrom1", "start1", "end1", "strand", "chrom2", "start2", "end2")


@query(f"SELECT dup_id, {_SEP} AS sep, {_LEN} AS length, {_SS} AS seq_sim, {_MULT} AS av_mult FROM hom", "hom")
def p02_typed_info(spark, d) -> DataFrame:
    number = lambda k: info_value(F.col("info"), k).try_cast("double")
    return view(spark, d, "hom").select("dup_id", number("SEP").alias("sep"), number("ALENGTH").alias("length"), number("SS").alias("seq_sim"), number("av_mult").alias("av_mult"))


@query("SELECT sample_id, count(*) AS n, CAST(sum(mapq) AS BIGINT) AS mapq FROM reads WHERE flag & 3844 = 0 GROUP BY 1", "reads")
def p05_flag_filter(spark, d) -> DataFrame:
    return rel.primary_reads(view(spark, d, "reads")).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("mapq").alias("mapq"))


@query("""SELECT sample_id, window_ix, depth1 + depth2 = 0 OR (depth1 <= 65535 AND depth2 <= 65535 AND CAST(low_mapq AS DOUBLE)/(depth1+depth2) <= 0.1
    AND CAST(clipped AS DOUBLE)/(depth1+depth2) <= 0.1 AND CAST(unpaired AS DOUBLE)/(depth1+depth2) <= 0.1) AS passes FROM win_depth""", "win_depth")
def p06_window_pass(spark, d) -> DataFrame:
    return view(spark, d, "win_depth").select("sample_id", "window_ix", rel.window_passes().alias("passes"))


@query("SELECT sample_id, window_ix, gc FROM win_depth WHERE gc >= 35 AND gc < 48", "win_depth")
def p07_gc_bounds(spark, d) -> DataFrame:
    return view(spark, d, "win_depth").filter((F.col("gc") >= 35) & (F.col("gc") < 48)).select("sample_id", "window_ix", "gc")


@query(f"""SELECT dup_id, CASE WHEN is_tangled THEN 'skip' WHEN {_LEN} < 5 AND {_SS} < 0.95 THEN 'exclude' WHEN {_LEN} < 10 THEN 'short' WHEN end1 > 26000 THEN 'out_of_contig' ELSE 'use' END AS route FROM hom""", "hom")
def p08_table_admission(spark, d) -> DataFrame:
    return view(spark, d, "hom").select("dup_id", rel.admission_route("length < 5 && seq_sim < 0.95", short=10, contig_length=26000).alias("route"))


@query("SELECT c_custkey, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN c_acctbal < 0 THEN ['LowBalance'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN c_nationkey < 5 THEN ['FewReliable'] ELSE CAST([] AS VARCHAR[]) END))), ';') AS tags FROM customer WHERE c_acctbal < 0 OR c_nationkey < 5 UNION ALL SELECT c_custkey, 'PASS' FROM customer WHERE NOT (c_acctbal < 0 OR c_nationkey < 5)")
def p11_filter_sets(spark, d) -> DataFrame:
    c = view(spark, d, "customer")
    return c.select("c_custkey", rel.filter_tags(LowBalance=F.col("c_acctbal") < 0, FewReliable=F.col("c_nationkey") < 5).alias("tags"))


@query("""SELECT w.sample_id, w.window_ix FROM win_depth w JOIN (SELECT sample_id, quantile_cont(depth1, 0.5) m1, quantile_cont(depth2, 0.5) m2 FROM win_depth GROUP BY 1) q
    ON w.sample_id = q.sample_id WHERE w.depth1 <= 1.2 * q.m1 AND w.depth2 <= 1.2 * q.m2""", "win_depth")
def p19_depth_cap(spark, d) -> DataFrame:
    return rel.depth_cap(view(spark, d, "win_depth"), 1.2).select("sample_id", "window_ix")


# ------------------------------------------------------------------ scalar interval functions
@query("""SELECT a.a_id, a.s, a.e, CAST(greatest(0, least(a.e, a.s + 30) - greatest(a.s, a.s % 97 * 100)) AS BIGINT) AS inter, a.s < a.s % 97 * 100 + 40 AND a.s % 97 * 100 < a.e AS touches,
    CAST(greatest(0, a.s - (a.s % 97 * 100 + 40) + 1, a.s % 97 * 100 - a.e + 1) AS BIGINT) AS dist, a.s <= a.s % 97 * 100 AND a.s % 97 * 100 + 40 <= a.e AS holds,
    CAST(greatest(0, a.s - 100) AS BIGINT) AS ps, CAST(least(26500, a.e + 100) AS BIGINT) AS pe,
    CASE WHEN a.s >= a.s % 97 * 100 + 40 OR a.s % 97 * 100 >= a.e THEN a.s WHEN a.s < a.s % 97 * 100 THEN a.s WHEN a.e > a.s % 97 * 100 + 40 THEN a.s % 97 * 100 + 40 END AS rs,
    CASE WHEN a.s >= a.s % 97 * 100 + 40 OR a.s % 97 * 100 >= a.e THEN a.e WHEN a.s < a.s % 97 * 100 THEN a.s % 97 * 100 WHEN a.e > a.s % 97 * 100 + 40 THEN a.e END AS re FROM iv_a a""", "iv_a")
def i01_interval_scalars(spark, d) -> DataFrame:
    s, e = F.col("s"), F.col("e")
    s2, e2, c = s % 97 * 100, s % 97 * 100 + 40, F.col("chrom_id")
    ps, pe = iv.padded(s, e, 100, F.lit(26500))
    rs, re = iv.subtract_first(s, e, s2, e2)
    return view(spark, d, "iv_a").select(
        "a_id", "s", "e", iv.overlap_size(s, e, s2, s + 30).alias("inter"),
        iv.intersects(c, s, e, c, s2, e2).alias("touches"), iv.distance(c, s, e, c, s2, e2).alias("dist"), iv.contains(s, e, s2, e2).alias("holds"), ps.alias("ps"), pe.alias("pe"), rs.alias("rs"), re.alias("re"),
    )


@query("SELECT a_id, s, e, concat('c', CAST(chrom_id AS STRING), ':', CAST(s+1 AS STRING), '-', CAST(e AS STRING)) AS region FROM iv_a", "iv_a")
def i06_region_text(spark, d) -> DataFrame:
    """Formats each region, parses the text again and returns what was read."""
    text = view(spark, d, "iv_a").select("a_id", iv.format_region(F.concat(F.lit("c"), F.col("chrom_id").cast("string")), F.col("s"), F.col("e")).alias("region"))
    return text.withColumn("p", iv.parse_region(F.col("region"))).select("a_id", F.col("p.start").alias("s"), F.col("p.end").alias("e"), "region")


@query("SELECT chrom_id, CAST(0 AS BIGINT) AS s, length AS e FROM contigs", "contigs")
def i07_whole_contigs(spark, d) -> DataFrame:
    return view(spark, d, "contigs").select("chrom_id", F.lit(0).cast("bigint").alias("s"), F.col("length").alias("e"))


# ------------------------------------------------------------------ joins
_PAIRS = "iv_a a JOIN iv_b b ON a.chrom_id = b.chrom_id AND a.s < b.e AND b.s < a.e"


@query("SELECT sample_id, CAST(floor(pos / 86400.0) AS BIGINT) AS window_ix, count(*) AS n FROM reads GROUP BY 1, 2", "reads")
def j01_point_in_window(spark, d) -> DataFrame:
    return iv.point_in_window(view(spark, d, "reads"), 86400).groupBy("sample_id", "window_ix").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT a.chrom_id, count(*) AS n, CAST(sum(least(a.e,b.e)-greatest(a.s,b.s)) AS BIGINT) AS overlap FROM {_PAIRS} GROUP BY 1", "iv_a", "iv_b")
def j02_interval_overlap_join(spark, d) -> DataFrame:
    pairs = iv.overlap_join(view(spark, d, "iv_a"), view(spark, d, "iv_b"), longest=100)
    size = iv.overlap_size(F.col("s"), F.col("e"), F.col("b_s"), F.col("b_e"))
    return pairs.groupBy("chrom_id").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("overlap"))


@query(f"SELECT b.b_id, count(*) AS n FROM {_PAIRS} WHERE a.s >= b.s AND a.e <= b.e GROUP BY 1", "iv_a", "iv_b")
def j03_containment_join(spark, d) -> DataFrame:
    pairs = iv.containment_join(view(spark, d, "iv_b"), view(spark, d, "iv_a"))
    return pairs.groupBy("b_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT b.b_id, count(*) AS n, CAST(sum(least(a.e,b.e)-greatest(a.s,b.s)) AS BIGINT) AS covered, max(least(a.e,b.e)-greatest(a.s,b.s)) AS most FROM {_PAIRS} GROUP BY 1", "iv_a", "iv_b")
def j04_overlap_length(spark, d) -> DataFrame:
    size = iv.overlap_size(F.col("s"), F.col("e"), F.col("b_s"), F.col("b_e"))
    return iv.overlap_join(view(spark, d, "iv_b"), view(spark, d, "iv_a")).groupBy("b_id").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("covered"), F.max(size).alias("most"))


@query("SELECT x.b_id AS id1, y.b_id AS id2 FROM iv_b x JOIN iv_b y ON x.chrom_id = y.chrom_id AND x.s < y.e AND y.s < x.e AND x.b_id < y.b_id", "iv_b")
def j05_self_overlap_join(spark, d) -> DataFrame:
    b = view(spark, d, "iv_b")
    return iv.overlap_join(b, b, residual=F.col("b_id") < F.col("b_b_id"), longest=100).select(F.col("b_id").alias("id1"), F.col("b_b_id").alias("id2"))


@query("SELECT b_id, s, e FROM iv_b b WHERE EXISTS (SELECT 1 FROM iv_a a WHERE a.chrom_id = b.chrom_id AND a.s < b.e AND b.s < a.e)", "iv_a", "iv_b")
def j06_overlap_semi(spark, d) -> DataFrame:
    return iv.overlap_semi(view(spark, d, "iv_b"), iv.merge_overlapping(view(spark, d, "iv_a")), ["b_id"]).select("b_id", "s", "e")


@query("SELECT b_id, s, e FROM iv_b b WHERE NOT EXISTS (SELECT 1 FROM iv_a a WHERE a.chrom_id = b.chrom_id AND a.s < b.e AND b.s < a.e)", "iv_a", "iv_b")
def j07_overlap_anti(spark, d) -> DataFrame:
    return iv.overlap_semi(view(spark, d, "iv_b"), iv.merge_overlapping(view(spark, d, "iv_a")), ["b_id"], anti=True).select("b_id", "s", "e")


_TWO = "x AS (SELECT user_id, read_id AS a_id, pos AS a_pos FROM reads WHERE is_read2 = 0), y AS (SELECT user_id, read_id AS b_id, pos AS b_pos FROM reads WHERE is_read2 = 1)"


@query(f"""WITH {_TWO}, p AS (SELECT user_id, a_id, b_id, abs(a_pos - b_pos) AS dist FROM x JOIN y USING (user_id) WHERE abs(a_pos - b_pos) <= 5000),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, a_id ORDER BY dist, b_id) AS ra, row_number() OVER (PARTITION BY user_id, b_id ORDER BY dist, a_id) AS rb FROM p)
    SELECT user_id, a_id, b_id, dist FROM r WHERE ra = 1 AND rb = 1""", "reads")
def j09_mutual_nearest(spark, d) -> DataFrame:
    """Mates within 5000 of each other, by bins of that width so that a user's reads never all meet."""
    return rel.mates(view(spark, d, "reads"), 5000).select("user_id", "a_id", "b_id", "dist")


@query("SELECT n.n_name AS sample, r.r_name AS batch, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2")
def j11_group_lookup(spark, d) -> DataFrame:
    """Read-group to sample and batch; the lookups are dimension tables whose size Spark knows."""
    names = view(spark, d, "nation").join(view(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("sample"), F.col("r_name").alias("batch"))
    return view(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).join(names, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("sample", "batch").agg(F.sum("n").alias("n"))


@query("SELECT l_orderkey, l_linenumber, o_custkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 45")
def j12_read_key_join(spark, d) -> DataFrame:
    few = view(spark, d, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 45").select("l_orderkey", "l_linenumber", "l_quantity")
    return few.join(view(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


@query("SELECT count(*) AS n, count(o.o_orderkey) AS matched FROM iv_b b LEFT JOIN orders o ON b.b_id = o.o_orderkey AND b.chrom_id = o.o_custkey % 100", "iv_b")
def j13_exact_match(spark, d) -> DataFrame:
    o = view(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100).cast("bigint").alias("c"))
    b = view(spark, d, "iv_b")
    return b.join(o, (b.b_id == o.o_orderkey) & (b.chrom_id == o.c), "left").agg(F.count(F.lit(1)).alias("n"), F.count("o_orderkey").alias("matched"))


@query("SELECT d.doc_id, CAST(coalesce(l.quality, -1) AS BIGINT) AS fval FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id")
def j14_model_values(spark, d) -> DataFrame:
    values = view(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("bigint").alias("fval"))
    return view(spark, d, "documents").select("doc_id").join(values, "doc_id", "left").withColumn("fval", F.coalesce("fval", F.lit(-1)))


@query(f"SELECT b_id, a_id FROM (SELECT b.b_id, a.a_id, count(*) OVER (PARTITION BY b.b_id) AS k FROM {_PAIRS}) WHERE k = 1", "iv_a", "iv_b")
def j16_unique_overlap(spark, d) -> DataFrame:
    pairs = iv.overlap_join(view(spark, d, "iv_b"), view(spark, d, "iv_a"))
    return pairs.groupBy("b_id").agg(F.count(F.lit(1)).alias("k"), F.min("b_a_id").alias("a_id")).filter("k = 1").select("b_id", "a_id")


@query("""SELECT x.b_id AS id1, y.b_id AS id2 FROM iv_b x JOIN iv_b y ON x.chrom_id = y.chrom_id AND (x.s < y.s OR (x.s = y.s AND x.b_id < y.b_id)) AND x.b_id % 2 = y.b_id % 2 AND x.s < y.e AND y.s < x.e AND y.e > x.e""", "iv_b")
def j21_graph_edges(spark, d) -> DataFrame:
    """Edges of the homology graph: same strand, overlapping, the second one reaching further."""
    return rel.extension_edges(view(spark, d, "iv_b").withColumn("strand", F.col("b_id") % 2), "b_id").select("id1", "id2")


@query("""SELECT b_id FROM iv_b x WHERE NOT EXISTS (SELECT 1 FROM iv_b y WHERE y.chrom_id = x.chrom_id AND y.b_id % 2 = x.b_id % 2 AND y.s <= x.s AND y.e >= x.e AND (y.e - y.s > x.e - x.s OR y.b_id < x.b_id))""", "iv_b")
def j22_contained_removal(spark, d) -> DataFrame:
    return rel.drop_contained(view(spark, d, "iv_b").withColumn("strand", F.col("b_id") % 2), "b_id").select("b_id")


@query("""WITH r AS (SELECT sample_id, psv_ix, n0, n1, row_number() OVER (PARTITION BY sample_id ORDER BY psv_ix) AS k FROM allele_counts)
    SELECT x.sample_id, x.psv_ix AS psv1, y.psv_ix AS psv2, CAST(least(x.n0, y.n1) AS BIGINT) AS shared FROM r x JOIN r y ON x.sample_id = y.sample_id AND y.k - x.k BETWEEN 1 AND 10 AND y.psv_ix - x.psv_ix <= 12""", "allele_counts")
def j23_neighbour_pairs(spark, d) -> DataFrame:
    pairs = rel.neighbour_pairs(view(spark, d, "allele_counts"), "sample_id", "psv_ix", ahead=10, max_distance=12)
    return pairs.select("sample_id", F.col("psv_ix").alias("psv1"), F.col("y_psv_ix").alias("psv2"), F.least("n0", "y_n1").alias("shared"))


@query("""SELECT x.psv_ix AS psv1, y.psv_ix AS psv2, round(corr(CAST(x.n0 AS DOUBLE)/(x.n0+x.n1+x.n2), CAST(y.n0 AS DOUBLE)/(y.n0+y.n1+y.n2)), 6) AS r, count(*) AS n
    FROM allele_counts x JOIN allele_counts y ON x.sample_id = y.sample_id AND x.psv_ix < y.psv_ix GROUP BY 1, 2 HAVING count(*) >= 5""", "allele_counts")
def j24_allele_correlation(spark, d) -> DataFrame:
    f = view(spark, d, "allele_counts").withColumn("f", F.col("n0") / (F.col("n0") + F.col("n1") + F.col("n2"))).select("sample_id", "psv_ix", "f")
    return rel.pair_correlation(f, "sample_id", "psv_ix", "f", 5).select(F.col("item1").alias("psv1"), F.col("item2").alias("psv2"), F.round("r", 6).alias("r"), "n")


@query("SELECT coalesce(x.c, y.c) AS chrom_id, CASE WHEN x.c IS NULL THEN 'extra' WHEN y.c IS NULL THEN 'missing' ELSE 'length' END AS problem FROM (SELECT DISTINCT l_suppkey % 40 AS c FROM lineitem WHERE l_suppkey % 40 < 30) x FULL JOIN (SELECT DISTINCT o_custkey % 40 AS c FROM orders WHERE o_custkey % 40 >= 10) y ON x.c = y.c WHERE x.c IS NULL OR y.c IS NULL OR x.c % 7 = 0")
def j29_contig_consistency(spark, d) -> DataFrame:
    x = view(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("chrom_id")).filter("chrom_id < 30").distinct().withColumn("length", F.when(F.col("chrom_id") % 7 == 0, 1).otherwise(2))
    y = view(spark, d, "orders").select((F.col("o_custkey") % 40).alias("chrom_id")).filter("chrom_id >= 10").distinct().withColumn("length", F.lit(2))
    return rel.contig_problems(x, y)


# ------------------------------------------------------------------ sweeps
@query("""WITH f AS (SELECT *, (depth1 + depth2) % 5 = 0 AS bad FROM win_depth) SELECT sample_id, window_ix, bad OR coalesce(lag(bad) OVER w, FALSE) AND window_ix - lag(window_ix) OVER w <= 1
    OR coalesce(lead(bad) OVER w, FALSE) AND lead(window_ix) OVER w - window_ix <= 1 AS dropped FROM f WINDOW w AS (PARTITION BY sample_id ORDER BY window_ix)""", "win_depth")
def w01_neighbour_suppression(spark, d) -> DataFrame:
    w = view(spark, d, "win_depth").withColumn("bad", (F.col("depth1") + F.col("depth2")) % 5 == 0)
    return w.select("sample_id", "window_ix", iv.elementwise_neighbours(w, ["sample_id"], "window_ix", "bad", 1, 43200).alias("dropped"))


_ISLANDS = """WITH o AS (SELECT chrom_id, s, e, max(e) OVER (PARTITION BY chrom_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {t}),
    g AS (SELECT *, sum(CASE WHEN pe IS NOT NULL AND s - pe + 1 <= {d} THEN 0 ELSE 1 END) OVER (PARTITION BY chrom_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT chrom_id, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY chrom_id, k"""


@query(_ISLANDS.format(t="iv_a", d=1), "iv_a")
def w02_merge_overlapping(spark, d) -> DataFrame:
    return iv.merge_overlapping(view(spark, d, "iv_a"))


_SEG = """p AS (SELECT chrom_id, s AS x, 1 AS d FROM {t} UNION ALL SELECT chrom_id, e, -1 FROM {t}), q AS (SELECT chrom_id, x, sum(d) AS d FROM p GROUP BY 1, 2),
    seg AS (SELECT chrom_id, x AS s, lead(x) OVER (PARTITION BY chrom_id ORDER BY x) AS e, CAST(sum(d) OVER (PARTITION BY chrom_id ORDER BY x) AS BIGINT) AS depth FROM q)"""


@query(f"WITH {_SEG.format(t='iv_b')} SELECT g.chrom_id, g.s, g.e, array_to_string(list_sort(list(b.b_id)), ',') AS covering FROM seg g JOIN iv_b b ON b.chrom_id = g.chrom_id AND b.s < g.e AND g.s < b.e WHERE g.depth > 0 GROUP BY 1, 2, 3", "iv_b")
def w03_disjoint_subregions(spark, d) -> DataFrame:
    return iv.disjoint_regions(view(spark, d, "iv_b"), "b_id").withColumn("covering", F.array_join("covering", ","))


@query(f"WITH {_SEG.format(t='iv_a')} SELECT chrom_id, s, e, depth FROM seg WHERE depth > 0 AND e IS NOT NULL", "iv_a")
def w04_coverage_depth(spark, d) -> DataFrame:
    return iv.coverage(view(spark, d, "iv_a"))


@query(f"""WITH m AS ({_ISLANDS.format(t='iv_b', d=1)}), g AS (SELECT chrom_id, coalesce(lag(e) OVER (PARTITION BY chrom_id ORDER BY s), 0) AS s, s AS e FROM m
    UNION ALL SELECT c.chrom_id, coalesce(max(m.e), 0), c.length FROM contigs c LEFT JOIN m ON c.chrom_id = m.chrom_id GROUP BY c.chrom_id, c.length) SELECT chrom_id, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM g WHERE s < e AND chrom_id IN (SELECT chrom_id FROM contigs)""", "iv_b", "contigs")
def w05_complement(spark, d) -> DataFrame:
    contigs = view(spark, d, "contigs")
    return iv.complement(view(spark, d, "iv_b").join(contigs, "chrom_id", "left_semi"), contigs)


_RUNS = """WITH c AS (SELECT *, CASE WHEN lag(state) OVER w = state THEN 0 ELSE 1 END AS ch FROM cn_runs WINDOW w AS (PARTITION BY sample_id ORDER BY ix)),
    r AS (SELECT *, sum(ch) OVER (PARTITION BY sample_id ORDER BY ix ROWS UNBOUNDED PRECEDING) AS k FROM c)"""


@query(f"{_RUNS} SELECT sample_id, min(ix) AS start_ix, max(ix) + 1 AS end_ix, min(state) AS state FROM r GROUP BY sample_id, k", "cn_runs")
def w06_run_length(spark, d) -> DataFrame:
    return iv.run_lengths(view(spark, d, "cn_runs"), "sample_id", "ix", "state")


@query("SELECT b_id, CAST(s + (e - s - (e - s) // 10 * 10) // 2 + k * 10 AS BIGINT) AS ws, CAST(s + (e - s - (e - s) // 10 * 10) // 2 + k * 10 + 10 AS BIGINT) AS we FROM iv_b, range(0, 10) t(k) WHERE k < (e - s) // 10", "iv_b")
def w10_window_tiling(spark, d) -> DataFrame:
    return iv.tile(view(spark, d, "iv_b"), 10).select("b_id", "ws", "we")


@query("SELECT sample_id, psv_ix, round(1.0 / count(*) OVER (PARTITION BY sample_id ORDER BY psv_ix RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING), 9) AS weight FROM allele_counts", "allele_counts")
def w12_neighbourhood_weight(spark, d) -> DataFrame:
    near = Window.partitionBy("sample_id").orderBy("psv_ix").rangeBetween(-5, 5)
    return view(spark, d, "allele_counts").select("sample_id", "psv_ix", F.round(1 / F.count(F.lit(1)).over(near), 9).alias("weight"))


@query(f"{_RUNS} , z AS (SELECT *, count(*) OVER (PARTITION BY sample_id, k) AS len FROM r) SELECT sample_id, ix, CASE WHEN len >= 3 THEN 'reset' ELSE state END AS state FROM z", "cn_runs")
def w13_extreme_runs(spark, d) -> DataFrame:
    return rel.reset_long_runs(view(spark, d, "cn_runs"), "sample_id", "ix", "state", 3, "reset")


@query("""WITH g AS (SELECT sample_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY sample_id ORDER BY pos) <= 600 THEN 0 ELSE 1 END AS nw FROM reads),
    r AS (SELECT *, sum(nw) OVER (PARTITION BY sample_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT sample_id, min(pos) AS s, max(pos) + 1 AS e, count(*) AS n FROM r GROUP BY sample_id, k""", "reads")
def w17_gap_sessions(spark, d) -> DataFrame:
    return iv.gap_sessions(view(spark, d, "reads"), 600, ["sample_id"])


@query(f"{_RUNS}, m AS (SELECT sample_id, k, min(state) AS state, count(*) AS len FROM r GROUP BY 1, 2), t AS (SELECT sample_id, state, max(len) AS best, CAST(sum(len) AS BIGINT) AS total FROM m GROUP BY 1, 2) SELECT sample_id, state, best, total FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY total DESC, state) AS rn FROM t) WHERE rn = 1", "cn_runs")
def w22_longest_state(spark, d) -> DataFrame:
    runs = iv.run_lengths(view(spark, d, "cn_runs"), "sample_id", "ix", "state").withColumn("len", F.col("end_ix") - F.col("start_ix"))
    totals = runs.groupBy("sample_id", "state").agg(F.max("len").alias("best"), F.sum("len").alias("total"))
    return rel.best_row(totals, ["sample_id"], [F.desc("total"), F.asc("state")])


@query("SELECT sample_id, first_state, last_state FROM (SELECT sample_id, first_value(state) OVER w AS first_state, last_value(state) OVER w AS last_state, row_number() OVER (PARTITION BY sample_id ORDER BY ix) AS rn FROM cn_runs WINDOW w AS (PARTITION BY sample_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE rn = 1", "cn_runs")
def w23_first_last(spark, d) -> DataFrame:
    return view(spark, d, "cn_runs").groupBy("sample_id").agg(F.min_by("state", "ix").alias("first_state"), F.max_by("state", "ix").alias("last_state"))


@query("SELECT x.sample_id, x.psv_ix AS psv1, y.psv_ix AS psv2 FROM allele_counts x JOIN allele_counts y ON x.sample_id = y.sample_id AND y.psv_ix > x.psv_ix AND y.psv_ix - x.psv_ix <= 2 WHERE x.n0 > 0 AND x.n1 > 0 AND y.n0 > 0 AND y.n1 > 0", "allele_counts")
def w24_unphased_neighbours(spark, d) -> DataFrame:
    het = view(spark, d, "allele_counts").filter("n0 > 0 and n1 > 0")
    return rel.neighbour_pairs(het, "sample_id", "psv_ix", ahead=2, max_distance=2).select("sample_id", F.col("psv_ix").alias("psv1"), F.col("y_psv_ix").alias("psv2"))


@query("SELECT sample_id, window_ix, round(avg(depth1) OVER (PARTITION BY sample_id ORDER BY window_ix ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling FROM win_depth", "win_depth")
def w26_rolling_average(spark, d) -> DataFrame:
    w = Window.partitionBy("sample_id").orderBy("window_ix").rowsBetween(-4, 0)
    return view(spark, d, "win_depth").select("sample_id", "window_ix", F.round(F.avg("depth1").over(w), 6).alias("rolling"))


# ------------------------------------------------------------------ sorts, ranks, sets
@query("SELECT chrom_id, s, e, b_id FROM iv_b", "iv_b")
def t01_coordinate_sort(spark, d) -> DataFrame:
    return view(spark, d, "iv_b").orderBy("chrom_id", "s", "e", "b_id").select("chrom_id", "s", "e", "b_id")


@query("SELECT psv_ix, sample_id, n0 FROM (SELECT *, row_number() OVER (PARTITION BY psv_ix ORDER BY n0 DESC, sample_id) AS rn FROM allele_counts) WHERE rn = 1", "allele_counts")
def t02_argmax(spark, d) -> DataFrame:
    best = view(spark, d, "allele_counts").groupBy("psv_ix").agg(F.max_by("sample_id", F.struct(F.col("n0"), -F.col("sample_id"))).alias("sample_id"), F.max("n0").alias("n0"))
    return best.select("psv_ix", "sample_id", "n0")


@query("SELECT psv_ix, rn, sample_id, n0 FROM (SELECT *, row_number() OVER (PARTITION BY psv_ix ORDER BY n0 DESC, sample_id) AS rn FROM allele_counts) WHERE rn <= 2", "allele_counts")
def t04_best_two(spark, d) -> DataFrame:
    return rel.top_rows(view(spark, d, "allele_counts"), ["psv_ix"], [F.desc("n0"), F.asc("sample_id")], 2, "rn").select("psv_ix", F.col("rn").cast("bigint").alias("rn"), "sample_id", "n0")


@query("SELECT c_nationkey, CASE WHEN count(*) > 10 THEN array_to_string(list_slice(list(c_custkey ORDER BY c_custkey), 1, 10), ',') || ',...' ELSE array_to_string(list(c_custkey ORDER BY c_custkey), ',') END AS samples FROM customer GROUP BY 1")
def t05_first_ten(spark, d) -> DataFrame:
    return rel.first_names(view(spark, d, "customer"), "c_nationkey", "c_custkey", 10, "samples")


@query("SELECT c_custkey, concat('n', CAST(c_nationkey AS STRING), CASE WHEN k > 1 THEN concat('_', CAST(rn AS STRING)) ELSE '' END) AS name FROM (SELECT c_custkey, c_nationkey, count(*) OVER (PARTITION BY c_nationkey) AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer)")
def t07_unique_names(spark, d) -> DataFrame:
    c = view(spark, d, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("name"))
    return rel.unique_names(c, "name", "c_custkey")


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS alleles, count(*) AS n FROM orders GROUP BY 1")
def t08_distinct_alleles(spark, d) -> DataFrame:
    return view(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("alleles"), F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(chrom_id AS BIGINT) AS chrom_id, count(*) AS n FROM (SELECT chrom_id, s, e FROM iv_a UNION ALL SELECT chrom_id, s, e FROM iv_b) GROUP BY 1", "iv_a", "iv_b")
def u01_union_all(spark, d) -> DataFrame:
    both = view(spark, d, "iv_a").select("chrom_id", "s", "e").unionByName(view(spark, d, "iv_b").select("chrom_id", "s", "e"))
    return both.groupBy("chrom_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_partkey % 1000 AS k FROM lineitem EXCEPT SELECT o_custkey % 900 FROM orders")
def u02_set_difference(spark, d) -> DataFrame:
    return view(spark, d, "lineitem").select((F.col("l_partkey") % 1000).alias("k")).distinct().join(view(spark, d, "orders").select((F.col("o_custkey") % 900).alias("k")), "k", "left_anti")


@query("SELECT l_partkey % 1000 AS k FROM lineitem INTERSECT SELECT o_custkey % 900 FROM orders")
def u03_set_intersection(spark, d) -> DataFrame:
    return view(spark, d, "lineitem").select((F.col("l_partkey") % 1000).alias("k")).intersect(view(spark, d, "orders").select((F.col("o_custkey") % 900).alias("k")))


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(list(o_orderpriority), list(o_orderstatus)))), ',') AS tags FROM orders GROUP BY 1")
def u04_set_union(spark, d) -> DataFrame:
    g = view(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("x"), F.collect_set("o_orderstatus").alias("y"))
    return g.select("o_custkey", F.array_join(F.array_sort(F.array_union("x", "y")), ",").alias("tags"))


_EDGES = "e AS (SELECT DISTINCT l_suppkey % 60 AS a, l_partkey % 60 AS b FROM lineitem WHERE l_suppkey % 60 < l_partkey % 60 AND l_orderkey % 40 = 0)"

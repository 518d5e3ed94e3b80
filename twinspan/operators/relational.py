"""Filters, keyed joins, ranks and naming: compositions of DataFrame operations, none of them with a loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import compile_expression
from .intervals import overlap_join, with_reach

NOT_PRIMARY = 3844  # unmapped, secondary, failed, duplicate, supplementary
MAX_DEPTH = 65_535


# ------------------------------------------------------------------ filters
def filter_homology(table: DataFrame, include: str | None = None, exclude: str | None = None, skip_tangled: bool = False, info: str = "info") -> DataFrame:
    """Rows that the include expression takes and the exclude expression doesn't; tangled rows pass both, or go
    with skip_tangled. One filter over the scan."""
    taken = F.coalesce(compile_expression(include, info, True), F.lit(False)) if include else F.lit(True)
    out = F.coalesce(compile_expression(exclude, info, True), F.lit(False)) if exclude else F.lit(False)
    return table.filter((taken & ~out) & ~F.col("is_tangled") if skip_tangled else F.col("is_tangled") | (taken & ~out))


def admission_route(exclude: str, short: int, contig_length: int, info: str = "info") -> Column:
    """What becomes of a homology row at a locus: skip, exclude, short, out_of_contig or use. info: a text column."""
    return (
        F.when(F.col("is_tangled"), "skip")
        .when(F.coalesce(compile_expression(exclude, info, True), F.lit(False)), "exclude")
        .when(compile_expression(f"length < {short}", info, True), "short")
        .when(F.col("end1") > contig_length, "out_of_contig")
        .otherwise("use")
    )


def primary_reads(reads: DataFrame, flag: str = "flag") -> DataFrame:
    return reads.filter(F.col(flag).bitwiseAND(F.lit(NOT_PRIMARY)) == 0)


def window_passes(low_mapq: float = 0.1, clipped: float = 0.1, unpaired: float = 0.1) -> Column:
    """Depth limit and ratio limits of a window's counts; an empty window passes."""
    depth = F.col("depth1") + F.col("depth2")
    ratios = [F.coalesce(F.try_divide(F.col(c), depth), F.lit(0.0)) <= most for c, most in (("low_mapq", low_mapq), ("clipped", clipped), ("unpaired", unpaired))]
    return (depth == 0) | ((F.col("depth1") <= MAX_DEPTH) & (F.col("depth2") <= MAX_DEPTH) & ratios[0] & ratios[1] & ratios[2])


def depth_cap(windows: DataFrame, times: float = 10.0) -> DataFrame:
    """Windows whose depth is at most `times` the sample's median, for both read ends."""
    medians = windows.groupBy("sample_id").agg(F.median("depth1").alias("_m1"), F.median("depth2").alias("_m2"))
    return windows.join(medians, "sample_id").filter((F.col("depth1") <= times * F.col("_m1")) & (F.col("depth2") <= times * F.col("_m2"))).drop("_m1", "_m2")


def filter_tags(**conditions: Column) -> Column:
    """`PASS`, or the sorted names of the conditions that hold, joined by `;`."""
    tags = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in conditions.items())))
    return F.when(F.size(tags) == 0, F.lit("PASS")).otherwise(F.array_join(F.array_sort(F.array_distinct(tags)), ";"))


# ------------------------------------------------------------------ joins
def mates(reads: DataFrame, max_distance: int, key: str = "user_id") -> DataFrame:
    """First and second reads of one name that are each other's nearest within max_distance. Reads meet by
    bins as wide as that distance, and only with the bin beside, so a name with very many reads stays cheap."""
    first = reads.filter("is_read2 = 0").select(key, F.col("read_id").alias("a_id"), F.col("pos").alias("a_pos"))
    second = reads.filter("is_read2 = 1").select(key, F.col("read_id").alias("b_id"), F.col("pos").alias("b_pos"))
    first = first.withColumn("_bin", F.floor(F.col("a_pos") / max_distance))
    second = second.withColumn("_bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("b_pos") / max_distance) + k)))
    pairs = first.join(second, [key, "_bin"]).withColumn("dist", F.abs(F.col("a_pos") - F.col("b_pos"))).filter(F.col("dist") <= max_distance)
    by_a, by_b = Window.partitionBy(key, "a_id").orderBy("dist", "b_id"), Window.partitionBy(key, "b_id").orderBy("dist", "a_id")
    return pairs.withColumn("_ra", F.row_number().over(by_a)).withColumn("_rb", F.row_number().over(by_b)).filter("_ra = 1 and _rb = 1").drop("_ra", "_rb", "_bin")


def extension_edges(df: DataFrame, id_col: str) -> DataFrame:
    """(id1, id2) of intervals of one strand that overlap where the later one reaches further: edges of the
    homology graph. Contained intervals give none."""
    after = (F.col("s") < F.col("b_s")) | ((F.col("s") == F.col("b_s")) & (F.col(id_col) < F.col(f"b_{id_col}")))
    pairs = overlap_join(df, df, residual=after & (F.col("strand") == F.col("b_strand")) & (F.col("b_e") > F.col("e")))
    return pairs.select(F.col(id_col).alias("id1"), F.col(f"b_{id_col}").alias("id2"))


def drop_contained(df: DataFrame, id_col: str) -> DataFrame:
    """Rows that lie inside no other row of their strand; of equal intervals the smallest id stays. In order of the
    start, the longer first, a row lies inside one before it if any of those reaches its end, so no pairs are made."""
    whole = F.col("chrom_id").isNotNull() & F.col("strand").isNotNull() & F.col("s").isNotNull() & F.col("e").isNotNull()
    rows = with_reach(df.filter(whole), ["chrom_id", "strand"], [F.desc("e"), F.col(id_col)], "_reach")
    outer = rows.filter("_reach is null or _reach < e").select(df.columns)
    return outer.union(df.filter(~whole))


def neighbour_pairs(df: DataFrame, group: str, pos: str, ahead: int, max_distance: int) -> DataFrame:
    """Pairs of rows of one group, the second at most `ahead` ranks and max_distance further; its columns get a
    `y_`. Rows look ahead by lead() over one sort, so no group is joined with itself."""
    w = Window.partitionBy(group).orderBy(pos)
    row = F.struct(*[F.col(c) for c in df.columns])
    following = F.filter(F.array(*(F.lead(row, k).over(w) for k in range(1, ahead + 1))), lambda y: y.isNotNull() & (y[pos] - F.col(pos) <= max_distance))
    pairs = df.withColumn("_y", following).withColumn("_y", F.explode("_y"))
    return pairs.select(*df.columns, *(F.col(f"_y.{c}").alias(f"y_{c}") for c in df.columns))


def pair_correlation(df: DataFrame, by: str, item: str, value: str, least: int) -> DataFrame:
    """Pearson correlation of each pair of items over the keys that both have, for pairs with `least` or more. The
    pairs are those of the items, which are few by nature (variants of one locus)."""
    x = df.select(by, F.col(item).alias("item1"), F.col(value).alias("v1"))
    y = df.select(by, F.col(item).alias("item2"), F.col(value).alias("v2"))
    return x.join(y, by).filter("item1 < item2").groupBy("item1", "item2").agg(F.corr("v1", "v2").alias("r"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def contig_problems(x: DataFrame, y: DataFrame) -> DataFrame:
    """Contigs (chrom_id, length) that only one side has, or whose lengths differ."""
    both = x.join(y.withColumnsRenamed({"length": "_l"}).withColumn("_y", F.lit(1)), "chrom_id", "full")
    problem = F.when(F.col("length").isNull(), "extra").when(F.col("_y").isNull(), "missing").when(F.col("length") != F.col("_l"), "length")
    return both.select("chrom_id", problem.alias("problem")).filter("problem is not null")


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """One step: drops a -> c where a -> b -> c."""
    x, y = edges.withColumnRenamed("b", "m"), edges.withColumnRenamed("a", "m")
    return edges.join(x.join(y, "m").select("a", "b").distinct(), ["a", "b"], "left_anti")


# ------------------------------------------------------------------ ranks, runs, names
def top_rows(df: DataFrame, part: Sequence[str], order: Sequence[Column], n: int, rank: str) -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col(rank) <= n)


def one_of_each(df: DataFrame, id_col: str) -> DataFrame:
    """One row of each id, the least: the same one wherever the plan is run again, unlike dropDuplicates()'s."""
    others = [c for c in df.columns if c != id_col]
    return df.groupBy(id_col).agg(F.min(F.struct(*others)).alias("_r")).select(*(id_col if c == id_col else F.col(f"_r.{c}") for c in df.columns))


def best_row(df: DataFrame, part: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_rows(df, part, order, 1, "_rank").drop("_rank")


def reset_long_runs(df: DataFrame, key: str, order: str, state: str, least: int, value) -> DataFrame:
    """Rows whose run of equal states has `least` rows or more get `value` for a state."""
    w = Window.partitionBy(key).orderBy(order)
    marked = df.withColumn("_c", F.when(F.lag(state).over(w) == F.col(state), 0).otherwise(1))
    marked = marked.withColumn("_r", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count(F.lit(1)).over(Window.partitionBy(key, "_r"))
    return marked.withColumn("_n", size).select(key, order, F.when(F.col("_n") >= least, F.lit(value)).otherwise(F.col(state)).alias(state))


def first_names(df: DataFrame, group: str, name: str, n: int, out: str) -> DataFrame:
    """The first n names of each group joined by commas, and `...` where there are more. Names are ranked, so a
    group's list never holds more than n."""
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(name))).filter(F.col("_k") <= n + 1)
    lists = ranked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_k", F.col(name).cast("string").alias("v")))).alias("l"))
    shown = F.array_join(F.transform(F.slice("l", 1, n), lambda x: x["v"]), ",")
    return lists.select(group, F.concat(shown, F.when(F.size("l") > n, ",...").otherwise("")).alias(out))


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """A suffix `_k` for the k-th row of a name that several rows have."""
    w = Window.partitionBy(name)
    k, total = F.row_number().over(w.orderBy(order)), F.count(F.lit(1)).over(w)
    ranked = df.withColumn("_k", k).withColumn("_n", total)
    return ranked.withColumn(name, F.when(F.col("_n") > 1, F.concat_ws("_", F.col(name), F.col("_k").cast("string"))).otherwise(F.col(name))).drop("_k", "_n")

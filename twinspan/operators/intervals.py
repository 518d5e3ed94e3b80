"""Interval algebra on columns (chrom_id, s, e), half-open: scalar functions, binned joins, sweeps.

Two intervals overlap where each starts before the other ends. Touching intervals have distance 1, overlapping
ones 0. Joins put intervals into bins about as wide as they are long, and keep a pair in the first bin that both touch, so a
pair is found once, no contig becomes one task, and an interval is in a few bins whatever its length. Sweeps over a contig work inside (contig, bin), with what the bins
before leave behind, so that only a row a bin meets in one window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .covers import covering

BIN = 128  # width of the finest bins
FAN, LEVELS = 4, 16  # each level's bins are so many times as wide as those of the one below
FAR = 2**62  # distance across contigs


# ------------------------------------------------------------------ scalar
def overlap_size(s1, e1, s2, e2) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def intersects(c1, s1, e1, c2, s2, e2) -> Column:
    return (c1 == c2) & (s1 < e2) & (s2 < e1)


def distance(c1, s1, e1, c2, s2, e2) -> Column:
    return F.when(c1 == c2, F.greatest(F.lit(0), s1 - e2 + 1, s2 - e1 + 1)).otherwise(F.lit(FAR))


def start_distance(c1, s1, c2, s2) -> Column:
    return F.when(c1 == c2, F.abs(s1 - s2)).otherwise(F.lit(-1))


def subtract_first(s1, e1, s2, e2) -> tuple[Column, Column]:
    """The left remainder of [s1,e1) without [s2,e2) if there is one, else the right one, else null."""
    left, right = s1 < s2, e1 > e2
    apart = (s1 >= e2) | (s2 >= e1)
    return F.when(apart | left, s1).when(right, e2), F.when(apart, e1).when(left, s2).when(right, e1)


def contains(s1, e1, s2, e2) -> Column:
    return (s1 <= s2) & (e2 <= e1)


def padded(s, e, pad: int, length) -> tuple[Column, Column]:
    return F.greatest(F.lit(0), s - pad), F.least(length, e + pad)


def parse_region(text: Column) -> Column:
    """`chrom:start-end` (1-based, closed, commas allowed), `chrom`, each with an optional `:+`/`:-` strand;
    struct(chrom, start, end, strand), 0-based and half-open, nulls for what isn't given."""
    pattern = r"^([^:\s]+)(?::([\d,]+)-([\d,]+))?(?::([+-]))?$"
    number = lambda i: F.nullif(F.regexp_replace(F.regexp_extract(text, pattern, i), ",", ""), F.lit("")).cast("bigint")
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return F.struct(part(1).alias("chrom"), (number(2) - 1).alias("start"), number(3).alias("end"), part(4).alias("strand"))


def format_region(chrom, start, end) -> Column:
    return F.concat(chrom, F.lit(":"), (start + 1).cast("string"), F.lit("-"), end.cast("string"))


# ------------------------------------------------------------------ joins
def with_level(df: DataFrame, width: int = BIN, length: Column | None = None) -> DataFrame:
    """Adds _level, the finest one whose bins are as wide as the interval is long: it touches at most two of them."""
    length = F.col("e") - F.col("s") if length is None else length
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(length <= width * FAN**k, k).otherwise(level)
    return df.withColumn("_level", level)


def _levels(a: DataFrame, b: DataFrame, width: int) -> tuple[list[int], list[int]]:
    """The levels that two tables' intervals have: one pass over their ends, a few numbers to the driver."""
    sides = [with_level(df.select("s", "e"), width).agg(F.array_sort(F.collect_set("_level")).alias("k")).select("k", F.lit(i).alias("i")) for i, df in enumerate((a, b))]
    found = {r["i"]: r["k"] for r in sides[0].union(sides[1]).collect()}
    return found[0], found[1]


def _in_bins(df: DataFrame, width: int, places: Column) -> DataFrame:
    """A row for each bin that the interval touches at each of its places, an array<struct<k level, r role>>; _key is one number
    of level, bin and role."""
    rows = df.withColumn("_p", F.explode(places)).withColumn("_w", F.lit(width) * F.pow(F.lit(FAN), F.col("_p.k")).cast("bigint"))
    rows = rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("s") / F.col("_w")), F.floor((F.col("e") - 1) / F.col("_w")))))
    return rows.withColumn("_key", (F.col("_bin") * LEVELS + F.col("_p.k")) * 2 + F.col("_p.r")).drop("_p", "_level")


def overlap_join(a: DataFrame, b: DataFrame, width: int = BIN, residual: Column | None = None, longest: int | None = None) -> DataFrame:
    """All pairs that overlap: a's columns as they are, b's with a `b_` in front (contig and ends of both named
    chrom_id, s, e). residual: a further condition over both.

    A pair meets at the coarser of its two levels: there the longer one waits in its own bins, and the shorter one, which
    touches at most two bins of any coarser level, comes by. It visits only levels that the other table has; for that their
    ends are looked through once, unless the caller says how long intervals are at most (longer ones are found, too, in
    more bins). Role 0: a waits, b comes, at equal levels too; role 1: b waits."""
    if longest is None:
        levels_a, levels_b = _levels(a, b, width)
    else:
        levels_a = levels_b = [k for k in range(LEVELS) if not k or width * FAN ** (k - 1) < longest]
    top = levels_a[-1:] + levels_b[-1:]
    level = with_level if longest is None else lambda df, width: with_level(df, width).withColumn("_level", F.least(F.lit(max(top)), "_level"))
    place = lambda k, role: F.struct(k.alias("k"), F.lit(role).alias("r"))

    def at(levels: list[int], role: int, wanted) -> Column:
        return F.transform(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), wanted), lambda k: place(k, role))

    own = F.col("_level")
    to_a = F.array(place(own, 0))
    left = _in_bins(level(a, width), width, F.concat(to_a, at(levels_b, 1, lambda k: k > own)) if levels_a and levels_b and levels_b[-1] > levels_a[0] else to_a)
    to_b = at(levels_a, 0, lambda k: k >= own)
    if levels_a and levels_b and levels_b[-1] > levels_a[0]:
        to_b = F.concat(to_b, F.when(own > levels_a[0], F.array(place(own, 1))).otherwise(F.array().cast("array<struct<k:int,r:int>>")))
    right = _in_bins(level(b, width), width, to_b)
    right = right.select([F.col(c).alias(f"b_{c}") for c in [*b.columns, "_key"]])
    first = F.greatest(F.floor(F.col("s") / F.col("_w")), F.floor(F.col("b_s") / F.col("_w")))
    on = (F.col("chrom_id") == F.col("b_chrom_id")) & (F.col("_key") == F.col("b__key")) & (F.col("s") < F.col("b_e")) & (F.col("b_s") < F.col("e")) & (F.col("_bin") == first)
    return left.join(right, on if residual is None else on & residual).drop("_bin", "_key", "_w", "b__key")


def containment_join(a: DataFrame, b: DataFrame, width: int = BIN, longest: int | None = None) -> DataFrame:
    """Pairs where b lies inside a."""
    return overlap_join(a, b, width, (F.col("b_s") >= F.col("s")) & (F.col("b_e") <= F.col("e")), longest)


def overlap_semi(a: DataFrame, b: DataFrame, ids: Sequence[str], width: int = BIN, anti: bool = False, longest: int | None = None) -> DataFrame:
    """Rows of a (told apart by ids) that overlap any row of b, or none of them."""
    hit = overlap_join(a.select(*ids, "chrom_id", "s", "e"), b.select("chrom_id", "s", "e"), width, longest=longest).select(*ids).distinct()
    return a.join(hit, list(ids), "left_anti" if anti else "left_semi")


def point_in_window(points: DataFrame, width: int, pos: str = "pos") -> DataFrame:
    """window_ix of a uniform grid; an equi key and no range join."""
    return points.withColumn("window_ix", F.floor(F.col(pos) / width))


def as_of_window(points: DataFrame, windows: DataFrame, width: int = BIN, pos: str = "pos") -> DataFrame:
    """Irregular, non-overlapping windows: the one that holds each point, by bins."""
    p = points.withColumn("s", F.col(pos)).withColumn("e", F.col(pos) + 1)
    return overlap_join(p, windows, width).drop("s", "e")


def lookup_with_default(a: DataFrame, entries: DataFrame, value: str, default, ids: Sequence[str], width: int = BIN) -> DataFrame:
    """value of the entry that contains a's interval, default where none does, null where several do."""
    found = overlap_join(a.select(*ids, "chrom_id", "s", "e"), entries, width, (F.col("b_s") <= F.col("s")) & (F.col("b_e") >= F.col("e")))
    one = found.groupBy(*ids).agg(F.count(F.lit(1)).alias("n_entries"), F.min(f"b_{value}").alias("_v"))
    out = a.join(one, list(ids), "left").withColumn("n_entries", F.coalesce("n_entries", F.lit(0)).cast("bigint"))
    return out.withColumn(value, F.when(F.col("n_entries") == 0, F.lit(default)).when(F.col("n_entries") == 1, F.col("_v"))).drop("_v")


# ------------------------------------------------------------------ sweeps
# Rows of a part in order, without the part in one task: windows are over (part, bin), and what a bin needs from those
# before it is summed up in one row a bin first.
STRETCH = 1 << 16


def _across(rows: DataFrame, part: Sequence[str], value: Column, over: Callable[[Column], Column], name: str) -> DataFrame:
    """Adds what `over` makes of the values of all bins before each row's; value is an aggregate of a bin."""
    w = Window.partitionBy(*part).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy(*part, "_bin").agg(value.alias("_v")).select(*part, "_bin", over(F.col("_v")).over(w).alias(name))
    return rows.join(bins, [*part, "_bin"])


def previous_row(df: DataFrame, part: Sequence[str], order: str, columns: Sequence[str], width: int = STRETCH) -> DataFrame:
    """Adds _bin and _previous, a struct of columns of the row before by a numeric order (null for a part's first)."""
    row = F.struct(*columns)
    rows = df.withColumn("_bin", F.floor(F.col(order) / width))
    rows = _across(rows, part, F.max_by(row, order), lambda v: F.last(v, True), "_before")
    here = F.lag(row).over(Window.partitionBy(*part, "_bin").orderBy(order))
    return rows.withColumn("_previous", F.coalesce(here, "_before")).drop("_before")


def numbered_runs(rows: DataFrame, part: Sequence[str], order: Sequence[str], new: str, name: str) -> DataFrame:
    """Numbers the runs that rows with new = 1 begin; rows have _bin. Equal rows get one number, whichever of them comes
    first, as the window's frame ends with the last of them."""
    local = Window.partitionBy(*part, "_bin").orderBy(*order)
    rows = _across(rows, part, F.sum(new), F.sum, "_so_far")
    return rows.withColumn(name, F.coalesce("_so_far", F.lit(0)) + F.sum(new).over(local)).drop("_so_far", "_bin")


def with_reach(df: DataFrame, part: Sequence[str], then: Sequence[str | Column], name: str, width: int = STRETCH) -> DataFrame:
    """Adds the largest e of the rows before, in order of s and `then` (null for a part's first), and _bin."""
    rows = _across(df.withColumn("_bin", F.floor(F.col("s") / width)), part, F.max("e"), F.max, "_before")
    local = F.max("e").over(Window.partitionBy(*part, "_bin").orderBy("s", *then).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, F.greatest(local, "_before")).drop("_before")


def with_islands(df: DataFrame, part: Sequence[str], name: str, max_distance: int = 1, width: int = STRETCH) -> DataFrame:
    """Numbers the islands of intervals (s, e) whose distance is at most max_distance (0: only overlapping ones are one)."""
    rows = with_reach(df, part, ["e"], "_reach", width)
    rows = rows.withColumn("_new", F.when(F.col("s") <= F.col("_reach") + (max_distance - 1), 0).otherwise(1)).drop("_reach")
    return numbered_runs(rows, part, ("s", "e"), "_new", name).drop("_new")


def with_sessions(df: DataFrame, part: Sequence[str], pos: str, max_gap: int, name: str, width: int = STRETCH) -> DataFrame:
    """Numbers the runs of positions without a gap of more than max_gap."""
    rows = previous_row(df, part, pos, [pos], width)
    rows = rows.withColumn("_new", F.when(F.col(pos) - F.col(f"_previous.{pos}") <= max_gap, 0).otherwise(1)).drop("_previous")
    return numbered_runs(rows, part, [pos], "_new", name).drop("_new")


def merge_overlapping(df: DataFrame, max_distance: int = 1, part: Sequence[str] = ("chrom_id",), width: int = STRETCH) -> DataFrame:
    """Islands of intervals whose distance is at most max_distance (1: touching ones merge), with how many
    intervals are in each."""
    runs = with_islands(df.select(*part, "s", "e"), part, "_island", max_distance, width)
    return runs.groupBy(*part, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n")).drop("_island")


def sweep(events: DataFrame, part: Sequence[str], counters: Sequence[str], width: int = STRETCH) -> DataFrame:
    """Elementary segments (s, e) between the positions of events, with what each counter adds up to there. events: part, pos
    and by how much each counter grows. The sums start in each bin with what the bins before it leave."""
    points = events.groupBy(*part, F.col("pos").alias("s")).agg(*(F.sum(c).alias(c) for c in counters)).withColumn("_bin", F.floor(F.col("s") / width))
    bins = points.groupBy(*part, "_bin").agg(*(F.sum(c).alias(f"_d_{c}") for c in counters), F.min("s").alias("_next"))
    by_bin = Window.partitionBy(*part).orderBy("_bin")
    before = by_bin.rowsBetween(Window.unboundedPreceding, -1)
    opened = bins.select(*part, "_bin", *(F.coalesce(F.sum(f"_d_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in counters), F.lead("_next").over(by_bin).alias("_next"))
    local = Window.partitionBy(*part, "_bin").orderBy("s")
    out = points.join(opened, [*part, "_bin"]).withColumn("e", F.coalesce(F.lead("s").over(local), F.col("_next")))
    so_far = local.rowsBetween(Window.unboundedPreceding, 0)
    sums = [(F.col(f"_o_{c}") + F.sum(c).over(so_far)).cast("bigint").alias(c) for c in counters]
    return out.select(*part, "s", "e", *sums).filter("e is not null")


def coverage(df: DataFrame, part: Sequence[str] = ("chrom_id",), width: int = STRETCH) -> DataFrame:
    """Depth of each elementary segment (s, e, depth), gaps left out: +1 and -1 events, summed up in order."""
    events = df.select(*part, F.explode(F.array(F.struct(F.col("s").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("e").alias("pos"), F.lit(-1).alias("d")))).alias("v"))
    segments = sweep(events.select(*part, "v.pos", F.col("v.d").alias("depth")), part, ["depth"], width)
    return segments.filter("depth > 0").select(*part, "s", "e", "depth")


def kept_stretches(marks: DataFrame, part: Sequence[str], by_reference: bool = False, width: int = STRETCH) -> DataFrame:
    """Where nothing is discarded, something is kept and, by_reference, as many marks keep as are expected to (kind ref); without,
    none is expected. marks: part, s, e, kind (keep, discard or ref) and lo, hi, the region that they are cut to. Stretches end
    at the ends of marks; touching ones are left apart."""
    kinds = ("keep", "discard", "ref")
    cut = lambda c: F.least(F.greatest(F.col(c), F.col("lo")), F.col("hi"))
    ends = F.array(F.struct(cut("s").alias("pos"), F.lit(1).alias("d")), F.struct(cut("e").alias("pos"), F.lit(-1).alias("d")))
    events = marks.filter("s <= e").select(*part, "kind", F.explode(ends).alias("v"))
    events = events.select(*part, "v.pos", *(F.when(F.col("kind") == k, F.col("v.d")).otherwise(0).alias(k) for k in kinds))
    expected = F.col("keep") if by_reference else F.lit(0)
    return sweep(events, part, kinds, width).filter((F.col("discard") == 0) & (F.col("keep") > 0) & (F.col("ref") == expected)).select(*part, "s", "e")


def disjoint_regions(df: DataFrame, id_col: str, part: Sequence[str] = ("chrom_id",), width: int | None = None) -> DataFrame:
    """Splits at all ends; each elementary segment with the sorted ids of the intervals that cover it."""
    return covering(df, id_col, part, width)


def complement(df: DataFrame, contigs: DataFrame, part: str = "chrom_id") -> DataFrame:
    """Gaps of each contig (chrom_id, length) outside the intervals; whole contigs where there is none."""
    merged = merge_overlapping(df, 1, (part,))
    gaps = previous_row(merged, [part], "s", ["e"]).select(part, F.coalesce(F.col("_previous.e"), F.lit(0)).alias("gs"), F.col("s").alias("ge"))
    tails = merged.groupBy(part).agg(F.max("e").alias("gs")).join(contigs, part).select(part, "gs", F.col("length").alias("ge"))
    whole = contigs.join(merged, part, "left_anti").select(part, F.lit(0).cast("bigint").alias("gs"), F.col("length").alias("ge"))
    return gaps.unionByName(tails).unionByName(whole).filter("gs < ge").select(part, F.col("gs").alias("s"), F.col("ge").alias("e"))


def run_lengths(df: DataFrame, key: str, order: str, state: str, width: int = STRETCH) -> DataFrame:
    """Runs of equal states: (key, start_ix, end_ix exclusive, state)."""
    rows = previous_row(df.select(key, order, state), [key], order, [state, order], width)
    same = F.col("_previous").isNotNull() & F.col(f"_previous.{state}").eqNullSafe(F.col(state))
    runs = numbered_runs(rows.withColumn("_c", F.when(same, 0).otherwise(1)).drop("_previous"), [key], [order], "_c", "_r")
    return runs.groupBy(key, "_r").agg(F.min(order).alias("start_ix"), (F.max(order) + 1).alias("end_ix"), F.first(state).alias("state")).drop("_r")


def gap_sessions(df: DataFrame, max_gap: int, part: Sequence[str], pos: str = "pos", width: int = STRETCH) -> DataFrame:
    """A new region where the next position is more than max_gap behind the last one."""
    runs = with_sessions(df.select(*part, pos), part, pos, max_gap, "_r", width)
    return runs.groupBy(*part, "_r").agg(F.min(pos).alias("s"), (F.max(pos) + 1).alias("e"), F.count(F.lit(1)).alias("n")).drop("_r")


def tile(df: DataFrame, width: int) -> DataFrame:
    """Windows of one width inside each interval, the remainder split evenly over both ends (left half rounded down)."""
    n = F.floor((F.col("e") - F.col("s")) / width)
    first = F.col("s") + F.floor((F.col("e") - F.col("s") - n * width) / 2)
    tiles = df.filter(F.col("e") - F.col("s") >= width).withColumn("_k", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    return tiles.withColumn("ws", (first + F.col("_k") * width).cast("bigint")).withColumn("we", (F.col("ws") + width).cast("bigint")).drop("_k")


def elementwise_neighbours(df: DataFrame, part: Sequence[str], order: str, bad: str, n: int, width: int) -> Column:
    """True where a row or one of up to n neighbours closer than width * n + width / 2 is bad."""
    w = Window.partitionBy(*part).orderBy(order)
    near = [F.coalesce(f(bad, k).over(w) & (F.abs(f(order, k).over(w) - F.col(order)) * width <= width * n + width / 2), F.lit(False)) for k in range(1, n + 1) for f in (F.lag, F.lead)]
    out = F.coalesce(F.col(bad), F.lit(False))
    for x in near:
        out = out | x
    return out


def unique_regions(duplications: DataFrame, contigs: DataFrame) -> DataFrame:
    """What no duplication covers: (chrom_id, s, e), an index for overlap sizes of reads."""
    return complement(duplications.select("chrom_id", "s", "e"), contigs)

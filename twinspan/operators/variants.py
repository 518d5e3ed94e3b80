"""Variants that tell copies apart (PSVs) and their upkeep: records, observations, filters, merged positions, and the
ordered greedy steps around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lambdas import let
from .grouped import Spaced, map_groups
from .intervals import overlap_join, with_islands, with_sessions

RELIABLE_COMPLETE, LEAST_INFO, FEW = 0.99, 0.9, 3


# ------------------------------------------------------------------ observations
def allele_observations(pairs: DataFrame, psvs: DataFrame) -> DataFrame:
    """pairs: read_id, ref_pos, base (aligned, in order); psvs: psv_id, s, e. The bases that each read has over each
    variant, and whether it covers all of it."""
    keyed = psvs.withColumn("ref_pos", F.explode(F.sequence(F.col("s"), F.col("e") - 1)))
    seen = pairs.join(keyed, "ref_pos").groupBy("read_id", "psv_id", "s", "e").agg(F.array_sort(F.collect_list(F.struct("ref_pos", "base"))).alias("_b"))
    return seen.select("read_id", "psv_id", F.array_join(F.transform("_b", lambda x: x["base"]), "").alias("allele"), (F.size("_b") < F.col("e") - F.col("s")).alias("partial"))


def observed_counts(observations: DataFrame, alleles: DataFrame) -> DataFrame:
    """Counts of each variant's alleles (psv_id, alleles array) with partial and other observations."""
    ix = F.array_position("alleles", F.col("allele")) - 1
    named = observations.join(alleles, "psv_id").withColumn("_k", F.when(F.col("partial"), "partial").when(ix < 0, "other").otherwise(ix.cast("string")))
    return named.groupBy("psv_id", "_k").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("_k", "allele_ix")


def remap_alleles(observations: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Allele numbers of one record -> those of another by their strings; -1 where the other record lacks one.
    old, new: variant_id, alleles."""
    x = old.select("variant_id", F.posexplode("alleles").alias("allele_ix", "allele"))
    y = new.select("variant_id", F.posexplode("alleles").alias("new_ix", "allele"))
    table = x.join(y, ["variant_id", "allele"], "left").select("variant_id", "allele_ix", F.coalesce("new_ix", F.lit(-1)).alias("new_ix"))
    return observations.join(table, ["variant_id", "allele_ix"]).drop("allele_ix").withColumnRenamed("new_ix", "allele_ix")


def missing_mates(reads: DataFrame) -> DataFrame:
    """Reads (name, is_first, pos, mate_pos) whose mate isn't among them, as places to fetch: name, is_first, pos."""
    have = reads.select("name", (~F.col("is_first")).alias("is_first"), F.col("pos").alias("mate_pos")).distinct()
    return reads.join(have, ["name", "is_first", "mate_pos"], "left_anti").select("name", (~F.col("is_first")).alias("is_first"), F.col("mate_pos").alias("pos"))


def drop_near_repeats(reads: DataFrame, radius: int = 100) -> DataFrame:
    """Of a mate's records (name, is_first, pos) the first stays, and later ones only beyond the radius of all that
    stay; an ordered filter inside each name."""
    at = reads.columns.index("pos")

    def keep(rows: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for r in rows:
            if not kept or r[at] - kept[-1][at] > radius:  # they come in order, so the last one is the nearest
                kept.append(r)
        return kept

    others = [c for c in reads.columns if c not in ("name", "is_first", "pos")]
    return map_groups(reads, ["name", "is_first"], ["pos", *others], keep, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reads.schema))


# ------------------------------------------------------------------ records and filters
def combine_psvs(differences: DataFrame) -> DataFrame:
    """differences: locus, copy, s, e, allele (of that copy), ref. Overlapping ones of all copies become one record:
    its span, reference allele first, each other allele once, and the copies with their allele numbers."""
    runs = with_islands(differences, ["locus"], "_g", 0)
    rec = runs.groupBy("locus", "_g").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max_by("ref", F.length("ref")).alias("ref"), F.array_sort(F.collect_set(F.struct("copy", "allele"))).alias("_c"))
    alleles = F.array_distinct(F.concat(F.array("ref"), F.transform("_c", lambda x: x["allele"])))
    out = rec.withColumn("alleles", alleles)
    return out.select("locus", "s", "e", "alleles", F.transform("_c", lambda x: F.struct(x["copy"].alias("copy"), (F.array_position(F.col("alleles"), x["allele"]) - 1).alias("allele_ix"))).alias("copies"))


def usability(agcn: Column, pscn: Column, n_alleles: Column, ref_quality: Column, skip: Column, least_quality: float = 20) -> Column:
    """Why a variant can't place reads of a sample, the first reason that holds; `ok` if none does."""
    return (
        F.when(skip, "skip").when(agcn == 0, "zero_agcn").when(pscn.isNull(), "unknown_pscn").when(n_alleles < 2, "one_allele").when(ref_quality < least_quality, "low_reference_quality").otherwise("ok")
    )


def keep_variants(variants: DataFrame, least_quality: float) -> DataFrame:
    return variants.filter(F.col("has_psv") | (F.col("qual") >= least_quality))


def paralog_filters(n_reliable: Column, complete: Column, info: Column, agcn: Column, max_agcn: int = 8) -> Column:
    """Tags of a paralog-specific result, `PASS` if none applies."""
    tags = F.array_compact(F.array(
        F.when(agcn > max_agcn, "HighCN"), F.when(n_reliable == 0, "NoReliable"), F.when((n_reliable > 0) & (n_reliable < FEW), "FewReliable"),
        F.when(complete < RELIABLE_COMPLETE, "NoComplReliable"), F.when(info < LEAST_INFO, "LowInfoContent"),
    ))
    return F.when(F.size(tags) == 0, "PASS").otherwise(F.array_join(tags, ";"))


def consistent_copies(psvs: DataFrame, regions: DataFrame) -> DataFrame:
    """psvs and const regions with arrays of (chrom_id, s, e, strand) for all their other copies: those variants every
    copy of which lies in a copy of the region that holds their first place. chrom_id, s, e: of copy 1."""
    pairs = overlap_join(psvs, regions, residual=(F.col("b_s") <= F.col("s")) & (F.col("b_e") >= F.col("e")))
    inside = F.forall("copies", lambda c: F.exists("b_copies", lambda r: (r["chrom_id"] == c["chrom_id"]) & (r["strand"] == c["strand"]) & (r["s"] <= c["s"]) & (r["e"] >= c["e"])))
    return pairs.filter((F.size("copies") == F.size("b_copies")) & inside)


def match_copies(positions: Column, copies: Column) -> Column:
    """Which allele stands on each copy: positions are structs (chrom_id, pos, forward, allele_ix, length) of a record's
    places, copies structs (chrom_id, s, e, forward). Of a reverse place its last base counts. Null where no place lies in
    a copy; of several the first."""
    at = lambda p: p["pos"] + F.when(p["forward"], 0).otherwise(p["length"] - 1)
    inside = lambda c: F.filter(positions, lambda p: (p["chrom_id"] == c["chrom_id"]) & (p["forward"] == c["forward"]) & (at(p) >= c["s"]) & (at(p) < c["e"]))
    return F.transform(copies, lambda c: F.get(inside(c), F.lit(0))["allele_ix"])


def continued_copies(a: Column, b: Column, max_gap: int) -> Column:
    """Copies of one region continued by those of the next: each of a's takes the first of b's not yet taken that lies on its
    contig and strand, behind it (before it on the reverse strand), less than max_gap away. An array of the spans in a's
    order, or null where one of a's has none. a, b: arrays of (chrom_id, s, e, forward), a few entries."""
    span = "array<struct<chrom_id:bigint,s:bigint,e:bigint,forward:boolean>>"
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast(span).alias("out"), F.lit(True).alias("ok"))

    def step(state: Column, x: Column) -> Column:
        def follows(y: Column, i: Column) -> Column:
            first, second = F.when(x["forward"], x).otherwise(y), F.when(x["forward"], y).otherwise(x)
            near = (second["s"] - first["e"] < max_gap) & (first["s"] <= second["s"]) & (first["e"] <= second["e"])
            return (y["chrom_id"] == x["chrom_id"]) & (y["forward"] == x["forward"]) & ~F.array_contains(state["taken"], i) & near

        found = F.get(F.filter(F.transform(b, lambda y, i: F.when(follows(y, i), i)), lambda i: i.isNotNull()), F.lit(0))

        def taken(k: Column) -> Column:
            y = F.get(b, k)
            whole = F.struct(x["chrom_id"].cast("bigint").alias("chrom_id"), F.least(x["s"], y["s"]).cast("bigint").alias("s"), F.greatest(x["e"], y["e"]).cast("bigint").alias("e"), x["forward"].alias("forward"))
            return F.struct(F.array_append(state["taken"], F.coalesce(k, F.lit(-1))).alias("taken"), F.array_append(state["out"], whole).alias("out"), (state["ok"] & k.isNotNull()).alias("ok"))

        return let(found, taken)

    return F.aggregate(a, start, step, lambda state: F.when(state["ok"], state["out"]))


def best_two(probabilities: DataFrame, keys: Sequence[str], state: str, ln_prob: str, least: float = 0.05) -> DataFrame:
    """States whose probability is at least this, or else the best two: an array of (state, prob), best first."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ln_prob), state)
    ranked = probabilities.withColumn("_k", F.row_number().over(w)).filter((F.exp(F.col(ln_prob)) >= least) | (F.col("_k") <= 2))
    rows = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_k", state, F.exp(F.col(ln_prob)).alias("prob")))).alias("_a"))
    likely = lambda a: F.filter(a, lambda x: x["prob"] >= least)
    chosen = F.when(F.size(likely("_a")) >= 1, likely("_a")).otherwise(F.slice("_a", 1, 2))
    return rows.select(*keys, F.transform(chosen, lambda x: F.struct(x[state].alias(state), x["prob"].alias("prob"))).alias("states"))


def best_of_copies(df: DataFrame, keys: Sequence[str], pscn_qual: str, agcn_qual: str) -> DataFrame:
    """Of overlapping copies' rows the one with the largest of min(pscn, agcn) quality."""
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    order = F.struct(F.least(pscn_qual, agcn_qual), F.col(pscn_qual), F.col(agcn_qual), row)  # of equals the largest row
    best = df.groupBy(*keys).agg(F.max_by(row, order).alias("_r"))
    return best.select(*keys, "_r.*")


# ------------------------------------------------------------------ ordered greedy steps
def pick_peaks(df: DataFrame, key: str, order: str, value: str, least: float, distance: int) -> DataFrame:
    """Local maxima of each key, the higher first, none closer than distance to one that stays. Maxima are found with
    lag and lead, so the greedy step only sees those, and only a run of them without a gap of the distance at a time."""
    w = Window.partitionBy(key).orderBy(order)
    left, right = F.lag(value).over(w), F.lead(value).over(w)
    maxima = df.filter(F.lit(True)).withColumn("_l", left).withColumn("_r", right).filter((F.col(value) >= least) & (F.col("_l").isNull() | (F.col(value) >= F.col("_l"))) & (F.col("_r").isNull() | (F.col(value) > F.col("_r"))))

    maxima = with_sessions(maxima.select(key, order, value), [key], order, distance - 1, "_run")

    def keep(rows: list[tuple]) -> list[tuple]:
        near = Spaced(distance)
        return sorted((r[:3] for r in sorted(rows, key=lambda r: (-r[2], r[1])) if near.take(r[1])), key=lambda r: r[1])

    kinds = dict(df.dtypes)
    return map_groups(maxima.select(key, order, value, "_run"), [key, "_run"], [order], keep, f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}")


def read_clusters(df: DataFrame, key: str, pos: str, max_gap: int, max_span: int, padding: int) -> DataFrame:
    """Positions of a read end gathered into places: a new one behind a gap, or where the place would get too long. Runs
    without a gap come first, so what is gathered in one list is one of them and not all of a key's positions."""
    df = with_sessions(df.select(key, pos), [key], pos, max_gap, "_run")

    def gather(rows: list[tuple]) -> list[tuple]:
        out: list[list[int]] = []
        for r in rows:
            if out and r[1] - out[-1][0] <= max_span:
                out[-1][1] = r[1]
                out[-1][2] += 1
            else:
                out.append([r[1], r[1], 1])
        return [(rows[0][0], max(0, s - padding), e + padding + 1, n) for s, e, n in out]

    return map_groups(df.select(key, pos, "_run"), [key, "_run"], [pos], gather, f"{key} {dict(df.dtypes)[key]}, s bigint, e bigint, n bigint")


def group_small_regions(df: DataFrame, key: str, target: int = 20_000_000, alone: int = 1_000_000) -> DataFrame:
    """Regions (key, region_id, s, e) in order, gathered up to a total length; long ones stay alone. Adds group_ix."""
    names = df.columns
    s, e = names.index("s"), names.index("e")

    def gather(rows: list[tuple]) -> list[tuple]:
        out, group, held = [], 0, 0
        for r in rows:
            size = r[e] - r[s]
            if held and (size >= alone or held + size > target):
                group, held = group + 1, 0
            out.append((*r, group))
            held += size
            if size >= alone:
                group, held = group + 1, 0
        return out

    others = [c for c in names if c not in (key, "s")]
    return map_groups(df, [key], ["s", *others], gather, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), "group_ix bigint"]))


def smooth_runs(df: DataFrame, key: str, order: str, flag: str, least: int) -> DataFrame:
    """Boolean runs shorter than `least` are flipped, the first one first, until there is none."""
    from .copynumber import smooth_short_runs

    def smooth(rows: list[tuple]) -> list[tuple]:
        return [(k, o, v) for (k, o, _), v in zip(rows, smooth_short_runs([bool(r[2]) for r in rows], least))]

    kinds = dict(df.dtypes)
    return map_groups(df.select(key, order, flag), [key], [order], smooth, f"{key} {kinds[key]}, {order} {kinds[order]}, {flag} boolean")

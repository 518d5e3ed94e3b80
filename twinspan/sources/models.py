"""Copy-number models as text: one line an entry, and the tables that a run reads from it.

A line is `kind region1 regions2 info`, tab-separated: region1 as `chrom:start-end`, regions2 as a comma-separated list
of regions with their strands or `*`, info as `key=value` pairs joined by `;`. Kinds: see KINDS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import parse_info
from ..operators.intervals import format_region, parse_region

# The kinds of entries, in the order in which they are written.
KINDS = ("main", "duplication", "skip_region", "region_group", "const_region", "window", "hmm_paths", "psv")
ENTRY = "kind string, locus string, chrom string, s bigint, e bigint, regions2 array<struct<chrom:string,s:bigint,e:bigint,forward:boolean>>, info map<string,string>"


def regions2_text(regions: Column) -> Column:
    """`chr1:11-20:+,chr2:5-9:-`, or `*` for none."""
    one = lambda r: F.concat(format_region(r["chrom"], r["s"], r["e"]), F.when(r["forward"], ":+").otherwise(":-"))
    return F.when(F.coalesce(F.size(regions), F.lit(0)) > 0, F.array_join(F.transform(regions, one), ",")).otherwise("*")


def parse_regions2(text: Column) -> Column:
    def one(t: Column) -> Column:
        r = parse_region(t)
        return F.struct(r["chrom"].alias("chrom"), r["start"].alias("s"), r["end"].alias("e"), (r["strand"] == "+").alias("forward"))

    return F.when(text == "*", F.array().cast("array<struct<chrom:string,s:bigint,e:bigint,forward:boolean>>")).otherwise(F.transform(F.split(text, ","), one))


def info_text(info: Column) -> Column:
    pairs = F.array_sort(F.map_entries(info))
    return F.when(F.coalesce(F.size(info), F.lit(0)) > 0, F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), ";")).otherwise("*")


def model_lines(entries: DataFrame) -> DataFrame:
    """(ord, locus, value) of entries with the columns of ENTRY."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    line = F.concat_ws("\t", "kind", format_region(F.col("chrom"), F.col("s"), F.col("e")), regions2_text(F.col("regions2")), info_text(F.col("info")))
    return entries.select(order.alias("ord"), "locus", "chrom", "s", "e", line.alias("value"))


def write_model(entries: DataFrame, path: str) -> None:
    """A folder a locus, each sorted by kind and place. Loci are dealt out by their name, so a model of any number of them is
    written by as many tasks; one locus has some thousand lines."""
    lines = model_lines(entries).repartition("locus").sortWithinPartitions("locus", "ord", "chrom", "s", "e", "value")
    lines.select("locus", "value").write.mode("overwrite").partitionBy("locus").text(path)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """Entries with the columns of ENTRY; a line of another kind, or that can't be parsed, is an error."""
    rows = spark.read.option("basePath", path).schema("value string, locus string").text(path).filter("value <> '' and not startswith(value, '#')").withColumn("_f", F.split("value", "\t"))
    f = lambda i: F.get("_f", F.lit(i))
    region = parse_region(f(1))
    known = F.when(f(0).isin(*KINDS) & region["start"].isNotNull(), f(0)).otherwise(F.raise_error(F.concat(F.lit("unexpected entry: "), F.col("value"))))
    info = F.when(f(3) == "*", F.create_map().cast("map<string,string>")).otherwise(parse_info(f(3)))
    return rows.select(known.alias("kind"), "locus", region["chrom"].alias("chrom"), region["start"].alias("s"), region["end"].alias("e"), parse_regions2(f(2)).alias("regions2"), info.alias("info"))


def select_loci(entries: DataFrame, subset: list[str]) -> DataFrame:
    """Entries of the loci asked for: names, or all where none is given, without those that come as `!name`. A name that no
    locus has is an error."""
    taken, out = [n for n in subset if not n.startswith("!")], [n[1:] for n in subset if n.startswith("!")]
    names = {r["locus"] for r in entries.filter(F.col("locus").isin(taken + out)).select("locus").distinct().collect()}  # of those given by hand
    if missing := sorted({*taken, *out} - names):
        raise ValueError(f"no such locus: {', '.join(missing)}")
    kept = entries.filter(F.col("locus").isin(taken)) if taken else entries
    return kept.filter(~F.col("locus").isin(out)) if out else kept


def window_entries(windows: DataFrame) -> DataFrame:
    """windows: locus, window_ix, chrom, s, e, regions2, gc, multiplier, in_hmm."""
    text = lambda c: F.col(c).cast("string")
    info = F.map_filter(F.create_map(*(x for k in ("window_ix", "gc", "multiplier", "in_hmm") for x in (F.lit(k), text(k)))), lambda _, v: v.isNotNull())
    return windows.select(F.lit("window").alias("kind"), "locus", "chrom", "s", "e", "regions2", info.alias("info"))


def psv_entries(psvs: DataFrame) -> DataFrame:
    """psvs: locus, chrom, s, e, regions2, fvalues (array of doubles, null where none was fitted), reliable."""
    values = F.array_join(F.transform("fvalues", lambda v: F.coalesce(F.round(v, 6).cast("string"), F.lit("?"))), ",")
    info = F.create_map(F.lit("fval"), values, F.lit("reliable"), F.col("reliable").cast("string"))
    return psvs.select(F.lit("psv").alias("kind"), "locus", "chrom", "s", "e", "regions2", info.alias("info"))


def model_windows(entries: DataFrame) -> DataFrame:
    """locus, window_ix, s, e, gc, multiplier, in_hmm of a model: what copy numbers with a given model need."""
    info = lambda k: F.col("info")[k]
    return entries.filter("kind = 'window'").select("locus", info("window_ix").cast("bigint").alias("window_ix"), "s", "e", info("gc").cast("bigint").alias("gc"), info("multiplier").cast("double").alias("multiplier"), info("in_hmm").cast("boolean").alias("in_hmm"))


def model_psvs(entries: DataFrame) -> DataFrame:
    """locus, s, e, fvalues, reliable of a model."""
    values = F.transform(F.split(F.col("info")["fval"], ","), lambda v: v.try_cast("double"))
    return entries.filter("kind = 'psv'").select("locus", "s", "e", values.alias("fvalues"), F.col("info")["reliable"].cast("boolean").alias("reliable"))


def region_mismatches(entries: DataFrame, regions: DataFrame) -> DataFrame:
    """Const regions of a run (locus, chrom, s, e, regions2) that a model doesn't have with the same copies, and the model's
    that the run doesn't have: both must be none before the model is used."""
    own = entries.filter("kind = 'const_region'").select("locus", "chrom", "s", "e", regions2_text(F.col("regions2")).alias("copies"))
    run = regions.select("locus", "chrom", "s", "e", regions2_text(F.col("regions2")).alias("copies"))
    return own.exceptAll(run).withColumn("where", F.lit("model")).union(run.exceptAll(own).withColumn("where", F.lit("run")))

"""What is made of many rows' texts in arrays, or without a map, against the operators that take a row's operations."""

import pyarrow as pa
from pyspark.sql import functions as F

from twinspan.functions.expressions import info_value, parse_info
from twinspan.operators import cigars as cg
from twinspan.plans import catalog

SF = "/root/testdata/sf0.001"
TEXTS = ["5=2I3=4D6=", None, "", "3S10=", "x4=7", "12=1X2N5M3H", "4D5=", "05=10I1D2=", "3I", "2D", "100=", "1=1I1=1D1=1X", "7H2I5=2D1I3=2S"]


def _plan(name, spark) -> str:
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_lift_and_parts_of_many(spark):
    """no operation of an alignment goes through a lambda; equal to those that do."""
    assert "aggregate(" not in _plan("l03_liftover", spark) and "aggregate(" not in _plan("l05_sub_cigar", spark)
    rows = [(t, s, e) for t in TEXTS for s in range(-1, 22, 2) for e in range(s, 24, 3)]
    df = spark.createDataFrame(rows, "c string, s long, e long")
    ops = cg.parse_cigar(F.col("c"))
    want = df.select("c", "s", "e", cg.lift(ops, F.col("s"), F.col("e")).alias("l"), cg.format_cigar(cg.sub_cigar(cg.segments(ops), F.col("s"), F.col("e"))).alias("p")).collect()
    got = cg.with_alignments(df, "c", lambda x, c: [*x.lift(c("s"), c("e")), x.sub_texts(c("s"), c("e"))], "ls long, le long, p string").collect()
    key = lambda r: (str(r["c"]), r["s"], r["e"])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert (a["ls"], a["le"]) == ((b["l"]["s"], b["l"]["e"]) if b["l"] else (None, None)), (a, b)
        assert a["p"] == b["p"], (a, b)


def test_other_ways_round_of_many(spark):
    """F11."""
    assert "transform(" not in _plan("l10_reverse_revert", spark)
    df = spark.createDataFrame([(t,) for t in TEXTS], "c string").repartition(1)
    ops = cg.parse_cigar(F.col("c"))
    made = cg.with_alignments(df, "c", lambda x, c: [x.texts(), x.texts(reverse=True), x.texts(revert=True)], "a string, b string, r string")
    want = df.select("c", cg.format_cigar(ops), cg.format_cigar(cg.reverse_cigar(ops)), cg.format_cigar(cg.revert_cigar(ops)))
    assert sorted(map(tuple, made.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert cg.Alignments(pa.array(TEXTS).slice(3, 5)).texts().to_pylist() == ["3S10=", "4=", "12=1X2N5M3H", "4D5=", "5=10I1D2="]
    assert cg.Alignments(pa.array([], pa.string())).texts().to_pylist() == []


def test_values_of_keys_without_a_map(spark):
    """F8: the map was made once for each value."""
    assert "map_from_entries" not in _plan("p02_typed_info", spark)
    texts = ["SS=0.97;X=abc;X=last;flag", "SS=1;SS", "SS;SS=2", "ASS=3;SS=4=5", "SS=", "", None, ";;SS=7;;", "X=SS=1", "SS", "A=;SS=1;SS=;A=2", "a\nb=1;SS=x\ny"]
    df = spark.createDataFrame([(t,) for t in texts], "info string")
    for key in ("SS", "X", "flag", "A"):
        for r in df.select("info", info_value(F.col("info"), key).alias("got"), F.try_element_at(parse_info(F.col("info")), F.lit(key)).alias("want")).collect():
            assert r["got"] == r["want"], (key, r)

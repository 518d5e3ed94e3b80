"""Queries of alignments: one for each row of lineitem, made of its numbers so that SQL knows its places by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lambdas import let
from ..operators import alignment as al
from ..operators import cigars as cg
from .analogs import view

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# q matches, a mismatch, ln inserted, m matches, ln + 1 deleted, 5 matches
_CIG = "concat(CAST(CAST(l_quantity AS BIGINT) AS STRING), '=1X', CAST(l_linenumber AS STRING), 'I', CAST(l_suppkey % 9 + 1 AS STRING), '=', CAST(l_linenumber + 1 AS STRING), 'D5=')"
_ROWS = f"SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS id, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS ln, CAST(l_suppkey % 9 + 1 AS BIGINT) AS m, {_CIG} AS cigar FROM "
_C = f"({_ROWS}lineitem)"
_LENGTHS = "(SELECT *, q + 1 + m + ln + 1 + 5 AS ref_len, q + 1 + ln + m + 5 AS read_len FROM " + _C + ")"


def _cigars(spark, d) -> DataFrame:
    return spark.sql(_ROWS + "{src}", src=view(spark, d, "lineitem"))


def _parsed(spark, d, *columns) -> DataFrame:
    """Columns made of the parsed operations, which are computed once a row; each of columns: (name, f(ops))."""
    made = let(cg.parse_cigar(F.col("cigar")), lambda ops: F.struct(*(f(ops).alias(n) for n, f in columns)))
    return _cigars(spark, d).select("id", "q", "ln", "m", F.inline(F.array(made)))


@query(f"SELECT id, cigar, ref_len, read_len, q + 1 + m + 5 AS aligned, 1 + ln + ln + 1 AS edits, q + m + 5 - 4 - (6 + ln) - (6 + ln + 1) AS score FROM {_LENGTHS}")
def l01_cigar_lengths(spark, d) -> DataFrame:
    rows = _parsed(spark, d, ("cigar", cg.format_cigar), ("t", cg.alignment_stats))
    return rows.select("id", "cigar", "t.ref_len", "t.read_len", "t.aligned", (F.col("t.mismatches") + F.col("t.insertions") + F.col("t.deletions")).alias("edits"), "t.score")


@query(f"""SELECT id, q // 2 AS s, CASE WHEN m >= 2 THEN q + 1 + ln + 2 ELSE q + 1 + ln + m END AS e FROM {_C}""")
def l03_liftover(spark, d) -> DataFrame:
    """Lifts one interval of each alignment, from inside its first block to inside its second, to its read."""
    return cg.with_alignments(_cigars(spark, d).select("id", "q", "cigar"), "cigar", lambda all_of, c: [*all_of.lift(c("q") // 2, c("q") + 3)], "s bigint, e bigint").select("id", "s", "e")


@query(f"""SELECT id, q AS inside_s, q + 1 + least(ln, ln % 3) AS inside_e, q + 1 + ln + m AS gone_s, q + 1 + ln + m AS gone_e FROM {_C}""")
def l03_aligned_regions(spark, d) -> DataFrame:
    """The mismatch with a part of the insertion behind it, as an allele so much longer takes; and a stretch inside the
    deletion, which is an empty place."""
    one = lambda ops: cg.aligned_region(ops, F.col("q"), F.col("q") + 1, F.col("ln") % 3)
    gone = lambda ops: cg.aligned_region(ops, F.col("q") + 1 + F.col("m"), F.col("q") + 2 + F.col("m"))
    rows = _parsed(spark, d, ("a", one), ("b", gone))
    return rows.select("id", F.col("a.s").alias("inside_s"), F.col("a.e").alias("inside_e"), F.col("b.s").alias("gone_s"), F.col("b.e").alias("gone_e"))


@query(f"""SELECT id, q + 1 + ln AS read_s, q + 1 + ln + m + 1 AS read_e, q + 2 AS ref_e, q + 2 AS ref_s FROM {_C}""")
def l04_regions(spark, d) -> DataFrame:
    """From the second block to inside the deletion, on the read; and from inside the insertion on, on the reference."""
    read = lambda ops: cg.read_region(ops, F.col("q") + 1, F.col("q") + 1 + F.col("m") + 1)
    ref = lambda ops: cg.ref_region(ops, F.col("q") + 1, F.col("q") + 1 + F.col("ln") + 1)
    rows = _parsed(spark, d, ("a", read), ("b", ref))
    return rows.select("id", F.col("a.s").alias("read_s"), F.col("a.e").alias("read_e"), F.col("b.s").alias("ref_s"), F.col("b.e").alias("ref_e"))


@query(f"SELECT id, concat(CAST(q - q // 2 AS STRING), '=1X', CAST(ln AS STRING), 'I', CAST(least(m, 2) AS STRING), '=') AS part FROM {_C}")
def l05_sub_cigar(spark, d) -> DataFrame:
    return cg.with_alignments(_cigars(spark, d).select("id", "q", "cigar"), "cigar", lambda all_of, c: [all_of.sub_texts(c("q") // 2, c("q") + 3)], "part string").select("id", "part")


@query(f"""WITH c AS (SELECT DISTINCT q, ln, m FROM {_C}) SELECT q, ln, m, q AS ref_s, q + 1 AS ref_e, q AS read_s, q + 1 + ln AS read_e FROM c
    UNION ALL SELECT q, ln, m, q + m, q + 1 + m + ln + 1, q + ln + m, q + 1 + ln + m FROM c""")
def l06_differences(spark, d) -> DataFrame:
    """Of each different alignment: the mismatch with the insertion behind it, and the deletion with the base before it."""
    rows = _cigars(spark, d).select("q", "ln", "m", "cigar").distinct().withColumn("ops", cg.parse_cigar(F.col("cigar")))
    return cg.differences(rows, "ops", ["q", "ln", "m"])


@query(f"SELECT id, count(*) AS n FROM (SELECT id, unnest(range(q + 1 + m + 5)) FROM {_C}) GROUP BY 1")
def l07_aligned_pairs(spark, d) -> DataFrame:
    rows = _parsed(spark, d, ("segs", cg.segments))
    return cg.aligned_pairs(rows, "segs", ["id"]).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT item_id, i, substr(text, CAST(i AS INTEGER), 1) = substr(reverse(text), CAST(i AS INTEGER), 1) AS same FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark)),
    r AS (SELECT *, i - row_number() OVER (PARTITION BY item_id, same ORDER BY i) AS g FROM c), k AS (SELECT item_id, same, g, count(*) AS n, min(i) AS lead_i FROM r GROUP BY 1, 2, 3)
    SELECT item_id, string_agg(concat(CAST(n AS STRING), CASE WHEN same THEN '=' ELSE 'X' END), '' ORDER BY lead_i) AS cigar FROM k GROUP BY 1""")
def l08_extended_cigar(spark, d) -> DataFrame:
    """Each passage against itself read backwards."""
    return view(spark, d, "benchmark").select("item_id", cg.format_cigar(cg.extended_cigar(F.col("text"), F.reverse("text"))).alias("cigar"))


@query(f"SELECT id, CAST(q AS STRING) || '=1X' || CAST(ln AS STRING) || 'D' || CAST(m AS STRING) || '=' || CAST(ln + 1 AS STRING) || 'I5=' AS reverted, '5=' || CAST(ln + 1 AS STRING) || 'D' || CAST(m AS STRING) || '=' || CAST(ln AS STRING) || 'I1X' || CAST(q AS STRING) || '=' AS reversed FROM {_C}")
def l10_reverse_revert(spark, d) -> DataFrame:
    rows = cg.with_alignments(_cigars(spark, d).select("id", "cigar"), "cigar", lambda all_of, c: [all_of.texts(revert=True), all_of.texts(reverse=True)], "reverted string, reversed string")
    return rows.select("id", "reverted", "reversed")


@query("SELECT o_orderkey, CAST(o_custkey % 7 AS BIGINT) AS start, 'T' AS ref, 'TACG' AS alt FROM orders")
def f17_left_normalized(spark, d) -> DataFrame:
    """A unit put in anywhere in a run of ACG ends up behind the last T before the run."""
    rows = view(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 7 + 1).cast("int").alias("k"))
    rows = rows.select("o_orderkey", F.concat(F.expr("repeat('T', k)"), F.lit("ACG" * 10)).alias("seq"), (F.col("k") + F.col("o_orderkey") % 20).cast("bigint").alias("start"))
    at = lambda n, size: F.expr(f"substring(seq, cast(start as int) + {n}, {size})")
    moved = al.normalized_indels(rows.withColumn("ref", at(1, 1)).withColumn("alt", at(1, 4)), "seq", "start", "ref", "alt")
    return moved.select("o_orderkey", "start", "ref", "alt")


@query(f"SELECT id, CASE WHEN len // 2 < q + 1 THEN len // 2 WHEN len // 2 < q + 1 + ln THEN q ELSE len // 2 - ln + CASE WHEN len // 2 >= q + 1 + ln + m THEN ln + 1 ELSE 0 END END AS middle FROM (SELECT *, q + 1 + ln + m + 5 AS len FROM {_C})")
def f22_read_middle(spark, d) -> DataFrame:
    rows = _parsed(spark, d, ("middle", lambda ops: cg.read_middle(ops, cg.cigar_length(ops, cg.READ_OPS))))
    return rows.select("id", "middle")


@query("""SELECT id, ln > len(list_filter(range(1, ln + 1), lambda i: i * 7 % 30 < 10)) + 1 OR m > len(list_filter(range(ln + q + 1, ln + q + m + 1), lambda i: i * 7 % 30 < 10)) + 1 AS clipped FROM """ + _C)
def f23_true_clipping(spark, d) -> DataFrame:
    """Reads with ln and m bases clipped; the quality of base i is 7 i mod 30."""
    n = (F.col("ln") + F.col("q") + F.col("m")).cast("int")
    quality = F.transform(F.sequence(F.lit(1), n), lambda i: i * 7 % 30)
    text = F.concat(F.col("ln").cast("string"), F.lit("S"), F.col("q").cast("string"), F.lit("="), F.col("m").cast("string"), F.lit("S"))
    return _cigars(spark, d).select("id", cg.truly_clipped(cg.parse_cigar(text), quality, 10, 1).alias("clipped"))

"""Analog views over the driver's tables, as DataFrames and as SQL for the oracle.

Contigs, intervals, reads, depths, alleles, homology rows, sequences and state runs, each a narrow projection
or one aggregation of a table. Intervals have ids made of the row itself, not of a global row number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DAY = "((year({d})-1992)*372+(month({d})-1)*31+day({d})-1)*10"
_ACGT = "translate(text,'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ','ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC')"
_HOM = "(l_orderkey * 8 + l_linenumber)"

# Each body reads the same on Spark and DuckDB.
BODIES = {
    "iv_a": f"""SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS a_id, CAST(l_suppkey % 100 AS BIGINT) AS chrom_id,
        CAST({_DAY.format(d='l_shipdate')} AS BIGINT) AS s, CAST({_DAY.format(d='l_shipdate')} + CAST(l_quantity AS BIGINT) AS BIGINT) AS e FROM lineitem""",
    "iv_b": f"""SELECT CAST(o_orderkey AS BIGINT) AS b_id, CAST(o_custkey % 100 AS BIGINT) AS chrom_id,
        CAST({_DAY.format(d='o_orderdate')} AS BIGINT) AS s, CAST({_DAY.format(d='o_orderdate')} + 1 + o_orderkey % 97 AS BIGINT) AS e FROM orders""",
    "contigs": "SELECT CAST(s_suppkey % 100 AS BIGINT) AS chrom_id, CAST(26500 AS BIGINT) AS length FROM supplier GROUP BY 1",
    "reads": """SELECT CAST(event_id AS BIGINT) AS read_id, CAST(user_id % 10 AS BIGINT) AS sample_id, CAST(user_id AS BIGINT) AS user_id,
        CAST((day(ts)-1)*86400+hour(ts)*3600+minute(ts)*60+floor(second(ts)) AS BIGINT) AS pos, CAST(floor(value) AS BIGINT) % 61 AS mapq,
        CAST(event_id % 2 AS BIGINT) AS is_read2, CASE WHEN event_id % 50 = 0 THEN 1024 WHEN event_id % 41 = 0 THEN 256 ELSE 0 END AS flag,
        CASE WHEN event_type = 'error' AND value > 100 THEN 1 ELSE 0 END AS clipped, CASE WHEN event_type = 'signup' AND value > 100 THEN 1 ELSE 0 END AS unpaired FROM events""",
    "allele_counts": """SELECT CAST(l_partkey % 50 AS BIGINT) AS psv_ix, CAST(l_suppkey % 20 AS BIGINT) AS sample_id, CAST(sum(CASE WHEN l_returnflag='A' THEN 1 ELSE 0 END) AS BIGINT) AS n0,
        CAST(sum(CASE WHEN l_returnflag='N' THEN 1 ELSE 0 END) AS BIGINT) AS n1, CAST(sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS BIGINT) AS n2 FROM lineitem GROUP BY 1,2""",
    "hom": f"""SELECT CAST({_HOM} AS BIGINT) AS dup_id, concat('chr', CAST(CAST(l_suppkey % 5 AS BIGINT) AS STRING)) AS chrom1,
        CAST({_DAY.format(d='l_shipdate')} AS BIGINT) AS start1, CAST({_DAY.format(d='l_shipdate')} + CAST(l_quantity AS BIGINT) AS BIGINT) AS end1,
        CASE WHEN {_HOM} % 3 = 0 THEN '-' ELSE '+' END AS strand, concat('chr', CAST(CAST((l_suppkey + l_partkey) % 5 AS BIGINT) AS STRING)) AS chrom2,
        CAST({_DAY.format(d='l_shipdate')} + l_partkey * 37 % 5000 AS BIGINT) AS start2, CAST({_DAY.format(d='l_shipdate')} + CAST(l_quantity AS BIGINT) + l_partkey * 37 % 5000 AS BIGINT) AS end2,
        l_linestatus = 'F' AND l_returnflag = 'R' AS is_tangled,
        concat('SEP=', CAST(CAST(l_partkey * 37 % 5000 AS BIGINT) AS STRING), ';ALENGTH=', CAST(CAST(l_quantity AS BIGINT) AS STRING), ';SS=0.', CAST(CAST(900 + {_HOM} % 100 AS BIGINT) AS STRING), ';av_mult=', CAST(CAST(1 + l_partkey % 4 AS BIGINT) AS STRING)) AS info FROM lineitem""",
    "seqs": f"SELECT CAST(doc_id AS BIGINT) AS doc_id, lang, {_ACGT} AS seq FROM documents",
}
BODIES["win_depth"] = """SELECT sample_id, CAST(floor(pos/43200.0) AS BIGINT) AS window_ix, CAST(30+(CAST(floor(pos/43200.0) AS BIGINT)*7)%21 AS BIGINT) AS gc,
        CAST(sum(CASE WHEN is_read2=0 THEN 1 ELSE 0 END) AS BIGINT) AS depth1, CAST(sum(CASE WHEN is_read2=1 THEN 1 ELSE 0 END) AS BIGINT) AS depth2,
        CAST(sum(CASE WHEN mapq<10 THEN 1 ELSE 0 END) AS BIGINT) AS low_mapq, CAST(sum(clipped) AS BIGINT) AS clipped, CAST(sum(unpaired) AS BIGINT) AS unpaired
        FROM reads WHERE flag & 3844 = 0 GROUP BY 1,2,3"""
BODIES["cn_runs"] = """SELECT CAST(user_id % 10 AS BIGINT) AS sample_id, CAST(row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS BIGINT) AS ix, event_type AS state FROM events"""
SOURCES = {"iv_a": "lineitem", "iv_b": "orders", "contigs": "supplier", "reads": "events", "allele_counts": "lineitem", "hom": "lineitem", "seqs": "documents", "cn_runs": "events"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An analog view; nothing is registered in the session's catalog."""
    if name == "win_depth":
        return spark.sql(BODIES[name].replace("FROM reads", "FROM {reads}"), reads=view(spark, sf_dir, "reads"))
    if name not in BODIES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source = SOURCES[name]
    return spark.sql(BODIES[name].replace(f"FROM {source}", "FROM {src}"), src=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def with_views(sql: str, *names: str) -> str:
    """The SQL with the views it needs in front."""
    needed = [n for n in (["reads"] if "win_depth" in names and "reads" not in names else []) + list(names)]
    body = ", ".join(f"{n} AS ({BODIES[n]})" for n in needed)
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.lstrip().startswith(start):
            return f"{start}{body}, {sql.lstrip()[len(start) :]}"
    return f"WITH {body} {sql}"


__all__ = ["BODIES", "view", "with_views"]

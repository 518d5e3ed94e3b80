"""Every registered query of the engine against its SQL at a small scale, and the driver's contract."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, normal
from twinspan.plans import catalog
from twinspan.plans.analogs import view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE:
        want = con.execute(catalog.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_reads_only_what_it_needs(spark):
    plan = catalog.QUERIES["j02_interval_overlap_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_alignments_are_of_whole_passages(spark):
    texts = {r["item_id"]: r["text"] for r in view(spark, SF, "benchmark").collect()}
    rows = catalog.QUERIES["l12_alignment"](spark, SF).collect()
    assert max(map(len, texts.values())) > 200
    for r in rows:
        ops = [(int(n), k) for n, k in re.findall(r"(\d+)([^\d])", r["cigar"])]
        assert sum(n for n, k in ops if k in "=XMD") == len(texts[r["item_id"]])
        assert sum(n for n, k in ops if k in "=XMI") == len(texts[r["item_id"] + 1])

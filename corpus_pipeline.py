"""The corpus pipeline: quality classifier, quality rules, SimHash near-dedup, substring dedup, packing.

Each stage's result is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from twinspan.llm.common import discard_all_but, materialize, table, tables_made  # noqa: E402
from twinspan.llm.stages import STAGES  # noqa: E402

#: The classifier is trained and SimHash, hashing and tokenizers have no DuckDB twin; tests/llm checks the
#: stages against brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's result is a table in the shared folder; what the stage before has left
    there, its result included, is deleted as soon as the next result is written."""
    docs, before = table(spark, sf_dir, "documents"), tables_made()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard_all_but(spark, before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)

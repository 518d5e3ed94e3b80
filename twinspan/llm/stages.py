"""Stage functions of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame, each applying one operator to
all rows it is given. All but the last return the columns of documents.

The near-duplicate stage finds candidates by SimHash and Golay keys as op4 does, and compares sets of 5-word shingles
exactly, at a similarity of 0.8; op4's digest is its own.

In every stage null texts are empty texts, very long ones are read whole, further columns are carried along whatever their names, and an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .packing import pack_documents
from .quality_classifier import accepted, fit, stats
from .quality_rules import fit_ratio, kept_rows, trusted_rows
from .similar import similar_rows
from .substrings import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts, as they are: each is judged where it lies, repeated rows and null ids too."""
    return accepted(docs, fit(stats(docs), table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the rules, as they are: each is judged where it lies, repeated rows and null ids too."""
    return kept_rows(docs, fit_ratio(docs, trusted_rows(spark, sf_dir)))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: of the smallest id, and of its texts the one of the least hash; of
    equal rows one. Rows without an id stay. An id with different texts is different documents."""
    stay = similar_rows(docs).filter("stays").select(F.col("id").alias("__twinspan_id"), F.col("t").alias("__twinspan_t")).distinct()
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    known = docs.join(stay, (F.col("doc_id") == F.col("__twinspan_id")) & (mark == F.col("__twinspan_t")))
    order = Window.partitionBy("__twinspan_id", "__twinspan_t").orderBy(F.xxhash64(*docs.columns))
    one = known.withColumn("__twinspan_k", F.row_number().over(order)).filter("__twinspan_k = 1")
    return one.select(docs.columns).union(docs.filter("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without repeated spans and n_chars counted anew; a null text has none. Rows of one id and
    text stay alike."""
    return remove_repeats(docs, removed_col="__twinspan_removed").drop("__twinspan_removed").withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all rows, repeated ones each by themselves; a null text is the end id alone. Other columns are not read."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio between the trusted target's and the
raw corpus' multinomials, per n-gram, with one fixed threshold for every document.

DataFrame functions only. The n-grams are single words and pairs of neighbouring words, hashed into BUCKETS
buckets; the ratio's model is one double per bucket, whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

BUCKETS = 1 << 16
PRIOR = 10.0  # counts added to a bucket's target count and to the count expected there
#: nats per n-gram. Chosen on the 0.1 table with the trusted rows of one half of the labels (by crc32 of the id): of
#: the other half, which the fit hadn't seen, good documents score over -0.102 and bad ones under -0.143.
THRESHOLD = -0.1
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words in repeated 3-word windows
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: a lambda's variable is never replaced by its expression,
    while the optimizer may put a projected column's into a lambda that runs once an element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def grams(h: Column) -> Column:
    """Buckets of the words and of the pairs of neighbouring words, from the words' hashes."""
    bucket = lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")
    pairs = F.transform(F.sequence(F.lit(1), F.size(h) - 1), lambda i: bucket(F.xxhash64(h[i - 1], h[i])))
    return F.concat(F.transform(h, bucket), F.when(F.size(h) > 1, pairs).otherwise(F.array().cast("array<int>")))


def _window(w: Column, i: Column) -> Column:
    return F.concat_ws(" ", w[i - 1], w[i], w[i + 1])


def n_repeat_words(w: Column, h: Column) -> Column:
    """Words in 3-word windows that the text has twice or more; h: the words' hashes.

    Each window's half hash and place make one long: primitives sort fast, and only windows that share the half
    hash with another one (all true repeats among them) go on to be compared as words. Equal windows then
    stand side by side, sorted with their places; each place that has an equal neighbour adds those of its
    three words which the place before it hasn't covered."""
    half = lambda i: F.shiftleft(F.xxhash64(h[i - 1], h[i], h[i + 1]), 32).bitwiseOR(i.cast("long"))
    packed = F.sort_array(F.transform(F.sequence(F.lit(1), F.size(w) - 2), half))
    beside = lambda of, same: F.filter(of, lambda x, k: F.coalesce(same(F.get(of, k - 1), x), F.lit(False)) | F.coalesce(same(F.get(of, k + 1), x), F.lit(False)))
    shared = lambda p: beside(p, lambda y, x: F.shiftright(y, 32) == F.shiftright(x, 32))
    place = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    compared = lambda c: F.sort_array(F.transform(c, lambda x: F.struct(_window(w, place(x)).alias("w"), place(x).alias("i"))))
    places = lambda s: F.sort_array(F.transform(beside(s, lambda y, x: y["w"] == x["w"]), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-2).alias("i"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["i"])).alias("n"), p.alias("i"))
    covered = lambda s: F.aggregate(places(s), start, step, lambda a: a["n"])
    return F.when(F.size(w) > 3, let(packed, lambda p: let(shared(p), lambda c: let(compared(c), covered)))).otherwise(F.lit(0))


def _n_dup_lines(text: Column) -> Column:
    full = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    return let(full, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def fit_ratio(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """ln((target count + PRIOR) / (expected count + PRIOR)) of each bucket: the log ratio of the target's share and the
    raw share, the less of it the fewer n-grams tell. Expected is what the raw share gives in as many n-grams.

    docs: the raw corpus; trusted: doc_ids of the target in docs. Both are counted whole. The ids may be too many to
    send to all tasks, so the join sorts and merges at every size; counts are made before the next shuffle, of at most
    BUCKETS rows a task. Rows without an id are raw only. No trusted rows, or no rows: every ratio is 0.
    """
    texts = _texts(docs, id_col, text_col)
    known = trusted.select(F.col(id_col).cast("long").alias("doc_id")).na.drop().distinct().withColumn("trusted", F.lit(1))
    flagged = texts.filter("doc_id is not null").join(known.hint("merge"), "doc_id", "left").select("trusted", "text")
    flagged = flagged.unionByName(texts.filter("doc_id is null").select(F.lit(None).cast("int").alias("trusted"), "text"))
    counted = flagged.select("trusted", F.explode(let(hashes(words(F.col("text"))), grams)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target"))
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counted.collect():  # at most BUCKETS rows
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    share = sum(target) / max(sum(raw), 1)
    return [math.log((t + PRIOR) / (r * share + PRIOR)) for t, r in zip(target, raw)]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio")


def measures(text: Column, ratio: list[float]) -> Column:
    """An array of one struct of MEASURES. Meant for inline(), which keeps the struct's expressions from being
    copied into what is selected above it."""
    model = F.split(F.lit(",".join(map(repr, ratio))), ",").cast("array<double>")  # folds into one literal

    def of(w: Column, h: Column) -> Column:
        mean = lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(model, b)) / F.greatest(F.size(g), F.lit(1))
        values = (
            F.size(w).cast("long"), F.char_length(F.translate(text, SPACES, "")).cast("long"), (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
            _n_dup_lines(text).cast("long"), n_repeat_words(w, h).cast("long"), let(grams(h), mean),
        )
        return F.struct(*(v.alias(n) for n, v in zip(MEASURES, values)))

    return F.transform(F.array(words(text)), lambda w: let(hashes(w), lambda h: of(w, h)))


def base_fails(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEATED * n_words)


def judge(docs: DataFrame, ratio: list[float], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio per row; narrow.

    Nulls: a null text has no words, so it fails the base rules; a null id is carried along. Very long texts
    are judged whole. Repeated rows each get their row. Other columns are not read. Empty: empty result.
    """
    rows = _texts(docs, id_col, text_col).select("doc_id", F.inline(measures(F.col("text"), ratio)))
    failed = base_fails(F.col("n_words"), F.col("n_repeat_words"))
    return rows.select("doc_id", *MEASURES[:-1], failed.alias("base_failed"), (~failed & (F.col("ratio") >= threshold)).alias("kept"), "ratio")


def kept_rows(docs: DataFrame, ratio: list[float], threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Rows of docs that judge() keeps, as they are: judged where they lie, without a shuffle."""
    names = docs.columns
    inner = docs.toDF(*(f"_{i}" for i in range(len(names))))
    text = F.coalesce(F.col(f"_{names.index(text_col)}").cast("string"), F.lit(""))
    rows = inner.select("*", F.inline(measures(text, ratio)))
    return rows.filter(~base_fails(F.col("n_words"), F.col("n_repeat_words")) & (F.col("ratio") >= threshold)).drop(*MEASURES).toDF(*names)


def trusted_rows(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit_ratio(docs, trusted_rows(spark, sf_dir)))

"""Quality classifier: random Fourier features of document statistics, ridge scores from normal equations
summed by partition, then isotonic calibration.

Statistics are computed once per document in Arrow batches and written as a small table; the fit and the
scores read that table. The driver gets one triangle of FEATURES^2 / 2 sums, one histogram of at most BINS
scores and the means of the statistics, whatever the number of documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialize, slices, table

FEATURES = 96  # random Fourier features
GAMMA = 0.01  # of the kernel exp(-GAMMA |x-y|^2) over standardized statistics
RIDGE = 1e-3  # times the number of labelled rows
BINS = 500
SEED = 20240917
CUT = 0.7
FOLDS, HELD_OUT, CALIBRATE = 4, 2, 3

STATS = (
    "log_words", "word_length", "word_length_sd", "short_words", "long_words", "distinct_words", "top_word", "repeated_pairs",
    "repeated_neighbours", "symbols", "symbol_words", "pipes", "digits", "upper", "upper_words", "exclaims", "punctuation_ends",
    "line_words", "repeated_lines", "non_ascii", "byte_entropy", "space_share",
)
SCHEMA = pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float32()))])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>{}[]\\^~=_@"]] = True


def document_stats(text: str | None) -> list[float]:
    """Shares and logarithms that don't depend on language or source; all finite, also for empty texts."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n, size = max(len(words), 1), max(len(data), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, int)
    share = bytes_[bytes_ > 0] / size
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    tails = Counter(w[-1:] for w in words)
    heads = Counter(w[:1] for w in words)
    upper = sum(map(bytes.isupper, words))
    symbol_ends = sum(k for w, k in tails.items() if _SYMBOL[w[0]])
    return [
        float(np.log1p(len(words))), float(min(lengths.mean(), 50)), float(min(lengths.std(), 50)), float((lengths <= 2).mean()), float((lengths > 12).mean()),
        len(counts) / n, max(counts.values(), default=0) / n, sum(k for k in pairs.values() if k > 1) / n,
        sum(k for (a, b), k in pairs.items() if a == b) / n, float(bytes_[_SYMBOL].sum()) / size, symbol_ends / n, heads.get(b"|", 0) / n,
        float(bytes_[48:58].sum()) / size, float(bytes_[65:91].sum()) / size, upper / n, float(bytes_[33]) / n, sum(tails.get(c, 0) for c in (b".", b"!", b"?", b",")) / n,
        float(np.log1p(n / max(len(lines), 1))), 1 - len(set(lines)) / max(len(lines), 1), float(bytes_[128:].sum()) / size, float(-(share * np.log2(share)).sum()) if len(share) else 0.0, float(bytes_[32]) / size,
    ]


def stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield batch_of(SCHEMA, part.column(0), [document_stats(t) for t in part.column(1).to_pylist()])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(compute, "doc_id long, stats array<float>")


class Model:
    """mean, scale: of the statistics; w, b: the random features sqrt(2/D) cos(xw + b); beta: ridge weights
    with the intercept last; edges, levels: the calibration's steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0.0, np.sqrt(2 * GAMMA), (len(STATS), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.edges, self.levels = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2 / FEATURES) * np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.b)
        return np.concatenate((z, np.ones((len(x), 1))), axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.levels)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATS)).astype(np.float64)


def isotonic(scores: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending scores: the lowest and highest score of each block, and its rate
    at both; between two blocks the calibration is a straight line."""
    blocks: list[list[float]] = []
    for s, p, n in zip(scores, positives, counts):
        blocks.append([s, s, p, n])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            low, high, p, n = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + p, blocks[-1][3] + n]
    return np.array([x for b in blocks for x in b[:2]]), np.array([b[2] / b[3] for b in blocks for _ in range(2)])


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS))


def fit(computed: DataFrame, labels: DataFrame) -> Model:
    """computed: stats(); labels: doc_id and quality (0 or 1), other values and nulls left out. Rows of fold
    HELD_OUT are never read; fold CALIBRATE calibrates, the others fit. No labelled rows: every score 0.5."""
    used = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter("y in (0, 1) and doc_id is not null")
    used = used.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("fold", fold(F.col("doc_id"))).filter(F.col("fold") != HELD_OUT)
    known = materialize(computed.filter("doc_id is not null").join(used, "doc_id"), "labelled", narrow=True)
    k = len(STATS)
    sums = known.select([F.count(F.lit(1)).alias("n")] + [f(F.col("stats")[i].cast("double")).alias(f"{f.__name__}{i}") for i in range(k) for f in (F.avg, F.stddev_pop)]).first()
    if not sums["n"]:
        return Model(np.zeros(k), np.ones(k))
    model = Model(np.array([sums[f"avg{i}"] for i in range(k)]), np.array([max(sums[f"stddev_pop{i}"], 1e-6) for i in range(k)]))
    upper = np.triu_indices(FEATURES + 2)
    part = pa.schema([("at", pa.int32()), ("value", pa.float64())])

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 2, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                y = np.asarray(batch.column("y").to_pylist())
                weight = np.sqrt(np.asarray(batch.column("weight").to_pylist()))[:, None]
                z = np.concatenate((model.features(_matrix(batch, "stats")), y[:, None]), axis=1) * weight
                total += z.T @ z
        yield batch_of(part, np.arange(len(upper[0]), dtype=np.int32), total[upper])

    training = known.filter(F.col("fold") != CALIBRATE)
    rate = training.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("y"), F.lit(0.5)).alias("y")).first()
    odds = 0.5 / np.clip(np.array([1 - rate["y"], rate["y"]]), 1e-3, 1)  # both classes weigh the same
    weighted = training.withColumn("weight", F.when(F.col("y") == 1, float(odds[1])).otherwise(float(odds[0])))
    added = weighted.select("stats", "y", "weight").mapInArrow(normal, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((FEATURES + 2, FEATURES + 2))
    for r in added:
        total[upper[0][r["at"]], upper[1][r["at"]]] = r["value"]
    total = total + np.triu(total, 1).T
    if rate["n"]:
        penalty = RIDGE * rate["n"] * np.diag(np.append(np.ones(FEATURES), 1e-6))
        model.beta = np.linalg.solve(total[:-1, :-1] + penalty, total[:-1, -1])

    binned = pa.schema([("bin", pa.int32()), ("y", pa.float64()), ("raw", pa.float64())])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r = model.raw(_matrix(batch, "stats"))
                yield batch_of(binned, np.floor(np.clip(r, -0.5, 1.5) * (BINS / 2)).astype(np.int32), batch.column("y"), r)

    rows = known.filter(F.col("fold") == CALIBRATE).select("stats", "y").mapInArrow(raw, "bin int, y double, raw double")
    bins = rows.groupBy("bin").agg(F.avg("raw").alias("raw"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    if bins:
        model.edges, model.levels = isotonic(np.array([b["raw"] for b in bins]), np.array([b["y"] for b in bins]), np.array([float(b["n"]) for b in bins]))
    return model


def score(computed: DataFrame, model: Model) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch_of(schema, batch.column("doc_id"), np.clip(model.score(_matrix(batch, "stats")), 0, 1))

    return computed.mapInArrow(scores, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of docs whose score is CUT or more, as they are. Each row is judged where it lies: statistics are
    computed again rather than joined back, so no text is shuffled, and repeated rows and null ids are no cases."""
    names = docs.columns
    inner = docs.toDF(*(f"_{i}" for i in range(len(names))))
    text = names.index(text_col)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = np.array([document_stats(t) for t in part.column(text).to_pylist()], np.float32).astype(np.float64)
            yield part.filter(pa.array(np.clip(model.score(x), 0, 1) >= CUT))

    return inner.mapInArrow(passed, inner.schema).toDF(*names)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Nulls: a null text scores like an empty one; a row without an id is scored, is never learned from, and
    is not held out. Labels that are null or neither 0 nor 1 are left out, of repeated labels the largest
    counts. Repeated rows each get their row. Very long texts are read whole. Other columns are not read. A tie at the
    threshold is predicted 1; equal scores are one point of the calibration. An empty table of documents gives an empty result.
    """
    computed = materialize(stats(docs, id_col, text_col), "stats", narrow=True)
    return score(computed, fit(computed, labels)).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Toxicity by classifier chains: one linear model per category, in a fixed order, each reading the words'
features and the probabilities of the categories before it. Later models are trained on out-of-fold
probabilities of the earlier ones, so that they see what they will see on new documents.

A document's features are the hashed presences of its words and of their first four and five letters.

The labels have one flag, `toxic`. The categories before it are KINDS of toxic documents, found among the labelled
ones themselves: clusters of those with the same telling features, whatever their language.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialize, slices, table

DIM = 1 << 18
SAMPLE = 12_000  # labelled documents that the chain is trained on, those with the least hashes; the bound of the fit
FOLDS = 3
STEPS = 250
RATE = 0.5
L2 = 1e-4
EVIDENCE = 15.0  # least G^2 of a feature against the class, so that chance alone brings in next to none
CUT = 0.5
REMEMBERED = 200_000
FIRST_CUT = 5.0  # the same over the whole sample: features under it don't reach the driver
KINDS = 2
TURNS = 20  # of the clustering
CATEGORIES = (*(f"kind_{k + 1}" for k in range(KINDS)), "toxic")
_EDGE = re.compile(r"^\W+|\W+$")


class Features:
    """Feature numbers of a text: sorted, without repeats; 0 is in every document."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        core = _EDGE.sub("", word)
        if not core:
            return ()
        keys = {core, *(f"{core[:n]}^{n}" for n in (4, 5) if len(core) >= n)}
        return tuple(1 + zlib.crc32(k.encode("utf-8", "replace")) % (DIM - 1) for k in keys)

    def __call__(self, text: str | None) -> np.ndarray:
        known, found = self.known, {0}
        if len(known) > REMEMBERED:
            known.clear()
        for w in set((text or "").lower().split()):
            ids = known.get(w)
            if ids is None:
                ids = self.of_word(w)
                if len(w) < 64:
                    known[w] = ids
            found.update(ids)
        return np.fromiter(sorted(found), np.int32, len(found))


def _g2(a: np.ndarray, b: np.ndarray, pos: float, neg: float) -> np.ndarray:
    """G^2 of the 2 x 2 table of a feature's presence against the class; a, b: documents of either class that have it."""
    n = pos + neg
    g = np.zeros(len(a))
    for k, row, column in ((a, a + b, pos), (b, a + b, neg), (pos - a, n - a - b, pos), (neg - b, n - a - b, neg)):
        expected = row * column / n
        g += np.where(k > 0, 2 * k * np.log(np.maximum(k, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return g


def _evidence(flat: np.ndarray, y_flat: np.ndarray, y: np.ndarray) -> np.ndarray:
    a = np.bincount(flat, y_flat, DIM)
    return _g2(a, np.bincount(flat, minlength=DIM) - a, y.sum(), len(y) - y.sum())


def kinds_of(rows: list[np.ndarray], toxic: np.ndarray, kinds: int = KINDS) -> np.ndarray:
    """A column of 0 and 1 per kind: clusters of the toxic rows by spherical k-means over their telling features. The
    first centre is the row most like all, each further one the row least like the centres so far; ties go
    to the first row. A toxic row without telling features is of no kind."""
    out = np.zeros((len(rows), kinds))
    flat, starts = _flat(rows)
    sizes = np.diff(np.append(starts, len(flat)))
    own = np.flatnonzero(toxic == 1)
    if not len(own) or len(own) == len(rows):
        return out
    telling = _evidence(flat, np.repeat(toxic, sizes), toxic) >= EVIDENCE
    telling &= np.bincount(flat, np.repeat(toxic, sizes), DIM) * len(rows) > np.bincount(flat, minlength=DIM) * len(own)
    telling[0] = False
    used = np.flatnonzero(telling)
    picked = [np.searchsorted(used, rows[i][telling[rows[i]]]) for i in own]
    own, picked = own[[len(p) > 0 for p in picked]], [p for p in picked if len(p)]
    if not len(own):
        return out
    ids, at = _flat(picked)
    norms = np.repeat(1 / np.sqrt([len(p) for p in picked]), [len(p) for p in picked])
    unit = lambda v: v / max(np.sqrt(v @ v), 1e-12)
    alike = lambda c: np.add.reduceat(c[ids] * norms, at)
    centres = [unit(np.bincount(picked[np.argmax(alike(unit(np.bincount(ids, norms, len(used)))))], minlength=len(used)).astype(float))]
    while len(centres) < kinds:
        centres.append(unit(np.bincount(picked[np.argmin(np.max([alike(c) for c in centres], axis=0))], minlength=len(used)).astype(float)))
    for _ in range(TURNS):
        cluster = np.argmax([alike(c) for c in centres], axis=0)
        of_id = np.repeat(cluster, [len(p) for p in picked])
        centres = [unit(np.bincount(ids[of_id == k], norms[of_id == k], len(used))) for k in range(kinds)]
    out[own, cluster] = 1
    return out


class Linear:
    """Logistic regression over the presences that tell the classes apart and a few dense inputs, both classes
    of equal weight; Adagrad over the whole sample in a fixed number of steps, so each fit is the same."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, dense: np.ndarray, y: np.ndarray):
        self.w, self.v = np.zeros(DIM), np.zeros(dense.shape[1])
        if len(y) and y.min() == y.max():
            self.w[0] = 4.0 if y[0] else -4.0
        if not len(y) or y.min() == y.max():
            return
        sizes = np.diff(np.append(starts, len(flat)))
        telling = _evidence(flat, np.repeat(y, sizes), y) >= EVIDENCE
        telling[0] = True
        keep = telling[flat]
        sizes = np.add.reduceat(keep.astype(int), starts)
        starts = np.cumsum([0, *sizes])[:-1]
        used, flat = np.unique(flat[keep], return_inverse=True)  # the fit works on these few alone
        w = np.zeros(len(used))
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
        g_w, g_v = np.full(len(used), 1e-8), np.full(dense.shape[1], 1e-8)
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[flat], starts) + dense @ self.v, -30, 30)))
            error = (p - y) * weight
            d_w = np.bincount(flat, np.repeat(error, sizes), len(used)) + L2 * w
            d_v = error @ dense + L2 * self.v
            g_w += d_w**2
            g_v += d_v**2
            w -= RATE * d_w / np.sqrt(g_w)
            self.v -= RATE * d_v / np.sqrt(g_v)
        self.w[used] = w

    def probability(self, flat: np.ndarray, starts: np.ndarray, dense: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(np.add.reduceat(self.w[flat], starts) + dense @ self.v, -30, 30)))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *map(len, rows)])[:-1]
    return (np.concatenate(rows) if rows else np.zeros(0, np.int32)), starts


class Chain:
    def __init__(self, rows: list[np.ndarray], y: np.ndarray, folds: np.ndarray):
        """rows: features by document; y: a column of 0 and 1 per category; folds: 0..FOLDS-1."""
        flat, starts = _flat(rows)
        earlier = np.zeros((len(rows), 0))
        self.models = []
        for k in range(y.shape[1]):
            self.models.append(Linear(flat, starts, earlier, y[:, k]))
            if k + 1 < y.shape[1]:
                out = np.zeros(len(rows))
                for f in range(FOLDS):
                    inside, outside = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
                    own = Linear(*_flat([rows[i] for i in inside]), earlier[inside], y[inside, k])
                    out[outside] = own.probability(*_flat([rows[i] for i in outside]), earlier[outside])
                earlier = np.concatenate((earlier, out[:, None]), axis=1)

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        flat, starts = _flat(rows)
        out = np.zeros((len(rows), 0))
        for model in self.models:
            out = np.concatenate((out, model.probability(flat, starts, out)[:, None]), axis=1)
        return out


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the SAMPLE labelled rows with the least hashes."""
    some = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic")


def fit(sample: DataFrame) -> Chain:
    """sample: doc_id, text and toxic (0 or 1), of a bounded number of rows. The driver gets at most DIM pairs of counts, summed
    by partition, and then of each row the features that tell anything about the class over the whole sample."""
    sample = materialize(sample.select("doc_id", "text", "toxic"), "labelled")
    sums = pa.schema([("at", pa.int32()), ("toxic", pa.int64()), ("n", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("toxic", pa.int32())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(), np.zeros((2, DIM), np.int64)
        for part in slices(batches):
            for text, toxic in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                ids = features(text)
                total[:, ids] += [[toxic], [1]]
        at = np.flatnonzero(total[1])
        yield batch_of(sums, at.astype(np.int32), total[0][at], total[1][at])

    a, n = np.zeros(DIM), np.zeros(DIM)
    for r in sample.mapInArrow(count, "at int, toxic long, n long").groupBy("at").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).collect():
        a[r["at"]], n[r["at"]] = r["toxic"], r["n"]
    keep = _g2(a, n - a, a[0], n[0] - a[0]) >= FIRST_CUT if n[0] else np.zeros(DIM, bool)  # feature 0 is in every row
    keep[0] = True
    keep = sample.sparkSession.sparkContext.broadcast(np.packbits(keep))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, kept = Features(), np.unpackbits(keep.value).astype(bool)
        for part in slices(batches):
            rows = [features(t) for t in part.column(1).to_pylist()]
            yield batch_of(schema, part.column(0), [r[kept[r]] for r in rows], part.column(2))

    got = sample.mapInArrow(compute, "doc_id long, ids array<int>, toxic int").toArrow().combine_chunks()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    lists = got["ids"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    ends, flat = (lists.offsets.to_numpy(), lists.values.to_numpy()) if got.num_rows else (np.zeros(1, int), np.zeros(0, np.int32))
    rows = [flat[ends[i] : ends[i + 1]] for i in order]
    toxic = got["toxic"].to_numpy()[order].astype(np.float64)
    folds = np.array([zlib.crc32(str(d).encode()) % FOLDS for d in got["doc_id"].to_numpy()[order].tolist()], int)
    return Chain(rows, np.concatenate((kinds_of(rows, toxic), toxic[:, None]), axis=1), folds)


def predict(docs: DataFrame, chain: Chain, categories: tuple[str, ...] = CATEGORIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_<category> for each category, and <last category> (1 from CUT on) for every row; narrow."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"p_{c}", pa.float64()) for c in categories)])
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # DIM doubles per category

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for part in slices(batches):
            p = sent.value.probabilities([features(t) for t in part.column(1).to_pylist()])
            yield batch_of(schema, part.column(0), *p.T)

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = read.mapInArrow(score, ", ".join(["doc_id long", *(f"p_{c} double" for c in categories)]))
    return scored.withColumn(categories[-1], (F.col(f"p_{categories[-1]}") >= CUT).cast("int"))


def op2_toxicity_chain(spark, sf_dir: str) -> DataFrame:
    """Nulls: a null text has no words; a row without an id is scored and never learned from. Labels other than
    0 and 1 are left out, of repeated labels the largest counts. No labelled rows, or of one class only:
    constant probabilities. Repeated rows each get their row, other columns are not read. Very long texts are read
    whole, a probability at the threshold is toxic, an empty table of documents gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(labelled(docs, table(spark, sf_dir, "labels"))))

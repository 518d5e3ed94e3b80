"""Substring dedup by sliding sentence spans: every run of several consecutive sentences is hashed, the
hashes meet in one join, and sentences covered by a run that isn't its first appearance are removed.

Units are sentences, which end with a line or behind a word with an end mark. One of over LONG_SENTENCE words is cut inside as well,
behind each word whose hash is the least among REACH words on either side, so that where it is cut depends on the words around and not
on where the sentence began: a repeated passage has the same units in each text, up to what is left of a sentence at its ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialize, slices, table

UNITS = 2  # in a run, or as many more as it takes to reach MIN_WORDS
MIN_WORDS = 16
LONG_SENTENCE = 24  # words of a sentence that is one unit, at most
REACH = 4  # words on either side that the end of a unit inside a sentence is the least of
MAX_UNIT = 64  # words; longer units (of one word again and again) are cut every CUT_UNIT
CUT_UNIT = 32
HOT_SHARE = 1000  # a hash with over 1 in so many of the sampled runs is joined by broadcast: at most so many are
_WORD = re.compile(r"\S+")
_CLOSERS = "\"')]”’»"
RUNS = pa.schema([("h", pa.int64()), ("c", pa.int32()), ("doc_id", pa.int64()), ("t", pa.int32()), ("first", pa.int32()), ("n", pa.int32()), ("again", pa.bool_())])


class _WordHashes(dict):
    """63 bits of a hash of the word, above one bit that says if it ends a sentence."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 17:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) & ~1 | word.rstrip(_CLOSERS).endswith((".", "!", "?"))
        return h


_WORDS = _WordHashes()
_BASES = [(b, pow(b, -1, 1 << 64)) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in lower case, and whether each ends a sentence or a line."""
    words: list[str] = []
    lines: list[int] = []
    for line in text.lower().split("\n"):
        words += line.split()
        lines.append(len(words) - 1)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    ends = (h & np.uint64(1)).astype(bool)
    ends[[i for i in lines if i >= 0]] = True
    return h, ends


def unit_ends(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of words before the end of each unit; the last one is the number of all words."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    most = np.full(REACH, np.iinfo(np.uint64).max, np.uint64)
    value = hashes | np.uint64(1)
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate((most, value, most)), REACH).min(axis=1)
    stops = np.flatnonzero(ends) + 1
    if not len(stops) or stops[-1] != n:
        stops = np.append(stops, n)
    lengths = np.diff(stops, prepend=0)
    cut = np.flatnonzero((value < around[:n]) & (value <= around[REACH + 1 :]) & np.repeat(lengths > LONG_SENTENCE, lengths)) + 1
    out = np.union1d(stops, cut)
    sizes = np.diff(out, prepend=0)
    if sizes.max() > MAX_UNIT:
        inner = [np.arange(e - s + CUT_UNIT, e, CUT_UNIT) for e, s in zip(out.tolist(), sizes.tolist()) if s > MAX_UNIT]
        out = np.unique(np.concatenate([out, *inner]))
    return out


def runs_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run its hash (columns h and c of 64 and 32 bits), its first unit and its number of units. The runs:
    from each unit the shortest one of UNITS units and MIN_WORDS words or more; a text of a single unit is a run
    if it has MIN_WORDS words."""
    words, marks = word_hashes(text)
    ends = unit_ends(words, marks)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    last = np.maximum(np.searchsorted(ends, starts + MIN_WORDS), np.arange(len(ends)) + UNITS - 1)
    if len(ends) == 1 and ends[0] >= MIN_WORDS:
        last[0] = 0
    first = np.flatnonzero(last < len(ends))
    last = last[first]
    a, b = starts[first], ends[last]
    out = []
    for base, inverse in _BASES:  # the run's words as digits of a number modulo 2^64
        up, down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(len(words) - 1, 0), x, np.uint64)))) for x in (base, inverse))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])))
        h = (total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xFF51AFD7ED558CCD)
        out.append(h ^ h >> np.uint64(29))
    return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32), first, last - first + 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 2 << 20):
        rows: list[tuple[np.ndarray, ...]] = []
        for text in part.column(1).to_pylist():
            h, c, first, n = runs_of(text)
            again = np.ones(len(h), bool)
            again[np.unique(h, return_index=True)[1]] = False
            rows.append((h, c, first, n, again))
        sizes = [len(r[0]) for r in rows]
        h, c, first, n, again = (np.concatenate(x) for x in zip(*rows))
        yield batch_of(RUNS, h, c, np.repeat(part.column(0).to_numpy(), sizes), np.repeat(part.column(2).to_numpy(), sizes), first.astype(np.int32), n.astype(np.int32), again)


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.withColumn("t", F.hash("text"))


def _repeated(runs: DataFrame) -> DataFrame:
    """(h, c, least) of the runs in several documents."""
    seen = runs.groupBy("h", "c").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    return seen.filter("least < most").select("h", "c", "least")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, spans): for each text with runs that appeared before, their first unit and number of units.

    t is a hash of the text, so that rows of one id with different texts stay apart. The first appearance is
    the first one in the text of the smallest doc_id (in each, if that id has several texts). A run that comes again
    within its own text needs no join. A hash that many texts have, as of a passage in a third of all rows, would be
    one task of that join: hashes with more than 1 in HOT_SHARE of a sample of the runs, so at most HOT_SHARE of them,
    are counted with map-side combination and joined by broadcast. The sample only says which way a hash goes.
    """
    texts = _own(docs, id_col, text_col).filter("doc_id is not null and text is not null")
    runs = materialize(texts.mapInArrow(_runs, "h long, c int, doc_id long, t int, first int, n int, again boolean"), "runs")
    sample = runs.filter("not again").sample(0.02, 7).groupBy("h", "c").agg(F.count(F.lit(1)).alias("k"))
    sample = materialize(sample, "sample", narrow=True)
    many = (sample.agg(F.sum("k")).first()[0] or 0) // HOT_SHARE + 20
    hot = F.broadcast(sample.filter(F.col("k") > many).select("h", "c"))
    fresh = runs.filter("not again").drop("again")
    common = fresh.join(hot, ["h", "c"], "left_semi")
    rare = fresh.join(hot, ["h", "c"], "left_anti")
    later = common.join(F.broadcast(_repeated(common)), ["h", "c"]).unionByName(rare.join(_repeated(rare), ["h", "c"])).filter("doc_id <> least")
    columns = ("doc_id", "t", "first", "n")
    return later.select(*columns).union(runs.filter("again").select(*columns)).groupBy("doc_id", "t").agg(F.collect_set(F.struct("first", "n")).alias("spans"))


_HELPERS = ("_text", "spans")


def without_spans(text: str, spans: list[dict]) -> tuple[str, list[int]]:
    """The text without the units of the spans, and the places of these units. What is left before the first
    word belongs to the first unit, other white space to the unit before it."""
    ends = unit_ends(*word_hashes(text))
    if not len(ends):
        return text, []
    gone = np.zeros(len(ends) + 1, np.int64)
    for s in spans:
        gone[s["first"]] += 1
        gone[s["first"] + s["n"]] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    at = [m.start() for m in _WORD.finditer(text)]
    places = [0, *(at[e] for e in ends[:-1].tolist()), len(text)]
    return "".join(text[places[k] : places[k + 1]] for k in np.flatnonzero(~gone).tolist()), np.flatnonzero(gone).tolist()


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 2 << 20):
        kept, removed = [], []
        for text, spans in zip(part.column("_text").to_pylist(), part.column("spans").to_pylist()):
            text, gone = without_spans(text, spans) if spans else (text, [])
            kept.append(text)
            removed.append(gone)
        columns = [part.column(i) for i, name in enumerate(part.schema.names) if name not in _HELPERS]
        fields = [f for f in part.schema if f.name not in _HELPERS]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(kept, pa.string()), pa.array(removed, pa.list_(pa.int32()))], schema=pa.schema([*fields, ("_kept", pa.string()), ("_removed", pa.list_(pa.int32()))])
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "removed_sentences") -> DataFrame:
    """docs, its text without repeated spans, and removed_col (array<int>, places of the units that went).

    Words are compared in lower case, whatever the white space between them. Nulls: a null text stays null; a row
    without an id stays as it is and counts nowhere. Rows of one id are one document: a passage that first appears
    there stays in each of them. A text all of whose units appeared before becomes empty; its row stays. Texts of
    fewer than MIN_WORDS words have no run and stay. Very long texts are read whole; of a repeat some words at its
    ends may stay, where its units are not those of the other text. Other columns are carried along whatever their
    names, but for removed_col. Empty table: empty result.
    """
    names = docs.columns
    inner = docs.select([F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)] + [F.col(f"`{text_col}`").cast("string").alias("_text"), F.col(f"`{id_col}`").cast("long").alias("_id")])
    inner = inner.drop(f"_{names.index(text_col)}")
    spans = repeated_spans(docs, id_col, text_col).withColumnsRenamed({"doc_id": "_sid", "t": "_st"})
    joined = inner.filter("_id is not null").join(spans, (F.col("_id") == F.col("_sid")) & (F.hash("_text") == F.col("_st")), "left").drop("_id", "_sid", "_st")
    alone = inner.filter("_id is null").drop("_id").withColumn("spans", F.lit(None).cast(joined.schema["spans"].dataType))
    joined = joined.unionByName(alone)
    kinds = [f"{c} {k}" for c, k in joined.dtypes if c not in _HELPERS]
    out = joined.mapInArrow(_cleaned, ", ".join([*kinds, "_kept string", "_removed array<int>"]))
    return out.select([F.col("_kept" if c == text_col else f"_{i}").alias(c) for i, c in enumerate(names)] + [F.col("_removed").alias(removed_col)])


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, text without the repeats, and the places of the units removed."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", F.size("removed_sentences").alias("n_removed"), "removed_sentences")

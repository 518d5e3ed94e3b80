"""Document fingerprints by one-permutation MinHash: each shingle is hashed once, into one bin; empty bins are filled by
optimal densification; of each bin only a few low-order bits are stored, and likeness is corrected for their chance matches.

A bin's value is the least hash of the shingles that fall into it. An empty bin tries the bins that a fixed random
sequence of its own names, until one isn't empty, and takes its value: the same for all documents, so that two documents
agree in it as their sets are alike. The bits stored are those of the value mixed with the bin's number; bins that
borrow from one another thus still match by chance independently, also in texts of one shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialize, slices, table

BINS, BITS = 512, 4
SHINGLE = 5
SEED = 42
REMEMBERED, REMEMBERED_BYTES = 500_000, 32 << 20
_NONE = np.uint64(2**64 - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class OnePermutation:
    """fingerprint(): bins << bits hex digits' worth of low-order bits; likeness() of two of them."""

    def __init__(self, bins: int = BINS, bits: int = BITS, width: int = SHINGLE):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8) or bins * bits % 8:
            raise ValueError("bins are a power of two, bits 1, 2, 4 or 8")
        self.bins, self.bits, self.width = bins, bits, width
        self.shift = np.uint64(64 - (bins.bit_length() - 1)) if bins > 1 else None
        self.number = mixed(np.arange(1, bins + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        powers = [1]
        for _ in range(width - 1):
            powers.append(powers[-1] * 0xD6E8FEB86659FD93 % 2**64)
        self.powers = [np.uint64(p) for p in reversed(powers)]
        self.words: dict[bytes, int] = {}
        self.held = 0  # bytes of these words
        self.tries = np.zeros((0, bins), np.int64)

    def _word_hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.words, self.held = {}, 0
        new = [w for w in set(words) if w not in self.words]
        self.words.update((w, xxhash.xxh64_intdigest(w, SEED)) for w in new)
        self.held += sum(map(len, new))
        return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))

    def shingles(self, text: str) -> np.ndarray:
        """A 64-bit hash of each run of `width` words (A-Z lower-cased); fewer words are one run, no words one of none."""
        words = text.encode("utf-8", "replace").lower().split()
        if len(words) < self.width:
            return mixed(np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED + 1)], np.uint64))
        own = self._word_hashes(words)
        n = len(words) - self.width + 1
        total = np.zeros(n, np.uint64)
        for i, p in enumerate(self.powers):
            total += own[i : i + n] * p
        return mixed(total)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        """The least hash of each bin, _NONE where none falls. A hash's high bits name its bin."""
        ordered = np.sort(hashes)
        at = (ordered >> self.shift).astype(np.int64) if self.shift is not None else np.zeros(len(ordered), np.int64)
        first = np.concatenate(([True], at[1:] != at[:-1]))
        out = np.full(self.bins, _NONE)
        out[at[first]] = ordered[first]
        return out

    def tried(self, upto: int) -> np.ndarray:
        """(attempt, bin): the bins that each empty bin tries, one after the other; at least `upto` of them."""
        while len(self.tries) < upto:
            more = np.arange(len(self.tries) + 1, 2 * len(self.tries) + 65, dtype=np.uint64)
            self.tries = np.concatenate((self.tries, (mixed(self.number[None, :] + more[:, None]) % np.uint64(self.bins)).astype(np.int64)))
        return self.tries

    def sources(self, filled: np.ndarray) -> np.ndarray:
        """For each bin the bin that its value comes from: itself, or the first filled one of its own sequence."""
        out = np.arange(self.bins)
        open_ = np.flatnonzero(~filled)
        at, step = 0, 4
        while len(open_):
            tried = self.tried(at + step)[at : at + step, open_]
            hit = filled[tried]
            first, any_ = hit.argmax(axis=0), hit.any(axis=0)
            out[open_[any_]] = tried[first, np.arange(len(open_))][any_]
            open_ = open_[~any_]
            at, step = at + step, min(2 * step, 256)
        return out

    def fingerprint(self, text: str) -> bytes:
        least = self.minima(self.shingles(text))
        least = least[self.sources(least != _NONE)]
        low = (mixed(least ^ self.number) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        each = 8 // self.bits
        packed = np.zeros(self.bins // each, np.uint8)
        for i in range(each):
            packed |= low[i::each] << (self.bits * (each - 1 - i))
        return packed.tobytes()

    def likeness(self, a: bytes, b: bytes) -> float:
        """The share of equal bins without those that are equal by chance, from 0 to 1."""
        differ = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
        equal = sum(int(np.count_nonzero((differ >> (self.bits * i)) & ((1 << self.bits) - 1) == 0)) for i in range(8 // self.bits))
        chance = 2.0**-self.bits
        return max(0.0, (equal / self.bins - chance) / (1 - chance))


_makers: dict[tuple[int, int, int], OnePermutation] = {}
ROWS = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
     ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("last", pa.bool_()), ("text", pa.string())]
)
KINDS = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (hex digits) of every row; narrow. Nulls are empty texts; those without a word are all alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _makers.setdefault((bins, bits, width), OnePermutation(bins, bits, width))
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([make.fingerprint(t or "").hex() for t in part.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) gives way to as many of the following text's first ones, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(make: OnePermutation, own: tuple, text: str, following: str, fp: bytes, fp_following: bytes) -> tuple:
    new = edited(text, following)
    fp_new = fp if new == text else make.fingerprint(new)
    sha = hashlib.sha256(new.encode("utf-8", "replace")).digest()
    return (*own, len(text), sha, fp, fp_new, make.likeness(fp, fp_new), make.likeness(fp, fp_following))


def with_following(docs: DataFrame, bins: int = BINS, bits: int = BITS, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Each document beside the next one by id (the first behind the last): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Documents are sorted in ranges of ids, and a task reads its range once, holding two texts. Of each range the first
    and the last document are kept with their texts: the last ones meet the first ones of the next range that has any in
    a join over the ranges. Only the numbers of the ranges reach the driver.

    Nulls: a null text is empty; null ids come first. Rows of one id are documents of their own, ordered by a hash of
    their text; equal rows are in any order, which shows nowhere. A single row is followed by itself. Texts without a
    word are like each other and nothing else. Very long texts are hashed whole. Other columns are not read. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession

    def maker() -> OnePermutation:
        return _makers.setdefault((bins, bits, width), OnePermutation(bins, bits, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, before, at = maker(), None, 0
        for batch in slices(batches):
            rows = []
            for part, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = text or ""
                fp = make.fingerprint(text)
                if before is None:
                    at = part
                    rows.append((doc_id, *[None] * 6, part, False, text))
                else:
                    rows.append((*_row(make, before[:1], before[1], text, before[2], fp), None, None, None))
                before = (doc_id, text, fp)
            yield batch_of(ROWS, *zip(*rows))
        if before is not None:
            yield batch_of(ROWS, *([x] for x in (before[0], *[None] * 6, at, True, before[1])))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = maker()
        for batch in slices(batches):
            rows = []
            for doc_id, text, following in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows.append(_row(make, (doc_id,), text, following, make.fingerprint(text), make.fingerprint(following)))
            yield batch_of(pa.schema(list(ROWS)[:7]), *zip(*rows))

    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = read.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    made = materialize(ranged.mapInArrow(run, KINDS + ", part int, last boolean, text string"), "in-order")
    inner = made.filter("part is null").select(*[f.name for f in list(ROWS)[:7]])
    ends = made.filter("part is not null")
    held = sorted(r["part"] for r in ends.filter("not last").select("part").collect())
    order = spark.createDataFrame(list(zip(held, [*held[1:], *held[:1]])), "part int, next int")
    firsts = ends.filter("not last").select(F.col("part").alias("next"), F.col("text").alias("following"))
    lasts = ends.filter("last").select("part", "doc_id", "text").join(F.broadcast(order), "part").join(firsts, "next")
    out = inner.union(lasts.select("doc_id", "text", "following").mapInArrow(close, KINDS))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def op13_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return with_following(table(spark, sf_dir, "documents"))

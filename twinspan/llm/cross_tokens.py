"""Cross-tokenizer alignment by a cogroup of postings.

Two vocabularies cut the same bytes. A document's tokens A and B that overlap are linked, and a link's count is how many
documents of the corpus hold the same pair of ids linked. Nothing here needs all links of a document or of a pair in one place:

1. Each task aligns its documents and writes, beside a row a document, postings by A id: for one A id and one slice of
   documents the B ids it is linked to, the documents and how often (lists in one row).
2. Postings are shuffled by A id and sorted by it (Spark's sort spills). A task counts the documents of each pair of an id
   and their maximum, and emits to each document its links' share of n_best and count_sum, again as lists by slice.
3. The shares are shuffled by slice and summed by document.

An id with more than SPLIT postings (every frequent one in a large corpus) is dealt to several tasks by the hash of its
slices. Its counts are summed before, by pair and with a partial sum in each task, and each of its parts meets them in
front of its postings: one row of at most the B vocabulary's size. Which way an id goes changes nothing in the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_pair_ids, gathered
from .common import batch_of, materialize, slices, table

SPACE = "▁"
SPLIT = 1 << 18  # postings of an A id in one task
AT_ONCE = 1 << 20  # postings counted together
LISTS = "b array<int>, row array<int>, m array<int>"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = pa.schema(
    [("key", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("groups_sha256", pa.string()), ("a", pa.int32()), *((c, pa.list_(pa.int32())) for c in ("b", "row", "m"))]
)
SHARES = pa.schema([("key", pa.int64()), ("row", pa.list_(pa.int32())), ("n_best", pa.list_(pa.int64())), ("count_sum", pa.list_(pa.int64()))])
TOTALS = pa.schema([("key", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])


def piece_bytes(lib: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each id of a SentencePiece vocabulary; control and unknown ids have none."""
    out = []
    for i in range(lib.get_piece_size()):
        piece = lib.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) or lib.is_unknown(i) else piece.replace(SPACE, " ").encode())
    return out


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a = byte_pair_ids(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        bytes_a, bytes_b = self.a.token_bytes(), piece_bytes(self.b)
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (bytes_a, bytes_b))
        self.flat_a, self.flat_b = (np.frombuffer(b"".join(x), np.uint8) for x in (bytes_a, bytes_b))
        na, nb = self.n_a, self.n_b = len(bytes_a), len(bytes_b)
        self.texts = np.array([f"{i}{mark}" for n, marks in ((na, ",|"), (nb, ",;")) for mark in marks for i in range(n)], object)
        self.first_b = 2 * na

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids in A of space+text and in B of text, each flat and with the numbers of the texts; none of both where a text is empty
        or the bytes of either aren't space+text."""
        n = len(texts)
        ids = self.b.encode(texts, num_threads=1)
        count = np.fromiter(map(len, ids), np.int64, n)
        sides = [self.a.flat([" " + t if t else "" for t in texts]), (np.fromiter(chain.from_iterable(ids), np.int64, int(count.sum())), count)]
        raw = [b" " + t.encode("utf-8", "replace") if t else b"" for t in texts]
        good = np.ones(n, bool)
        for (ids, count), flat, length in zip(sides, (self.flat_a, self.flat_b), (self.length_a, self.length_b)):
            made = gathered(flat, (np.cumsum(length) - length)[ids], length[ids]).tobytes()
            if made != b"".join(raw):
                at = np.concatenate(([0], np.cumsum(length[ids])))[np.concatenate(([0], np.cumsum(count)))].tolist()
                good &= np.array([made[i:j] == r for i, j, r in zip(at, at[1:], raw)])
        return sides if good.all() else [(ids[np.repeat(good, count)], count * good) for ids, count in sides]

    def align(self, texts: list[str]) -> tuple[dict[str, np.ndarray], list[str], tuple[np.ndarray, ...]]:
        """Counts of each text, the hashes of their groups, and (a, b, text, times) of each linked pair of ids, in that order.

        The texts are laid out behind one another. A link is a stretch between two neighbouring ends of either side:
        it lies in one token of each, and tokens that overlap share exactly one such stretch."""
        (a, count_a), (b, count_b) = self.encode(texts)
        n = len(texts)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        is_a, is_b = np.zeros((2, (int(end_a[-1]) if len(a) else 0) + 1), bool)
        is_a[end_a] = is_b[end_b] = True
        ends = np.flatnonzero(is_a | is_b)
        of_a, of_b = (np.cumsum(is_[ends]) - is_[ends] for is_ in (is_a, is_b))
        text_of_a = np.repeat(np.arange(n), count_a)
        text = text_of_a[of_a]
        common_a, common_b = is_b[end_a], is_a[end_b]
        counts = {"n_a": count_a, "n_b": count_b, "n_groups": np.bincount(text_of_a[common_a], minlength=n), "n_links": np.bincount(text, minlength=n)}
        # groups as text: a group's A tokens come before its B tokens, and behind all tokens of the groups before
        group_a, group_b = np.cumsum(common_a) - common_a, np.cumsum(common_b) - common_b
        until_a, until_b = (np.concatenate(([0], np.flatnonzero(c) + 1)) for c in (common_a, common_b))
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + until_b[group_a]] = a + self.n_a * common_a
        codes[np.arange(len(b)) + until_a[group_b + 1]] = self.first_b + b + self.n_b * common_b
        marked, bounds = self.texts[codes].tolist(), np.cumsum(np.concatenate(([0], count_a + count_b))).tolist()
        hashes = [hashlib.sha256("".join(marked[i:j])[:-1].encode()).hexdigest() if j > i else "" for i, j in zip(bounds, bounds[1:])]
        bits_b, bits_t = self.n_b.bit_length(), n.bit_length()
        pairs, times = np.unique((a[of_a] << bits_b | b[of_b]) << bits_t | text, return_counts=True)
        return counts, hashes, (pairs >> bits_b + bits_t, pairs >> bits_t & (1 << bits_b) - 1, pairs & (1 << bits_t) - 1, times)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two kinds of rows. A document: key (of the row), doc_id, counts, groups_sha256. Postings (a is not null): an A id,
    lists of its B ids, documents (as distances of their keys from `key`) and multiplicities. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _aligners:
            _aligners[a_path, b_path] = Aligner(a_path, b_path)
        for part in slices(batches, 1 << 20):
            keys = part.column(0).to_numpy()
            counts, hashes, (a, b, text, times) = _aligners[a_path, b_path].align([t or "" for t in part.column(2).to_pylist()])
            none = pa.nulls(len(keys))
            yield batch_of(ALIGNED, keys, part.column(1), *counts.values(), hashes, *(none.cast(f.type) for f in list(ALIGNED)[-4:]))
            if len(a):
                starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
                ends = pa.array(np.append(starts, len(a)), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (b, keys[text] - keys[0], times))
                none = pa.nulls(len(starts))
                yield batch_of(ALIGNED, np.full(len(starts), keys[0]), *(none.cast(f.type) for f in list(ALIGNED)[1:7]), a[starts], *lists)

    read = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, f"key long, doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, a int, {LISTS}")


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _added(first: np.ndarray, row: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry for each document, in order: (first, row, sums)."""
    order = np.argsort(first + row, kind="stable")
    first, row = first[order], row[order]
    starts = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (row[1:] != row[:-1]))))
    return first[starts], row[starts], *(np.add.reduceat(x[order], starts) for x in values)


def _summed(first: np.ndarray, row: np.ndarray, best: np.ndarray, count: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """A row for each slice of documents: lists of its documents and their sums."""
    first, row, best, count = _added(first, row, times * best, times * count)
    starts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
    ends = pa.array(np.append(starts, len(first)), pa.int32())
    return batch_of(SHARES, first[starts], *(pa.ListArray.from_arrays(ends, pa.array(x, f.type.value_type)) for x, f in zip((row, best, count), list(SHARES)[1:])))


def _counted_here(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Shares from whole groups (a, b, first key, row, times), sorted by a."""
    a, b, first, row, times = (np.concatenate(c) for c in zip(*parts))
    _, at, count = np.unique(a << 32 | b, return_inverse=True, return_counts=True)
    count = count[at]
    starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    most = np.repeat(np.maximum.reduceat(count, starts), np.diff(np.append(starts, len(a))))
    return _summed(first, row, count == most, count, times)


def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (a, part, counts?, key, b, row, m) sorted by the first three: each document's share of n_best and count_sum.
    A split id's counts come in front of its postings; other ids are counted once their group has ended."""
    held: list[tuple[np.ndarray, ...]] = []
    n, of, count, most = 0, None, None, 0
    for batch in slices(batches):
        ids, split, is_counts = batch.column(0).to_numpy(), batch.column(1).to_numpy() >= 0, batch.column(2).to_numpy() == 0
        b, row, m = (batch.column(i) for i in (4, 5, 6))
        sizes = b.value_lengths().to_numpy()
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        b, row, m = _flat(b), _flat(row), _flat(m)
        first = np.repeat(batch.column(3).to_numpy(), sizes)
        a = np.repeat(ids, sizes).astype(np.int64)
        cuts = np.flatnonzero((split[1:] != split[:-1]) | split[1:] & ((ids[1:] != ids[:-1]) | is_counts[1:] | is_counts[:-1])) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
            own = slice(bounds[i], bounds[j])
            if is_counts[i]:
                of, count = int(ids[i]), np.zeros(int(b[own].max()) + 1, np.int64)
                count[b[own]] = row[own] << 30 | m[own]  # a count may be beyond 32 bits
                most = int(count.max())
            elif split[i]:
                assert of == ids[i]
                yield _summed(first[own], row[own], count[b[own]] == most, count[b[own]], m[own])
            else:
                held.append((a[own], b[own], first[own], row[own], m[own]))
                n += bounds[j] - bounds[i]
        if n > AT_ONCE:
            whole = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last group may go on
            if cut:
                yield _counted_here([tuple(c[:cut] for c in whole)])
            held = [tuple(c[cut:] for c in whole)]
            n -= cut
    if n:
        yield _counted_here(held)


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's sums, from the rows of shares() sorted by key."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def out(first: np.ndarray, row: np.ndarray, best: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        return batch_of(TOTALS, first + row, best, count)

    for batch in slices(batches):
        lists = [batch.column(i) for i in (1, 2, 3)]
        held.append((np.repeat(batch.column(0).to_numpy(), lists[0].value_lengths().to_numpy()), *map(_flat, lists)))
        n += len(held[-1][0])
        if n > AT_ONCE:
            whole = _added(*(np.concatenate(c) for c in zip(*held)))
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last slice may go on
            if cut:
                yield out(*(c[:cut] for c in whole))
            held = [tuple(c[cut:] for c in whole)]
            n = len(held[0][0])
    if n:
        yield out(*_added(*(np.concatenate(c) for c in zip(*held))))


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts whose tokens don't give their bytes back (one with U+2581, say), have no tokens:
    zeros and an empty string. Each row is a document of its own, repeated rows and null ids too. Very long texts are
    aligned whole. Ties of an id's highest count are all best. Other columns are not read. Empty table: empty result.
    """
    made = materialize(aligned(docs, a_path, b_path, id_col, text_col), "aligned")
    rows = made.filter("a is null").select("key", "doc_id", *COUNTS, "groups_sha256")
    postings = made.filter("a is not null").select("a", "key", "b", "row", "m")
    # at most one row an id of A that is split: bounded by its vocabulary
    parts = postings.groupBy("a").agg(F.sum(F.size("b")).alias("n")).filter(F.col("n") > split).select("a", F.ceil(F.col("n") / split).cast("int").alias("parts"))
    parts = materialize(parts.coalesce(1), "split-ids")
    pairs = postings.join(F.broadcast(parts), "a").select("a", "parts", F.explode("b").alias("b")).groupBy("a", "parts", "b").count()
    counts = pairs.groupBy("a", "parts").agg(F.collect_list(F.struct("b", F.expr("cast(count div 1073741824 as int)").alias("row"), F.expr("cast(count % 1073741824 as int)").alias("m"))).alias("l"))
    counts = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("is_posting"), F.lit(0).cast("long").alias("key"), F.col("l.b").alias("b"), F.col("l.row").alias("row"), F.col("l.m").alias("m"))
    dealt = postings.join(F.broadcast(parts), "a", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"), F.lit(-1)))
    dealt = dealt.select("a", "part", F.lit(1).alias("is_posting"), "key", "b", "row", "m").union(counts)
    order = ("a", "part", "is_posting")
    given = dealt.repartition("a", "part").sortWithinPartitions(*order).mapInArrow(shares, "key long, row array<int>, n_best array<long>, count_sum array<long>")
    total = given.repartition("key").sortWithinPartitions("key").mapInArrow(totals, "key long, n_best long, count_sum long")
    sums = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum"))
    return rows.join(total, "key", "left").select("doc_id", *COUNTS, *sums, "groups_sha256")


def op12_cross_tokenizer(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))

"""Best-fit packing planned over the length histogram.

The plan never sees documents: best-fit decreasing runs over (length, count) pairs, at most `capacity` of
them, and yields runs "ranks r..r+n of length l go to sequences s..s+n at offset o". Pieces then take
their slots by their rank within their length.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import batch_of, materialize, slices, table

CAPACITY = 2048
END_ID = 0
BUCKET_ROWS = 4096
CHECK_EVERY = 16
# Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


class TokenIds:
    """ids of a byte-level BPE file exactly as the tokenizers library gives them without added tokens of its own
    (add_special_tokens=False). The strings of the file's added tokens have their ids where a text holds them.

    Where the file's merge order is its id order, the same vocabulary runs in tiktoken, about four times as fast.
    Both then do the same: cut the text by one pattern, and within a pre-token merge the adjacent pair of the
    earliest merge, leftmost first, until none is left; the earliest merge of a pair of symbols is the one whose
    result has the least id, which is what tiktoken looks for. Texts with an added token's string go to tokenizers, and
    so does one text in 16 to compare; a batch with a difference is redone there.
    """

    def __init__(self, path: str):
        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or r"(?!)")
        self.fast = self._fast(spec)

    @staticmethod
    def _fast(spec: dict) -> tiktoken.Encoding | None:
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        added = {t["content"] for t in spec.get("added_tokens", [])}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = [model["vocab"]["".join(m)] for m in merges]
        if ids != sorted(ids) or len(merges) + 256 != len(model["vocab"].keys() - added):
            return None
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _exactly(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.exact.encode(t, add_special_tokens=False).ids, "<u4") for t in texts]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast:
            search, fast = self.added.search, self.fast.encode_ordinary
            out = [self._exactly([t])[0] if search(t) else np.array(fast(t), "<u4") for t in texts]
            some = range(0, len(texts), CHECK_EVERY)
            if all(np.array_equal(out[i], e) for i, e in zip(some, self._exactly([texts[i] for i in some]))):
                return out
        return self._exactly(texts)


_loaded: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    if path not in _loaded:
        _loaded[path] = TokenIds(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Narrow.

    A document is its ids and end_id; only a longer one is cut, so that all pieces but the first are full.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(tokenizer_path)
        for part in slices(batches, 2 << 20):
            rows: list[tuple] = []
            for doc_id, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                ends = np.arange(len(ids) - (len(ids) - 1) // capacity * capacity, len(ids) + 1, capacity)
                for k, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            yield batch_of(PIECES, *zip(*rows))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def plan(histogram: Iterable[tuple[int, int]], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int]]]:
    """Best-fit decreasing over counts: {length: [(first rank, first sequence, offset)]}, ranks ascending.

    Sequences of equal room are kept as ranges; one step fills a whole range alike, so the work and the
    size of the plan depend on the capacity and not on the number of documents.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left: ranges (first sequence, how many)
    rooms: list[int] = []
    opened = 0
    out: dict[int, list[tuple[int, int, int]]] = {}

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((first, n))

    for length, count in sorted(histogram, reverse=True):
        rank, runs = 0, out.setdefault(length, [])
        while rank < count:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
            else:
                left, first, n = capacity, opened, -(-(count - rank) // (capacity // length))
                opened += n
            each = left // length
            full = min(n, (count - rank) // each)
            if full:
                for k in range(each):
                    runs.append((rank, first, capacity - left + k * length))
                    rank += full
                put(left - each * length, first, full)
                put(left, first + full, n - full)
            else:
                few = count - rank
                for k in range(few):
                    runs.append((rank, first, capacity - left + k * length))
                    rank += 1
                put(left - few * length, first, 1)
                put(left, first + 1, n - 1)
    return out


def with_ranks(cut: DataFrame, histogram: list[tuple[int, int]]) -> DataFrame:
    """Adds rank, from 0 within each length, without bringing a length into one task: rows are numbered in
    (length, bucket) groups of some thousand, and the buckets' counts are summed up before them. histogram: (length, count), which
    says how many buckets a length gets; a row for each length, and as many as the capacity at most."""
    spark = cut.sparkSession
    sizes = spark.createDataFrame([(length, -(-n // BUCKET_ROWS)) for length, n in histogram], "length long, buckets long")
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets"))
    rows = cut.join(F.broadcast(sizes), "length").withColumn("bucket", bucket).drop("buckets")
    counts = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return rows.withColumn("at", F.row_number().over(local)).join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("at") - 1)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places every piece (columns of pieces()) at a sequence_id and offset; each sequence is filled from 0
    without gaps. The histogram that reaches the driver has at most `capacity` rows."""
    cut = materialize(cut, "pieces", narrow=True)
    histogram = [(r["length"], r["count"]) for r in cut.groupBy("length").count().collect()]
    runs = {length: tuple(np.array(c, np.int64) for c in zip(*r)) for length, r in plan(histogram, capacity).items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                ranks, firsts, offsets = runs[int(length[own[0]])]
                k = np.searchsorted(ranks, rank[own], side="right") - 1
                sequence[own], offset[own] = firsts[k] + rank[own] - ranks[k], offsets[k]
            yield batch_of(PLACED, *(batch.column(i) for i in range(5)), sequence, offset)

    return with_ranks(cut, histogram).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Nulls: a null or empty text is the end id alone (one piece of length 1); a null id is carried along.
    Repeated rows each get places of their own; pieces of one length are in order of a hash's bucket, doc_id, piece and crc, and which
    of wholly equal pieces comes first shows nowhere. Very long texts become many full pieces. Other columns are not read. Empty
    table: empty result.
    """
    import public_tokenizers

    return pack(pieces(docs, tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), capacity), capacity)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))

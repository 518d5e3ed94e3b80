"""Hits of reads against sequences without an external aligner: minimizers meet in a join, seeds on one diagonal make a
candidate, and each candidate is aligned. What the command that builds the table starts from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import align, parse, text

K, WINDOW = 15, 10  # letters of a seed; of so many neighbouring seeds the least hash is taken
CHUNK = 1 << 16
DIAGONAL = 64  # seeds whose diagonals differ by less than this (twice that at most) go together
_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)
SEEDS = pa.schema([("seq_id", pa.int64()), ("hash", pa.int64()), ("pos", pa.int64()), ("forward", pa.bool_())])


def minimizers(seq: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, strand of the lesser word) of the seeds whose hash is the least in a window; words with another
    letter than ACGT have none. A word and its reverse complement have one hash; words equal to their own have none."""
    code = _CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    n = len(code) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    forward, backward = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for i in range(k):
        own = code[i : i + n].astype(np.uint64)
        forward = forward << np.uint64(2) | own & np.uint64(3)
        backward |= (own & np.uint64(3) ^ np.uint64(3)) << np.uint64(2 * i)
    bad = np.lib.stride_tricks.sliding_window_view(code > 3, k).any(axis=1) | (forward == backward)
    h = np.minimum(forward, backward) * np.uint64(0x9E3779B97F4A7C15)
    h = np.where(bad, np.uint64(0xFFFFFFFFFFFFFFFF), (h ^ h >> np.uint64(32)) >> np.uint64(1))
    if n > window:
        views = np.lib.stride_tricks.sliding_window_view(h, window)
        at = np.unique(views.argmin(axis=1) + np.arange(n - window + 1))
    else:
        at = np.array([h.argmin()])
    at = at[~bad[at]]
    return h[at].view(np.int64), at, (forward < backward)[at]


def seeds(sequences: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(seq_id, hash, pos, forward) of sequences (seq_id, seq). Long ones are cut into chunks that share a window's letters."""
    overlap = k + window - 2
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(CHUNK))
    chunks = sequences.filter("length(seq) > 0").select(F.col("seq_id").cast("bigint").alias("seq_id"), "seq", F.explode(starts).alias("start"))
    chunks = chunks.select("seq_id", F.col("start").cast("bigint").alias("start"), F.expr(f"substring(seq, start + 1, {CHUNK + overlap})").alias("seq"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, start, seq in zip(*(c.to_pylist() for c in batch.columns)):
                h, pos, forward = minimizers(seq, k, window)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i, np.int64)), pa.array(h), pa.array(pos + start), pa.array(forward)], schema=SEEDS)

    return chunks.mapInArrow(find, "seq_id bigint, hash bigint, pos bigint, forward boolean").distinct()


def candidates(reads: DataFrame, sequences: DataFrame, least_seeds: int = 3, most_places: int | None = None, k: int = K, window: int = WINDOW) -> DataFrame:
    """reads, sequences: seq_id, seq. (read_id, seq_id, forward, s, e, n): stretches where a read may lie, with their seeds.
    most_places: seeds that stand at more places of the sequences are left out, as aligners do; None keeps all."""
    index = seeds(sequences, k, window)
    if most_places:
        usual = index.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= most_places).select("hash")
        index = index.join(usual, "hash", "left_semi")
    lengths = reads.select(F.col("seq_id").cast("bigint").alias("read_id"), F.length("seq").alias("length"))
    own = seeds(reads, k, window).select(F.col("seq_id").alias("read_id"), "hash", F.col("pos").alias("rpos"), F.col("forward").alias("rforward")).join(lengths, "read_id")
    met = own.join(index, "hash").withColumn("forward", F.col("forward") == F.col("rforward"))
    start = F.when(F.col("forward"), F.col("pos") - F.col("rpos")).otherwise(F.col("pos") + k + F.col("rpos") - F.col("length"))  # where the read would begin
    bins = F.floor(start / DIAGONAL)
    placed = met.select("read_id", "seq_id", "forward", "length", start.alias("start"), F.explode(F.array(bins, bins - 1)).alias("bin"))
    groups = placed.groupBy("read_id", "seq_id", "forward", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("low"), F.max("start").alias("high"), F.max("length").alias("length"))
    spans = groups.filter(F.col("n") >= least_seeds).select("read_id", "seq_id", "forward", F.greatest(F.lit(0), F.col("low") - 20).alias("s"), (F.col("high") + F.col("length") + 20).alias("e"), "n")
    return spans.groupBy("read_id", "seq_id", "forward", F.floor(F.col("s") / (4 * DIAGONAL)).alias("_g")).agg(F.max(F.struct("n", "s", "e")).alias("b")).select("read_id", "seq_id", "forward", "b.s", "b.e", "b.n")


def stretches(spans: DataFrame, sequences: DataFrame, width: int = 1 << 14) -> DataFrame:
    """Adds part, the letters s to e of seq_id. Sequences meet spans in pieces of one width, so none is carried whole."""
    starts = F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / width).cast("int"))
    cut = sequences.filter("length(seq) > 0").select(F.col("seq_id").cast("bigint").alias("seq_id"), "seq", F.explode(starts).alias("piece"))
    cut = cut.select("seq_id", "piece", F.expr(f"substring(seq, piece * {width} + 1, {width})").alias("letters"))
    wanted = spans.withColumn("piece", F.explode(F.sequence(F.floor(F.col("s") / width).cast("int"), F.floor((F.col("e") - 1) / width).cast("int"))))
    joined = wanted.join(cut, ["seq_id", "piece"]).groupBy(*spans.columns).agg(F.array_sort(F.collect_list(F.struct("piece", "letters"))).alias("l"))
    whole = F.array_join(F.transform("l", lambda x: x["letters"]), "")
    return joined.withColumn("_w", whole).select(*spans.columns, F.expr(f"substring(_w, int(s - l[0].piece * {width}) + 1, int(e - s))").alias("part"))


def hits(reads: DataFrame, sequences: DataFrame, least_similarity: float = 0.9, **options) -> DataFrame:
    """read_id, seq_id, s, e, forward, cigar, score, similarity: the alignment of each candidate, whole reads with free ends of
    the sequence; of candidates that end up at one place one."""
    rows = stretches(candidates(reads, sequences, **options), sequences).join(reads.select(F.col("seq_id").cast("bigint").alias("read_id"), F.col("seq").alias("read")), "read_id")
    turned = F.translate(F.reverse("read"), "ACGT", "TGCA")

    @F.pandas_udf("struct<s:bigint,e:bigint,cigar:string,score:bigint,similarity:double>")
    def aligned(start: pd.Series, part: pd.Series, read: pd.Series) -> pd.DataFrame:
        out = []
        for at, a, b in zip(start, part, read):
            cigar, score = align(a, b, free_ends=True)
            ops = parse(cigar)
            if ops and ops[0][1] == "D":
                at, ops = at + ops[0][0], ops[1:]
            if ops and ops[-1][1] == "D":
                ops = ops[:-1]
            size = sum(n for n, op in ops if op in "=XD")
            out.append((at, at + size, text(ops), score, sum(n for n, op in ops if op == "=") / max(sum(n for n, _ in ops), 1)))
        return pd.DataFrame(out, columns=["s", "e", "cigar", "score", "similarity"])

    made = rows.select("read_id", "seq_id", "forward", aligned("s", "part", F.when(F.col("forward"), F.col("read")).otherwise(turned)).alias("a"))
    made = made.select("read_id", "seq_id", "forward", "a.*").filter(F.col("similarity") >= least_similarity)
    return made.dropDuplicates(["read_id", "seq_id", "forward", "s", "e"])

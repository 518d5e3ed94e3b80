"""Sequences and CIGAR strings as columns: an array of (len, op) structs, and segments with coordinates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.lambdas import let

REF_OPS, READ_OPS, BOTH_OPS = ("M", "=", "X", "D", "N"), ("M", "=", "X", "I", "S"), ("M", "=", "X")


# ------------------------------------------------------------------ sequences
def reverse_complement(seq: Column) -> Column:
    """Unknown letters become X, N stays."""
    upper = F.translate(seq, "acgtn", "ACGTN")
    return F.translate(F.reverse(F.regexp_replace(upper, "[^ACGTN]", "X")), "ACGT", "TGCA")


def gc_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "GC", ""))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers of ACGT, in order; others are left out. Cut from the bytes, where a place is found at once: in a
    string it is counted from the start each time. Bytes of other characters are never ACGT."""

    def cut(b: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.octet_length(b) - (k - 1)), lambda i: F.substring(b, i, k).cast("string"))
        return F.filter(every, lambda x: F.translate(x, "ACGT", "") == "")

    return F.when(F.octet_length(seq) >= k, let(seq.cast("binary"), cut)).otherwise(F.array().cast("array<string>"))


def sliding_reads(seq: Column, length: int, step: int, shortest: int) -> Column:
    """Substrings every `step`, as long as `length` or what is left from `shortest` on, of ACGT only."""
    starts = F.sequence(F.lit(0), F.length(seq) - shortest, F.lit(step))
    reads = F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(seq, i + 1, length).alias("seq")))
    return F.when(F.length(seq) >= shortest, F.filter(reads, lambda r: r["seq"].rlike(r"^[ACGT]+\z")))


def homopolymer_behind(seq: Column, pos: Column, n: int = 5) -> Column:
    """Whether n equal letters follow position pos (0-based)."""
    tail = F.substring(seq, pos + 2, n)
    return (F.length(tail) == n) & (F.length(F.replace(tail, F.substring(tail, 1, 1), F.lit(""))) == 0)


def homopolymer_places(seq: Column, n: int = 5) -> Column:
    """All positions (0-based) that n equal letters follow; letters are taken from an array, where each is found at once."""

    def places(letters: Column) -> Column:
        same = lambda i: F.forall(F.sequence(F.lit(2), F.lit(n)), lambda k: F.get(letters, i + k) == F.get(letters, i + 1)) if n > 2 else F.get(letters, i + 2) == F.get(letters, i + 1)
        return F.filter(F.sequence(F.lit(0), F.size(letters) - 1 - n), same)

    return F.when(F.length(seq) > n, let(F.split(seq, ""), places)).otherwise(F.array().cast("array<int>"))


def length_text(v: Column) -> Column:
    """`950 bp`, `12.3 kb`, `4.0 Mb`; digits that aren't shown are cut off."""
    scaled = lambda by, unit: F.concat(F.floor(v / by).cast("string"), F.lit("."), F.floor(v % by / (by // 10)).cast("string"), F.lit(unit))
    return F.when(v < 1000, F.concat(v.cast("string"), F.lit(" bp"))).when(v < 1_000_000, scaled(1000, " kb")).otherwise(scaled(1_000_000, " Mb"))


# ------------------------------------------------------------------ CIGAR
def parse_cigar(cigar: Column) -> Column:
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), 1)
    return F.transform(parts, lambda p: F.struct(F.substring(p, F.lit(1), F.length(p) - 1).cast("int").alias("len"), F.right(p, F.lit(1)).alias("op")))


def format_cigar(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def cigar_length(ops: Column, kinds: tuple[str, ...]) -> Column:
    return F.aggregate(ops, F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["op"].isin(*kinds), x["len"]).otherwise(0))


def reverse_cigar(ops: Column) -> Column:
    return F.reverse(ops)


def revert_cigar(ops: Column) -> Column:
    """Seen from the other sequence: insertions and deletions change places."""
    return F.transform(ops, lambda x: F.struct(x["len"].alias("len"), F.translate(x["op"], "ID", "DI").alias("op")))


def without_clips(ops: Column) -> Column:
    return F.filter(ops, lambda x: ~x["op"].isin("S", "H"))


def extended_cigar(reference: Column, read: Column) -> Column:
    """`=` and `X` runs of two sequences of equal length."""
    same = F.zip_with(F.split(reference, ""), F.split(read, ""), lambda a, b: F.when(a == b, "=").otherwise("X"))
    text = F.array_join(same, "")
    return F.transform(F.regexp_extract_all(text, F.lit("(=+|X+)"), 1), lambda r: F.struct(F.length(r).alias("len"), F.substring(r, 1, 1).alias("op")))


def segments(ops: Column) -> Column:
    """Array of (op, len, ref, read): where each operation starts on both sequences. The array grows by copies, so this
    is for some dozens of operations; lift() and its like need one pass, and segment_rows() suits any number."""
    start = F.struct(F.lit(0).cast("bigint").alias("ref"), F.lit(0).cast("bigint").alias("read"), F.array().cast("array<struct<op:string,len:int,ref:bigint,read:bigint>>").alias("out"))
    step = lambda a, x: F.struct(
        (a["ref"] + F.when(x["op"].isin(*REF_OPS), x["len"]).otherwise(0)).alias("ref"),
        (a["read"] + F.when(x["op"].isin(*READ_OPS), x["len"]).otherwise(0)).alias("read"),
        F.concat(a["out"], F.array(F.struct(x["op"].alias("op"), x["len"].alias("len"), a["ref"].alias("ref"), a["read"].alias("read")))).alias("out"),
    )
    return F.aggregate(ops, start, step, lambda a: a["out"])


def _ref(x: Column) -> Column:
    return F.when(x["op"].isin(*REF_OPS), x["len"]).otherwise(0)


def _read(x: Column) -> Column:
    return F.when(x["op"].isin(*READ_OPS), x["len"]).otherwise(0)


def _along(ops: Column, found: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]]) -> Column:
    """One pass over the operations with the places on both sequences, in which `found` (name: first value) is kept up
    to date by step(state, operation). What it costs grows with the number of operations only."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("ref"), zero.alias("read"), *(v.alias(n) for n, v in found.items()))
    move = lambda a, x: F.struct((a["ref"] + _ref(x)).alias("ref"), (a["read"] + _read(x)).alias("read"), *(v.alias(n) for n, v in step(a, x).items()))
    return F.aggregate(ops, start, move, lambda a: F.struct(*(a[n].alias(n) for n in found)))


def _nothing() -> Column:
    return F.lit(None).cast("bigint")


def lift(ops: Column, s: Column, e: Column) -> Column:
    """Reference interval -> struct (s, e) on the read over the aligned blocks that it touches; nulls where none."""

    def step(a: Column, x: Column) -> dict[str, Column]:
        touched = x["op"].isin(*BOTH_OPS) & (a["ref"] < e) & (a["ref"] + x["len"] > s)
        first = F.when(touched, a["read"] + F.greatest(F.lit(0), s - a["ref"]))
        return {"s": F.coalesce(a["s"], first), "e": F.when(touched, a["read"] + F.least(x["len"].cast("bigint"), e - a["ref"])).otherwise(a["e"])}

    return _along(ops, {"s": _nothing(), "e": _nothing()}, step)


def aligned_region(ops: Column, s: Column, e: Column, longer: Column | int = 0) -> Column:
    """Reference interval -> struct (s, e) on the read, which may be empty: a place inside a deletion is where the
    deletion stands. longer: how much longer the alternative allele is than the reference; where the interval ends with its
    operation, so much of an insertion behind it belongs to it. Needs 0 <= s < e <= the reference's length."""
    longer = F.lit(longer) if isinstance(longer, int) else longer

    def step(a: Column, x: Column) -> dict[str, Column]:
        end, on_ref, on_read = a["ref"] + x["len"], x["op"].isin(*REF_OPS), x["op"].isin(*READ_OPS)
        place = lambda p: a["read"] + F.when(on_read, p - a["ref"]).otherwise(0)
        ends = on_ref & (a["ref"] < e) & (e <= end)
        waits = a["open"] & ~on_ref
        return {
            "s": F.coalesce(a["s"], F.when(on_ref & (a["ref"] <= s) & (s < end), place(s))),
            "e": F.when(waits, a["e"] + F.least(x["len"].cast("bigint"), longer)).otherwise(F.coalesce(a["e"], F.when(ends, place(e)))),
            "open": ends & (e == end) & (longer > 0),
        }

    return let(_along(ops, {"s": _nothing(), "e": _nothing(), "open": F.lit(False)}, step), lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e")))


def _region(ops: Column, s: Column, e: Column, own: str, other: str) -> Column:
    own_ops, other_ops = (REF_OPS, READ_OPS) if own == "ref" else (READ_OPS, REF_OPS)

    def step(a: Column, x: Column) -> dict[str, Column]:
        end = a[own] + x["len"]
        place = lambda p: F.when(x["op"].isin(*own_ops) & (a[own] <= p) & (p < end), a[other] + F.when(x["op"].isin(*other_ops), p - a[own]).otherwise(1))
        behind = a[own] == e  # an interval that ends with an operation ends on both sequences there
        return {"s": F.coalesce(a["s"], place(s)), "e": F.coalesce(a["e"], F.when(behind, a[other]), place(e)), "last": a[other] + F.when(x["op"].isin(*other_ops), x["len"]).otherwise(0)}

    found = _along(ops, {"s": _nothing(), "e": _nothing(), "last": F.lit(0).cast("bigint")}, step)
    return let(found, lambda r: F.struct(r["s"].alias("s"), F.coalesce(r["e"], r["last"]).alias("e")))


def read_region(ops: Column, s: Column, e: Column) -> Column:
    """struct (s, e) on the read of a reference interval; an end inside a deletion is one behind the base before it."""
    return _region(ops, s, e, "ref", "read")


def ref_region(ops: Column, s: Column, e: Column) -> Column:
    """struct (s, e) on the reference of a read interval; an end inside an insertion is one behind the base before it."""
    return _region(ops, s, e, "read", "ref")


def lift_strand(lifted: Column, read_length: Column, forward: Column) -> Column:
    return F.when(forward, lifted).otherwise(F.struct((read_length - lifted["e"]).alias("s"), (read_length - lifted["s"]).alias("e")))


def sub_cigar(segs: Column, s: Column, e: Column) -> Column:
    """Operations of a reference interval without gaps at its ends; null where nothing is aligned."""
    cut = F.filter(segs, lambda x: F.when(x["op"].isin(*REF_OPS), (x["ref"] < e) & (x["ref"] + x["len"] > s)).otherwise((x["ref"] > s) & (x["ref"] < e)))
    ops = F.transform(cut, lambda x: F.struct(F.when(x["op"].isin(*REF_OPS), F.least(x["ref"] + x["len"], e) - F.greatest(x["ref"], s)).otherwise(x["len"]).cast("int").alias("len"), x["op"].alias("op")))

    def trimmed(ops: Column) -> Column:
        aligned = F.transform(ops, lambda x, i: F.when(x["op"].isin(*BOTH_OPS), i))
        return let(aligned, lambda a: F.when(F.array_min(a).isNotNull(), F.slice(ops, F.array_min(a) + 1, F.array_max(a) - F.array_min(a) + 1)))

    return let(ops, trimmed)


def alignment_stats(ops: Column) -> Column:
    """struct(ref_len, read_len, aligned, mismatches, insertions, deletions, similarity, score) in one pass: score 1, -4 and
    -(6 + length)."""
    zero = F.lit(0).cast("bigint")
    sums = ("ref", "read", "aligned", "mismatches", "insertions", "deletions", "score")

    def step(a: Column, x: Column) -> Column:
        op, n = x["op"], x["len"]
        of = lambda *kinds: F.when(op.isin(*kinds), n).otherwise(0)
        more = (_ref(x), _read(x), of(*BOTH_OPS), of("X"), of("I"), of("D"), F.when(op == "=", n).when(op == "X", -4 * n).when(op.isin("I", "D"), -6 - n).otherwise(0))
        return F.struct(*((a[k] + v).alias(k) for k, v in zip(sums, more)))

    def finished(a: Column) -> Column:
        nm = a["mismatches"] + a["insertions"] + a["deletions"]
        similarity = 1 - nm / (a["aligned"] + a["insertions"] + a["deletions"])
        return F.struct(a["ref"].alias("ref_len"), a["read"].alias("read_len"), *(a[k].alias(k) for k in sums[2:6]), similarity.alias("similarity"), a["score"].alias("score"))

    return F.aggregate(ops, F.struct(*(zero.alias(k) for k in sums)), step, finished)


def aligned_pairs(df: DataFrame, segs: str, keys: list[str]) -> DataFrame:
    """One row a base of the aligned blocks: ref_pos, read_pos."""
    blocks = df.select(*keys, F.explode(segs).alias("x")).filter(F.col("x.op").isin(*BOTH_OPS))
    return blocks.select(*keys, F.col("x.ref").alias("_r"), F.col("x.read").alias("_q"), F.explode(F.sequence(F.lit(0), F.col("x.len") - 1)).alias("_k")).select(
        *keys, (F.col("_r") + F.col("_k")).alias("ref_pos"), (F.col("_q") + F.col("_k")).alias("read_pos")
    )


def segment_rows(df: DataFrame, ops: str, keys: list[str]) -> DataFrame:
    """One row an operation: keys, i, x (op, len, ref, read). keys tell the alignments apart; sums run along each."""
    rows = df.select(*keys, F.posexplode(ops).alias("i", "o"))
    before = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda size: F.coalesce(F.sum(size(F.col("o"))).over(before), F.lit(0)).cast("bigint")
    return rows.select(*keys, "i", F.struct(F.col("o.op").alias("op"), F.col("o.len").alias("len"), start(_ref).alias("ref"), start(_read).alias("read")).alias("x"))


def differences(df: DataFrame, ops: str, keys: list[str]) -> DataFrame:
    """Differences as (ref_s, ref_e, read_s, read_e): mismatch runs, and gaps anchored one base before them. Alignments of any
    number of operations; all steps share one partitioning by keys."""
    rows = segment_rows(df, ops, keys)
    w = Window.partitionBy(*keys).orderBy("i")
    kind = F.when(F.col("x.op") == "X", "X").when(F.col("x.op").isin("I", "D", "N"), "G")
    gap = F.when(F.col("x.op").isin("I", "D", "N") & (F.coalesce(F.lag("x.op").over(w), F.lit("")) != "X"), 1).otherwise(0)
    marked = rows.withColumn("_kind", kind).withColumn("_anchor", gap)
    marked = marked.withColumn("_new", F.when(F.lag("_kind").over(w).isNotNull() & F.col("_kind").isNotNull(), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    ref_len = F.when(F.col("x.op").isin(*REF_OPS), F.col("x.len")).otherwise(0)
    read_len = F.when(F.col("x.op").isin(*READ_OPS), F.col("x.len")).otherwise(0)
    d = marked.filter("_kind is not null").groupBy(*keys, "_run").agg(
        F.min(F.col("x.ref") - F.col("_anchor")).alias("ref_s"), F.max(F.col("x.ref") + ref_len).alias("ref_e"), F.min(F.col("x.read") - F.col("_anchor")).alias("read_s"), F.max(F.col("x.read") + read_len).alias("read_e")
    )
    return d.filter("ref_s >= 0 and read_s >= 0").drop("_run")


def read_middle(ops: Column, read_length: Column) -> Column:
    """Reference position of the read's middle base: null where clipped, of an insertion the base before it."""
    mid = F.floor(read_length / 2)

    def step(a: Column, x: Column) -> dict[str, Column]:
        here = x["op"].isin(*READ_OPS) & (a["read"] <= mid) & (a["read"] + x["len"] > mid)
        return {"at": F.when(here & x["op"].isin(*BOTH_OPS), a["ref"] + mid - a["read"]).when(here & (x["op"] == "I"), a["ref"] - 1).otherwise(a["at"])}

    return _along(ops, {"at": _nothing()}, step)["at"]


def truly_clipped(ops: Column, qualities: Column, low_quality: int, slack: int) -> Column:
    """Whether either end is clipped by more than its low-quality bases there plus `slack`."""
    n = F.size(qualities)
    first, last = F.get(ops, F.lit(0)), F.element_at(ops, -1)
    low = lambda q: F.size(F.filter(q, lambda x: x < low_quality))
    size = lambda x: F.when(x["op"] == "S", x["len"]).otherwise(0)
    left, right = size(first), F.when(F.size(ops) > 1, size(last)).otherwise(0)
    return (left > low(F.slice(qualities, F.lit(1), left)) + slack) | (right > low(F.slice(qualities, F.greatest(n - right, F.lit(0)) + 1, right)) + slack)


# ------------------------------------------------------------------ many alignments in arrays
def _mask(letters) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in letters]] = True
    return out


class Alignments:
    """The operations of a column of CIGARs one behind the other: of which row each is, its length and letter, and where it
    starts on either sequence. As in parse_cigar() what is no operation is passed over; a null has none."""

    def __init__(self, cigars: pa.Array):
        cigars = cigars.cast(pa.large_string()) if len(cigars) else pa.array([], pa.large_string())
        offsets = np.frombuffer(cigars.buffers()[1], np.int64)[cigars.offset : cigars.offset + len(cigars) + 1] if len(cigars) else np.zeros(1, np.int64)
        data = cigars.buffers()[2]
        text = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        at = np.flatnonzero(_mask("MIDNSHP=X")[text])
        row = np.searchsorted(offsets, at, "right") - 1
        begin = offsets[row]
        length, factor, k = np.zeros(len(at), np.int64), 1, 0
        more, digits = np.ones(len(at), bool), np.ones(len(at), np.int64)
        while more.any() and k < 18:
            k += 1
            digit = text[np.maximum(at - k, 0)].astype(np.int64) - 48
            more &= (at - k >= begin) & (digit >= 0) & (digit <= 9)
            length += np.where(more, digit * factor, 0)
            digits[more & (digit > 0)] = k  # without zeros in front
            factor *= 10
            if k == 1:
                numbered = more.copy()
        if len(at):
            at, row, length, digits = at[numbered], row[numbered], length[numbered], digits[numbered]
        if cigars.null_count:
            own = cigars.is_valid().to_numpy(zero_copy_only=False)[row]
            at, row, length, digits = at[own], row[own], length[own], digits[own]
        self.n, self.row, self.length, self.op = len(cigars), row, length, text[at]
        self._text, self._at, self._begin, self._null = text, at, at - digits, cigars.is_null().to_numpy(zero_copy_only=False)
        self.on_ref, self.on_read = (_mask(ops)[self.op] for ops in (REF_OPS, READ_OPS))
        self.ref, self.ref_length = self._starts(self.on_ref)
        self.read, self.read_length = self._starts(self.on_read)
        own = np.flatnonzero(self.on_ref & (length > 0))
        self._base = np.cumsum(self.ref_length + 1) - self.ref_length - 1
        self._own, self._key = own, self._base[row[own]] + self.ref[own]

    def _starts(self, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = np.where(counted, self.length, 0)
        total = np.bincount(self.row, step, self.n).astype(np.int64)
        return np.cumsum(step) - step - (np.cumsum(total) - total)[self.row], total

    def regions(self, row: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """aligned_region() of reference intervals of rows: s and e on the read, and whether both are there."""
        n = self.ref_length[row]
        there = (s >= 0) & (s < n) & (e > 0) & (e <= n)
        row, s, e = (np.where(there, x, 0) for x in (row, s, e))
        out = []
        for place, side in ((s, "right"), (e, "left")):
            k = self._own[np.maximum(np.searchsorted(self._key, self._base[row] + place, side) - 1, 0)] if len(self._own) else np.zeros(len(row), np.int64)
            out.append(np.where(there, self.read[k] + np.where(self.on_read[k], place - self.ref[k], 0), 0) if len(self._own) else np.zeros(len(row), np.int64))
        return out[0], out[1], there

    def _cut(self, begin: np.ndarray, end: np.ndarray, of: np.ndarray | None = None, n: int = 0, as_other: bool = False) -> pa.Array:
        """The stretches of text, one a row, or those of a row (of: ascending row numbers below n) behind each other."""
        size = end - begin
        bytes_of = self._text[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
        if as_other:
            bytes_of = _OTHER[bytes_of]
        total = size if of is None else np.bincount(of, size, n).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(total)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(total), pa.py_buffer(offsets), pa.py_buffer(bytes_of)).cast(pa.string())

    def texts(self, reverse: bool = False, revert: bool = False) -> pa.Array:
        """format_cigar() of the operations, in reverse order or as the other sequence sees them."""
        order = np.arange(len(self.row))
        if reverse:
            count = np.bincount(self.row, minlength=self.n)
            first = np.cumsum(count) - count
            order = (2 * first + count - 1)[self.row] - order
        made = self._cut(self._begin[order], self._at[order] + 1, self.row, self.n, revert)
        return pc.if_else(pa.array(self._null), pa.scalar(None, pa.string()), made)

    def _touched(self, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The aligned operations that each row's reference interval touches first and last, those of the rows that have any (some)."""
        own = np.flatnonzero(_mask(BOTH_OPS)[self.op])
        if not len(own):
            none = np.zeros(0, np.int64)
            return np.zeros(self.n, bool), none, none, none
        base, n = self._base, self.ref_length
        starts = base[self.row[own]] + self.ref[own]
        first = np.searchsorted(starts + self.length[own], base + np.clip(s, -1, n), "right")
        last = np.searchsorted(starts, base + np.clip(e, 0, n + 1), "left") - 1
        count = np.bincount(self.row[own], minlength=self.n)
        begin = np.cumsum(count) - count
        some = (count > 0) & (first < begin + count) & (last >= begin) & (first <= last)
        return some, np.flatnonzero(some), own[first[some]], own[last[some]]

    def lift(self, s: np.ndarray, e: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """lift() of a reference interval of each row."""
        some, row, a, b = self._touched(s, e)
        out = np.zeros((2, self.n), np.int64)
        out[0, row] = self.read[a] + np.maximum(0, s[row] - self.ref[a])
        out[1, row] = self.read[b] + np.minimum(self.length[b], e[row] - self.ref[b])
        return tuple(pa.array(x, mask=~some) for x in out)

    def sub_texts(self, s: np.ndarray, e: np.ndarray) -> pa.Array:
        """format_cigar(sub_cigar()) of a reference interval of each row: what is between its first and last aligned operation
        is all of it."""
        some, row, a, b = self._touched(s, e)
        left = lambda k: np.minimum(self.ref[k] + self.length[k], e[row]) - np.maximum(self.ref[k], s[row])
        count = b - a + 1
        op = np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum())
        own = np.repeat(np.arange(len(row)), count)
        inner = (op != a[own]) & (op != b[own])
        letter = lambda k: self._cut(self._at[k], self._at[k] + 1)
        number = lambda x: pa.array(x).cast(pa.string())
        middle = self._cut(self._begin[op[inner]], self._at[op[inner]] + 1, own[inner], len(row))
        end = pc.if_else(pa.array(a == b), "", pc.binary_join_element_wise(number(left(b)), letter(b), ""))
        made = pc.binary_join_element_wise(number(left(a)), letter(a), middle, end, "")
        at = np.full(self.n, -1, np.int64)
        at[row] = np.arange(len(row))
        return made.take(pa.array(at, mask=at < 0))


_OTHER = np.arange(256, dtype=np.uint8)
_OTHER[[ord("I"), ord("D")]] = ord("D"), ord("I")


def with_alignments(df: DataFrame, cigar: str, f: Callable[[Alignments, Callable[[str], np.ndarray]], list[pa.Array]], columns: str) -> DataFrame:
    """Adds columns that f makes of the alignments of many rows at a time; it gets other columns of numbers without nulls by name."""
    schema = StructType([*df.schema.fields, *StructType.fromDDL(columns).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = f(Alignments(b.column(b.schema.get_field_index(cigar))), lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False))  # noqa: B023
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip([*b.columns, *made], arrow)], schema=arrow)

    return df.mapInArrow(run, schema)

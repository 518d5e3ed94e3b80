"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments A, B, C of 23, 23 and 18 bits. Every 23-bit word lies within 3
errors of exactly one codeword of the (23,12) Golay code, so a word at most one error away from x lies
within 4 errors of x's codeword: if each fingerprint lists, per segment, all codewords within 4 (one or
six of them), two segments that differ in at most one bit share the codeword nearest to either.

Pigeonhole over 3 errors: they fall as (1,1,1), or else some segment i is equal and another segment j
differs in at most one bit. So the keys are
  kind 0:    codeword indices near A, near B and near C          (36 bits)
  kinds 1-6: segment i itself, codeword index near j             (30 to 35 bits)
and any two fingerprints that differ in 3 bits or fewer list each other's nearest key of a kind. Of a kind's
keys each fingerprint keeps its nearest and the larger ones: the one with the smaller nearest key still meets the
other there. That leaves about 76 keys of kind 0 and 20 of the others. Among n fingerprints that are alike
by chance only, a key of kind 0 has 76 n / 2^36 members and one of kinds 1-6 3.3 n / 2^35 or (C itself) 3.3 n / 2^30,
which is 11 and 1 or 31 at n = 10^10. Candidates are then verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialize, slices, spread, table
from .components import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
GENERATOR = 0b110001110101  # x^11+x^10+x^6+x^5+x^4+x^2+1
SMALL_GROUP = 32  # groups up to this size are compared all at once, larger ones are walked
MAX_GROUP = 1 << 16  # members of a key held at once; larger groups are compared again in pairs of blocks
FINGERPRINTS = pa.schema([("id", pa.int64()), ("fp", pa.int64())])
KEYS = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("id", pa.int64())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("size", pa.int64())])


# ---------------------------------------------------------------- fingerprints
def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = map(slice, starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in map(joined.__getitem__, spans)), np.uint64, len(words) - width + 1)


# for each byte its bits in eight lanes of 8 bits, so that up to 255 of these can be added
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How often each bit is set in the rows of a uint64 matrix (or vector, one column)."""
    bytes_ = np.ascontiguousarray(words, "<u8").reshape(len(words), -1).view(np.uint8)
    counts = np.zeros(bytes_.shape[1] * 8, np.int64)
    for at in range(0, len(bytes_), 255):
        counts += _LANES[bytes_[at : at + 255]].sum(axis=0, dtype="<u8").view(np.uint8)
    return counts


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set where it is set in more than half of the hashes; no hashes: zero."""
    if not len(hashes):
        return 0
    return int(np.packbits(2 * bit_counts(hashes) > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        yield batch_of(FINGERPRINTS, part.column(0), [fingerprint(shingle_hashes(t)) for t in part.column(1).to_pylist()])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row; narrow, no shuffle. Null and wordless texts: 0."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints, "id long, fp long")


# ---------------------------------------------------------------- Golay keys
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def mod(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    high = np.array([mod(d << 11) for d in range(4096)], np.int64)
    single = [mod(1 << i) for i in range(23)]
    errors: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for at in combinations(range(23), weight):
            s = 0
            for i in at:
                s ^= single[i]
            errors[s].append(sum(1 << i for i in at))
    near = np.zeros((2048, 6), np.int64)
    for s, es in enumerate(errors):
        near[s, : len(es)] = es
    return high, near, np.array([len(es) for es in errors], np.int64)


_HIGH, _NEAR, _N_NEAR = _tables()


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (n, 6) of the codewords within 4 errors of 23-bit words, the nearest first, and a mask of the slots in use."""
    syndrome = _HIGH[words >> 11] ^ (words & 2047)
    return (words[:, None] ^ _NEAR[syndrome]) >> 11, np.arange(6) < _N_NEAR[syndrome][:, None]


def segments(fps: np.ndarray) -> list[np.ndarray]:
    u = fps.view(np.uint64)
    return [(u >> np.uint64(41)).astype(np.int64), (u >> np.uint64(18) & np.uint64((1 << 23) - 1)).astype(np.int64), (u & np.uint64((1 << 18) - 1)).astype(np.int64)]


def segment_keys(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) arrays of kinds 1-6, each in turn: kind << 35 | segment i << 12 | codeword near segment j."""
    own = segments(fps)
    near = [near_codewords(s) for s in own]
    for kind, (i, j) in enumerate(((i, j) for i in range(3) for j in range(3) if i != j), 1):
        words, used = near[j]
        rows, k = np.nonzero(used & (words >= words[:, :1]))
        yield rows, kind << 35 | own[i][rows] << 12 | words[rows, k]


def golay_keys(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) arrays of all kinds."""
    (a, in_a), (b, in_b), (c, in_c) = (near_codewords(s) for s in segments(fps))
    key = a[:, :, None, None] << 24 | b[:, None, :, None] << 12 | c[:, None, None, :]
    rows, i, j, k = np.nonzero(in_a[:, :, None, None] & in_b[:, None, :, None] & in_c[:, None, None, :] & (key >= key[:, :1, :1, :1]))
    yield rows, key[rows, i, j, k]
    yield from segment_keys(fps)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            ids, fps = part.column(0).to_numpy(), part.column(1).to_numpy()
            for rows, key in golay_keys(fps):
                yield batch_of(KEYS, key, fps[rows], ids[rows])


# ---------------------------------------------------------------- links
def _walk(fps: np.ndarray, ids: np.ndarray, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links in one large group: what a member reaches leaves the rest at once,
    so a dense group costs a few passes over it and a group never emits more edges than members."""
    edges, rest = [], np.arange(len(fps))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            p = front.pop()
            hit = np.bitwise_count(fps[rest] ^ fps[p]) <= bits
            if hit.any():
                reached = rest[hit]
                edges += [(int(ids[p]), int(ids[q])) for q in reached]
                front += reached.tolist()
                rest = rest[~hit]
    return edges


def key_groups(batches: Iterator[pa.RecordBatch], most: int | None, parts: bool = False) -> Iterator[tuple[np.ndarray, list[np.ndarray]] | tuple[int, int]]:
    """From rows sorted by their first column: (sizes of whole groups one after the other, their columns). A group
    larger than `most` is never held: it comes as (key, size), and with `parts` also in parts, each like a group."""
    held: list[list[np.ndarray]] = []
    n, passed, last = 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if passed:
            same = int(np.searchsorted(columns[0], last, side="right"))
            if same < len(columns[0]):
                yield int(last), passed + n + same
                passed = 0
                columns = columns if parts else [c[same:] for c in columns]
            elif not parts:
                passed += same
                continue
        held.append(columns)
        n += len(columns[0])
        last = columns[0][-1]
        if last == held[0][0][0]:  # one group so far
            if most and n > most:
                if parts:
                    yield np.array([n]), [np.concatenate(c) for c in zip(*held)]
                held, n, passed = [], 0, passed + n
            continue
        columns = [np.concatenate(c) for c in zip(*held)]
        cut = int(np.searchsorted(columns[0], last))
        yield from _whole(columns, cut, most, parts)
        held, n = [[c[cut:] for c in columns]], len(columns[0]) - cut
    if passed:
        yield int(last), passed + n
    if held:
        yield from _whole([np.concatenate(c) for c in zip(*held)], n, most, parts)


def _whole(columns: list[np.ndarray], cut: int, most: int | None, parts: bool) -> Iterator[tuple]:
    key = columns[0][:cut]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, cut))
    large = sizes > (most or cut)
    for g in np.flatnonzero(large):
        yield int(key[starts[g]]), int(sizes[g])
    large &= not parts
    keep = np.repeat(~large, sizes)
    yield sizes[~large], [c[:cut][keep] for c in columns]


def pairs_of_small(key: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs within groups of at most `most` members, one step apart, two steps apart, ..."""
    size = np.repeat(sizes, sizes)
    live = np.flatnonzero((size > 1) & (size <= most))
    for step in range(1, most):
        live = live[live + step < len(key)]
        live = live[key[live + step] == key[live]]
        if not len(live):
            return
        yield live, live + step


def _links(batches: Iterator[pa.RecordBatch], most: int | None = MAX_GROUP) -> Iterator[pa.RecordBatch]:
    """Rows of KEYS come sorted by key; links as (a, b), a group larger than `most` as (its key, null, its size)."""
    for sizes, columns in key_groups(batches, most):
        if isinstance(columns, int):
            yield batch_of(EDGES, [sizes], [None], [columns])
            continue
        key, fp, ids = columns
        fp = fp.view(np.uint64)
        found: list[np.ndarray] = []
        for i, j in pairs_of_small(key, sizes, SMALL_GROUP):
            hit = np.bitwise_count(fp[i] ^ fp[j]) <= MAX_BITS
            if hit.any():
                found.append(np.stack([ids[i[hit]], ids[j[hit]]], axis=1))
        starts = np.cumsum(sizes) - sizes
        for at in np.flatnonzero(sizes > SMALL_GROUP):
            own = slice(starts[at], starts[at] + sizes[at])
            if edges := _walk(fp[own], ids[own]):
                found.append(np.array(edges, np.int64))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        yield batch_of(EDGES, pairs[:, 0], pairs[:, 1], pa.nulls(len(pairs), pa.int64()))


def in_blocks(keys: DataFrame, large: DataFrame, most: int = MAX_GROUP) -> DataFrame:
    """Members (key, ..., id) of the groups in large (key, size), each pair of blocks of a group as a group of its
    own: any two members of a group meet in one, and a group has about `most` members."""
    parts = large.select(F.col("key").alias("_k"), F.ceil(F.col("size") * 2 / most).cast("int").alias("_n"))
    cut = keys.join(parts, F.col("key") == F.col("_k")).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")))
    met = cut.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return met.withColumn("key", F.xxhash64("key", F.least("_b", "_o"), F.greatest("_b", "_o"))).select(keys.columns)


def grouped(keys: DataFrame) -> DataFrame:
    return keys.repartition("key").sortWithinPartitions("key")


def near_groups(fps: DataFrame, most: int = MAX_GROUP) -> DataFrame:
    """(fp, component) for each fingerprint of a table (id, fp): the smallest id reachable over links of at
    most 3 differing bits. Copies are folded into one row before any key is made, so a fingerprint shared
    by a third of all rows costs one row from there on. A key with over `most` fingerprints isn't held by one task:
    its members are compared again by pairs of blocks."""
    one = materialize(fps.filter("id is not null").groupBy("fp").agg(F.min("id").alias("id")), "fingerprints", narrow=True)
    keys = spread(one.select("id", "fp"), one.count(), "fp").mapInArrow(_keys, "key long, fp long, id long")
    kinds = "a long, b long, size long"
    found = materialize(grouped(keys).mapInArrow(lambda b: _links(b, most), kinds), "links", narrow=True)
    edges = found.filter("size is null").select("a", "b")
    large = found.filter("size is not null").select(F.col("a").alias("key"), "size")
    if large.head(1):
        edges = edges.union(grouped(in_blocks(keys, large, most)).mapInArrow(lambda b: _links(b, None), kinds).select("a", "b"))
    groups = connected_components(edges)
    return one.join(groups, one["id"] == groups["node"], "left").select("fp", F.coalesce("component", "id").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Nulls: a null text counts as wordless (fingerprint zero, linked like any other); a row without an id
    links nothing and takes the component of an equal fingerprint, else null. Repeated rows each get
    their row. Other columns of docs are not read, whatever their names. Empty table: empty result.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "simhash", narrow=True)
    groups = near_groups(fps)
    return fps.join(groups, "fp", "left").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

"""SimHash near-duplicates at a similarity: the Golay keys of several fingerprints find candidates, and each
candidate pair is compared exactly, by the Jaccard similarity of its sets of 5-word shingles.

One fingerprint and three bits reach few pairs of similarity 0.8: such texts differ in about 10 of 64 bits of a
SimHash of 5-word shingles. So the FINGERPRINTS are made of the distinct pairs of neighbouring words, where
they differ in about 6 bits, and each has the keys of kinds 1-6. A pair meets in one fingerprint's keys with a
probability of 0.34 at a similarity of 0.80 to 0.85, of 0.47 up to 0.9 and of 0.66 above (measured on
the documents of the check tool), so in one of 12 with 0.993, 0.9995 and 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, discard, materialize, slices, spread
from .components import connected_components
from .simhash import MAX_GROUP, _walk, bit_counts, grouped, key_groups, pairs_of_small, segment_keys

WIDTH = 5
LEAST = 0.8
FEATURE = 2  # words
FINGERPRINTS = 12
MOST_BITS = 10  # of the 64 whose key a pair shares; of pairs of similarity 0.8 that share one, 999 in 1000 differ in 6 at most
MOST_APART = 132  # of the bits of all fingerprints, 768; such pairs differ in 60 to 64 on average, 130 at most (seen in 84,796)
SMALL_GROUP = 4  # members of a key that are compared pair by pair; larger groups are joined to clusters over the same pairs
BLOCK = 256  # nodes of a cluster; blocks are compared two by two
_COLUMNS = 4096  # shingles looked at together in a pair of blocks
_rng = np.random.default_rng(5)
_TIMES = _rng.integers(0, 1 << 63, FINGERPRINTS, np.uint64) * np.uint64(2) + np.uint64(1)
SKETCHES = pa.schema([("id", pa.int64()), ("t", pa.int64()), ("own", pa.int64()), ("fps", pa.list_(pa.int64()))])
KEYS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("fp", pa.int64())])
CANDIDATES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("many", pa.bool_())])
SETS = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(32)


def word_values(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").lower().split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingle_set(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of all stretches of `width` words; a shorter text is one stretch, a wordless one too."""
    width = max(1, min(width, len(words)))
    if not len(words):
        return np.zeros(1, np.uint64)
    h = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - width + 1 + k]
    return np.unique(_mixed(h))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def fingerprints(features: np.ndarray) -> np.ndarray:
    """FINGERPRINTS independent SimHashes of a set of hashes."""
    counts = np.zeros(64 * FINGERPRINTS, np.int64)
    for at in range(0, len(features), 1 << 13):
        counts += bit_counts(_mixed(features[at : at + (1 << 13), None] * _TIMES))
    return np.packbits(2 * counts > len(features), bitorder="little").view("<i8")


def _sketches(width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = [word_values(t) for t in part.column(1).to_pylist()]
            own = np.array([xxhash.xxh3_64_intdigest(shingle_set(w, width).tobytes()) for w in words], np.uint64).view(np.int64)
            flat = np.concatenate([fingerprints(shingle_set(w, FEATURE)) for w in words])
            ends = np.arange(0, len(flat) + 1, FINGERPRINTS, dtype=np.int32)
            yield batch_of(SKETCHES, part.column(0), part.column(2), own, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))

    return sketch


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (node, fps)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4000):
            part = batch.slice(at, 4000)
            nodes, fps = part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(part.num_rows, FINGERPRINTS)
            for f in range(FINGERPRINTS):
                own = np.ascontiguousarray(fps[:, f])
                for rows, key in segment_keys(own):
                    yield batch_of(KEYS, key | f << 40, nodes[rows], own[rows])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of KEYS sorted by key: pairs of small groups that differ in MOST_BITS at most; of larger ones (many) a forest
    that joins the members of all such pairs, which never has more edges than members. A group too large to hold goes in
    parts, each of which is tied to the first member of the part before."""
    last_key, last_node = None, 0
    for sizes, columns in key_groups(batches, MAX_GROUP, parts=True):
        if isinstance(columns, int):
            continue
        key, nodes, fp = columns[0], columns[1], columns[2].view(np.uint64)
        if not len(key):
            continue
        pairs = [np.stack([nodes[i[ok]], nodes[j[ok]]]) for i, j in pairs_of_small(key, sizes, SMALL_GROUP) if (ok := np.bitwise_count(fp[i] ^ fp[j]) <= MOST_BITS).any()]
        yield _unique(pairs, False)
        starts = np.cumsum(sizes) - sizes
        trees = []
        for at, n in zip(starts.tolist(), sizes.tolist()):
            if n > SMALL_GROUP and (edges := _walk(fp[at : at + n], nodes[at : at + n], MOST_BITS)):
                trees.append(np.array(edges, np.int64).T)
        if key[0] == last_key:
            trees.append(np.stack([np.full(sizes[0], last_node), nodes[: sizes[0]]]))
        yield _unique(trees, True)
        last_key, last_node = key[-1], nodes[starts[-1]]


def _unique(pairs: list[np.ndarray], many: bool) -> pa.RecordBatch:
    both = np.unique(np.sort(np.concatenate(pairs, axis=1), axis=0), axis=1) if pairs else np.zeros((2, 0), np.int64)
    both = both[:, both[0] != both[1]]
    return batch_of(CANDIDATES, both[0], both[1], np.full(both.shape[1], many))


def _not_far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, fingerprints, fingerprints) the pairs that differ in MOST_APART bits at most."""
    for batch in batches:
        if batch.num_rows:
            x, y = (batch.column(k).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array(np.bitwise_count(x ^ y).sum(axis=1) <= MOST_APART))


def _verified(least: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2 << 20):
            ok = [jaccard(*(np.asarray(c[k].values) for c in (part.column("x"), part.column("y")))) >= least for k in range(part.num_rows)]
            yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return compare


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets have in common; those of one set only need no look."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    names, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = counts[at] > 1
    owner, at = owner[keep], at[keep]
    column = np.unique(at, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, (low, low + _COLUMNS))
        x = np.zeros((len(sets), _COLUMNS), np.float32)
        x[owner[a:b], column[a:b] - low] = 1
        out += x @ x.T
    return out


def _blocks(least: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows (key, node, shingles) sorted by key: of each group a spanning forest of its similar pairs."""
        for sizes, (_, nodes, shingles) in key_groups(batches, None):
            found = []
            for at, n in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist()):
                sets = [np.asarray(x) for x in shingles[at : at + n]]
                size = np.array([len(x) for x in sets], np.float64)
                both = shared(sets)
                linked = both >= least * (size[:, None] + size[None, :] - both) - 1e-9
                rest = set(range(n))
                while rest:
                    front = [rest.pop()]
                    while front:
                        p = front.pop()
                        reached = [q for q in np.flatnonzero(linked[p]).tolist() if q in rest]
                        rest.difference_update(reached)
                        front += reached
                        found += [(nodes[at + p], nodes[at + q]) for q in reached]
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield batch_of(PAIRS, pairs[:, 0], pairs[:, 1])

    return compare


def similar_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """(id, t, component_id, stays) for every row of docs with an id, t being xxhash64 of its text: component_id is the smallest
    id reachable over pairs whose sets of shingles have a Jaccard similarity of `least` or more, and stays marks the one (id, t) of each
    component, of those with its smallest id, that stands for it.

    Texts with equal sets are one node, so exact copies cost a row each and no pair. Null and wordless texts are copies
    of each other. Candidates are pairs that share a key and differ in MOST_BITS of that fingerprint and MOST_APART of all at
    most. Where many share a key no pairs are made: those within MOST_BITS join their texts to a cluster, which is cut into
    blocks, and two blocks at a time are compared whole, so no task holds more than two blocks and only links come out.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    texts = texts.withColumn("t", F.xxhash64(F.coalesce("text", F.lit(""))))
    made = materialize(texts.mapInArrow(_sketches(width), "id long, t long, own long, fps array<long>"), "sketches", narrow=True)
    one = made.groupBy("own").agg(F.min_by(F.struct("id", "t", "fps"), F.struct("id", "t")).alias("s"))
    one = materialize(one.select("own", F.monotonically_increasing_id().alias("node"), "s.*"), "sets")  # ids are given once, as the table is written
    keys = spread(one.select("node", "fps"), one.count(), "node", rows=50_000).mapInArrow(_keys, "key long, id long, fp long")
    found = materialize(grouped(keys).mapInArrow(_candidates, "a long, b long, many boolean"), "candidates", narrow=True)
    cluster = materialize(connected_components(found.filter("many").select("a", "b")), "clusters", narrow=True)
    inside = lambda n: cluster.select(F.col("node").alias(n), F.col("component").alias(f"c{n}"))
    pairs = found.filter("not many").select("a", "b").distinct().join(inside("a"), "a", "left").join(inside("b"), "b", "left")
    pairs = pairs.filter(~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))).select("a", "b")

    def sets_of(met: DataFrame) -> DataFrame:
        known = one.select("node", "id", "t").join(met, "node").select("node", F.col("id").alias("_id"), F.col("t").alias("_t"))
        rows = texts.join(known, (F.col("id") == F.col("_id")) & (F.col("t") == F.col("_t"))).select("node", "text").dropDuplicates(["node"])

        def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                yield batch_of(SETS, part.column(0), [shingle_set(word_values(t), width).view(np.int64) for t in part.column(1).to_pylist()])

        return materialize(rows.mapInArrow(shingled, "node long, shingles array<long>"), "shingles")

    prints = {n: one.select(F.col("node").alias(n), F.col("fps").alias(f)) for n, f in (("a", "x"), ("b", "y"))}

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.join(prints["a"], "a").join(prints["b"], "b").select("a", "b", "x", "y").mapInArrow(_not_far, "a long, b long"), "pairs", narrow=True)
        sets = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        x, y = (sets.select(F.col("node").alias(n), F.col("shingles").alias(s)) for n, s in (("a", "x"), ("b", "y")))
        out = materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verified(least), "a long, b long"), "edges", narrow=True)
        discard(sets)
        return out

    edges = verified(pairs)
    if cluster.head(1):
        counts = cluster.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        parts = materialize(counts.select("component", F.ceil(F.col("n") / BLOCK).cast("int").alias("n")), "counts", narrow=True)
        dealt = cluster.join(parts, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("n"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        dealt = dealt.select("node", F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
        rows = dealt.join(sets_of(cluster.select("node")), "node").select("key", "node", "shingles")
        edges = edges.union(grouped(rows).mapInArrow(_blocks(least), "a long, b long"))
    component = connected_components(edges)
    component = component.withColumnsRenamed({"node": "_n", "component": "_c"})
    named = one.join(component, F.col("node") == F.col("_n"), "left").select("own", "id", "t", F.coalesce("_c", "node").alias("component"))
    least_of = materialize(named.groupBy("component").agg(F.min(F.struct("id", "t")).alias("l")).select("component", "l.id", "l.t"), "least", narrow=True)
    named = named.select("own", "component").join(least_of.withColumnsRenamed({"id": "_lid", "t": "_lt"}), "component")
    out = made.select("id", "t", "own").join(named, "own")
    return out.select("id", "t", F.col("_lid").alias("component_id"), ((F.col("id") == F.col("_lid")) & (F.col("t") == F.col("_lt"))).alias("stays"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """(doc_id, component_id) of similar_rows()."""
    return similar_rows(docs, id_col, text_col, width, least).select(F.col("id").alias("doc_id"), "component_id")

"""Vector code compression: vectors of integers are cut into parts, and each part is coded by the nearest entry of its
codebook, found in a kd-tree of the entries.

Codebooks start as the parts of some first vectors. A round broadcasts a kd-tree for each of them (parts x entries vectors,
whatever the table's size), assigns all parts where they lie, sums each entry's parts as integers within a task, and
Spark adds up the tasks' sums; the driver gets one number for each component of an entry. The search is branch and bound
for a whole batch at once: a box whose bound equals the best distance is visited too, so that of equally near entries the
one of the lower index is found. Integers have no largest value here: components of over 2^28 or so are Python's, and sums
travel as 32-bit digits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialize, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LEAF = 2
MOST = 2**63 - 1
HOT_SHARE = 10_000  # a label with over 1 in so many rows is joined by broadcast
DIGIT = 32
CODED = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])


@dataclass
class Node:
    """A box of entries: its corners, and either their indices or two boxes."""

    low: np.ndarray
    high: np.ndarray
    entries: list[int]
    inner: tuple[Node, Node] | None = None


def kd_tree(entries: np.ndarray, own: list[int] | None = None) -> Node:
    own = list(range(len(entries))) if own is None else own
    points = entries[own]
    node = Node(points.min(axis=0), points.max(axis=0), own)
    if len(own) > LEAF and (node.low != node.high).any():
        axis = int(np.argmax(node.high - node.low))
        order = [own[i] for i in sorted(range(len(own)), key=lambda i: (points[i][axis], own[i]))]
        half = len(order) // 2
        node.inner = kd_tree(entries, sorted(order[:half])), kd_tree(entries, sorted(order[half:]))
    return node


def _square(differences: np.ndarray) -> np.ndarray:
    return (differences * differences).sum(axis=1)


def _bound(node: Node, points: np.ndarray) -> np.ndarray:
    return _square(np.maximum(np.maximum(node.low - points, points - node.high), 0))


def nearest(tree: Node, entries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each point, the lowest index among equals."""
    n = len(points)
    index = np.full(n, len(entries), np.int64)
    distance = np.full(n, MOST) if points.dtype != object else np.full(n, 1 << 1024, object)

    def visit(node: Node, rows: np.ndarray, bound: np.ndarray) -> None:
        rows = rows[bound <= distance[rows]]  # equal: it may hold an equally near entry of a lower index
        if not len(rows):
            return
        if node.inner is None:
            for i in node.entries:
                d = _square(points[rows] - entries[i])
                better = (d < distance[rows]) | (d == distance[rows]) & (i < index[rows])
                distance[rows[better]], index[rows[better]] = d[better], i
            return
        left, right = node.inner
        to_left, to_right = _bound(left, points[rows]), _bound(right, points[rows])
        first = to_left <= to_right
        visit(left, rows[first], to_left[first])
        visit(right, rows[first], to_right[first])
        visit(right, rows[~first], to_right[~first])
        visit(left, rows[~first], to_left[~first])

    visit(tree, np.arange(n), np.zeros(n, np.int64))
    return index, distance


def as_integers(values: np.ndarray, scale: int, parts: int) -> np.ndarray:
    """floor(scale * x) of a matrix of finite numbers: int64 where squared distances of a part fit, else Python integers."""
    scaled = np.floor(values.astype(np.float64) * scale)
    widest = np.sqrt(2.0**60 / max(1, -(-values.shape[1] // parts)))
    if not len(scaled) or np.abs(scaled).max() < widest:
        return scaled.astype(np.int64)
    return np.array([[int(x) if np.isfinite(x) else int(v) * scale for x, v in zip(*rows)] for rows in zip(scaled, values)], object)


def _narrow(entries: np.ndarray, scale_width: int) -> np.ndarray:
    """int64 where squared distances between such numbers fit."""
    limit = int(np.sqrt(2.0**60 / max(1, scale_width)))
    return entries.astype(np.int64) if all(abs(int(x)) < limit for x in entries.ravel()) else entries.astype(object)


class Codebooks:
    def __init__(self, books: list[np.ndarray]):
        self.books = [_narrow(b, b.shape[1]) for b in books]
        self.trees = [kd_tree(b) for b in self.books]
        self.ends = np.cumsum([b.shape[1] for b in books]).tolist()

    def assign(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each part position: the parts, their entries and squared distances."""
        for k, (a, b) in enumerate(zip([0, *self.ends], self.ends)):
            points = vectors[:, a:b]
            if self.books[k].dtype == object:
                points = points.astype(object)
            yield points, *nearest(self.trees[k], self.books[k], points)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for b in self.books for x in b.ravel()).encode()).hexdigest()


def part_ends(width: int, parts: int) -> list[int]:
    """Ends of `parts` consecutive parts; where width isn't a multiple, the first ones are longer by one."""
    return [width // parts * k + min(k, width % parts) for k in range(1, parts + 1)]


def _matrix(column: pa.Array, width: int, scale: int, parts: int) -> np.ndarray:
    return as_integers(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale, parts)


def _digits(total: int) -> list[int]:
    """The 32-bit digits of an integer, the lowest first; the last one carries the sign."""
    out = []
    while not -(1 << 31) <= total < 1 << 31:
        out.append(total & (1 << DIGIT) - 1)
        total >>= DIGIT
    return [*out, total]


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of every vector kept.

    Dropped are rows whose vector is null or empty or holds a null or non-finite component; so are, in a table of vectors
    of different lengths, those that haven't the length of most rows (the shorter of equals), as no codebook fits both. A
    length that isn't a multiple of `parts` gives first parts longer by one. Fewer vectors than entries make fewer entries.
    Repeated rows each get their row; as seeds equal ids go by a hash of their vectors. Null ids are kept, as seeds behind
    all others. Rows without a label share one label_error. Sums beyond a long are the largest long. Other columns are not
    read. No vectors: an empty result.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v")).filter(finite(F.col("v")) & (F.size("v") > 0))
    lengths = kept.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").head()
    if lengths is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    width, n_rows = lengths["width"], lengths["count"]
    kept = kept.filter(F.size("v") == width)
    seeds = [r["v"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), F.xxhash64("v"), "v").limit(entries).collect()]
    ends = part_ends(width, parts)
    first = as_integers(np.array(seeds, np.float64), scale, parts)
    books = Codebooks([first[:, a:b] for a, b in zip([0, *ends], ends)])

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)

        def add_up(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own: Codebooks = sent.value
            sums = [np.zeros((len(b), b.shape[1] + 1), object) for b in own.books]  # the last column counts
            for batch in batches:
                for total, (points, index, _) in zip(sums, own.assign(_matrix(batch.column(0), width, scale, parts))):
                    order = np.argsort(index, kind="stable")
                    used, starts = np.unique(index[order], return_index=True)
                    if len(used):
                        total[used, :-1] += np.add.reduceat(points[order], starts, axis=0).astype(object)
                        total[used, -1] += np.diff(np.append(starts, len(order))).astype(object)
            rows = [(p, e, c, k, d) for p, t in enumerate(sums) for (e, c), x in np.ndenumerate(t) for k, d in enumerate(_digits(int(x))) if d]
            schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("digit", pa.int32()), ("value", pa.int64())])
            if rows:
                yield batch_of(schema, *zip(*rows))

        digits = kept.select("v").mapInArrow(add_up, "part int, entry int, place int, digit int, value long").groupBy("part", "entry", "place", "digit").agg(F.sum("value").alias("value")).collect()
        totals = [np.zeros((len(b), b.shape[1] + 1), object) for b in books.books]
        for r in digits:
            totals[r["part"]][r["entry"], r["place"]] += r["value"] << DIGIT * r["digit"]
        new = []
        for book, total in zip(books.books, totals):
            used = total[:, -1] > 0
            moved = book.astype(object)
            moved[used] = total[used, :-1] // total[used, -1:]
            new.append(moved)
        books = Codebooks(new)
        sent.destroy()

    sent = spark.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(sent.value.assign(_matrix(batch.column(2), width, scale, parts)))
            rows = np.stack([index for _, index, _ in found], axis=1).astype(np.uint8)
            text = rows.tobytes().hex()
            step = 2 * parts
            error = sum(d.astype(object) for _, _, d in found)
            yield batch_of(CODED, batch.column(0), batch.column(1), [text[i : i + step] for i in range(0, len(text), step)], [min(int(e), MOST) for e in error])

    coded = materialize(kept.select("vec_id", "label", "v").mapInArrow(code, "vec_id long, label long, code string, error long"), "vector-codes")
    # pre-aggregated in every task; frequent labels, at most HOT_SHARE of them, are joined where the rows lie
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = materialize(coded.groupBy("label").agg(F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    often = sums.filter(F.col("n") * HOT_SHARE > n_rows).select(F.col("label").alias("l"), "label_error")
    seldom = sums.filter(F.col("n") * HOT_SHARE <= n_rows).select(F.col("label").alias("l"), F.col("label_error").alias("seldom_error"))
    joined = coded.join(F.broadcast(often), F.col("label").eqNullSafe(F.col("l")), "left").drop("l")
    done, rest = joined.filter("label_error is not null"), joined.filter("label_error is null").drop("label_error")
    rest = rest.join(seldom, F.col("label").eqNullSafe(F.col("l"))).withColumnRenamed("seldom_error", "label_error")
    columns = ("vec_id", "code", "error", "label_error")
    return done.select(*columns).union(rest.select(*columns)).withColumn("codebooks_sha256", F.lit(books.sha256()))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The same by all distances: each round's assignments and codebooks are a pair of tables."""
    assign = (
        "assigned{r} as materialized (select vec_id, label, part, x, entry, distance from (select p.vec_id, p.label, p.part, p.x, c.entry, "
        "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as distance, "
        "row_number() over (partition by p.vec_id, p.part order by list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.entry) as k "
        "from parts p join books{r} c using (part)) where k = 1)"
    )
    update = (
        "books{n} as materialized (select b.part, b.entry, coalesce(m.x, b.x) as x from books{r} b left join (select part, entry, list(((s - ((s % n) + n) % n) // n)::bigint order by place) as x from ("
        "select part, entry, place, sum(v)::hugeint as s, count(*)::hugeint as n from (select part, entry, unnest(x) as v, generate_subscripts(x, 1) as place from assigned{r}) group by part, entry, place) group by part, entry) m using (part, entry))"
    )
    steps = [text for r in range(ROUNDS) for text in (assign.format(r=r), update.format(r=r, n=r + 1))]
    return f"""with kept as (
select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select vec_id, label, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] as x from kept, range({PARTS}) t(part)),
books0 as materialized (select part, dense_rank() over (order by vec_id) - 1 as entry, x from parts where vec_id in (select vec_id from kept order by vec_id limit {ENTRIES})),
{", ".join(steps)}, {assign.format(r=ROUNDS)},
coded as (select vec_id, label, string_agg(format('{{:02x}}', entry), '' order by part) as code, sum(distance)::bigint as error from assigned{ROUNDS} group by vec_id, label)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
(select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) from books{ROUNDS}) as codebooks_sha256 from coded"""


OP11_SQL = _sql()

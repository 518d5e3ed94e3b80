"""Edit-aware token counts: each document keeps its pre-tokens in a segment tree of counts; an edit re-encodes
the pre-tokens it touches and those whose ends it can move, and then updates the sums above them.

A pre-token's match never depends on more than the two characters behind it, so matching restarts at the
first pre-token that ends later than two characters before the edit, and it stops at the first boundary
behind the edit that is a boundary of the old text too: from there on, equal text gives equal matches.

The tree is a treap in the order of the text, each node a segment of pre-tokens with the sums of its subtree. An edit
within a segment updates the sums on the path to it; one that crosses segments, or fills one, splits the tree around
them and joins in the new ones, which touches some paths and never the other segments. Strings of added tokens are
ordinary text here, as an edit could make or break one anywhere.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, byte_pair_ids
from .common import batch_of, slices, table

SEGMENT = 64  # pre-tokens in a segment; it may grow to twice as many
REACH = 2  # characters behind a match that it may depend on
REMEMBERED = 200_000
_MATCH = regex.compile(PATTERN)


class Counter:
    """Tokens of pre-tokens; the library encodes each different one when it is first met (bpe.BytePairIds)."""

    def __init__(self, path: str):
        self.ids = byte_pair_ids(path)
        self.known: dict[str, int] = {}

    def __call__(self, tokens: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out = list(map(self.known.get, tokens))
        if None in out:
            new = list(dict.fromkeys(t for t, n in zip(tokens, out) if n is None))
            counted = dict(zip(new, map(len, self.ids.encoded(new))))
            self.known.update((t, n) for t, n in counted.items() if len(t) < 64)
            out = [counted[t] if n is None else n for t, n in zip(tokens, out)]
        return out


class Segment:
    """A node: its own pre-tokens and their counts, and of its subtree the segments, characters, tokens and pre-tokens."""

    __slots__ = ("texts", "counts", "rank", "left", "right", "own", "segments", "chars", "tokens", "pretokens")

    def __init__(self, texts: list[str], counts: list[int], rank: int):
        self.rank, self.left, self.right = rank, None, None
        self.fill(texts, counts)

    def fill(self, texts: list[str], counts: list[int]) -> None:
        self.texts, self.counts, self.own = texts, counts, (sum(map(len, texts)), sum(counts))

    def add_up(self) -> None:
        self.segments, self.pretokens = 1, len(self.texts)
        self.chars, self.tokens = self.own
        for x in (self.left, self.right):
            if x is not None:
                self.segments += x.segments
                self.chars += x.chars
                self.tokens += x.tokens
                self.pretokens += x.pretokens


class TokenTree:
    """A treap of segments. `touched` counts the sums made since the start, `reencoded` the pre-tokens matched by edits."""

    def __init__(self, text: str, count: Callable[[list[str]], list[int]]):
        self.count = count
        self.reencoded = self.touched = 0
        self._state = 1
        tokens = _MATCH.findall(text)
        self.root = self._tree(tokens, count(tokens)) or self._node([], [])

    def _node(self, texts: list[str], counts: list[int]) -> Segment:
        self._state = (self._state * 6364136223846793005 + 1442695040888963407) & (1 << 64) - 1
        node = Segment(texts, counts, self._state >> 33)
        self._sum(node)
        return node

    def _sum(self, node: Segment) -> Segment:
        self.touched += 1
        node.add_up()
        return node

    def _tree(self, texts: list[str], counts: list[int]) -> Segment | None:
        """The segments of some pre-tokens: the highest rank becomes the root of those around it."""
        spine: list[Segment] = []
        for k in range(0, len(texts), SEGMENT):
            node, last = self._node(texts[k : k + SEGMENT], counts[k : k + SEGMENT]), None
            while spine and spine[-1].rank < node.rank:
                last = self._sum(spine.pop())
            node.left = last
            if spine:
                spine[-1].right = node
            spine.append(node)
        for node in reversed(spine):
            self._sum(node)
        return spine[0] if spine else None

    def _split(self, node: Segment | None, n: int) -> tuple[Segment | None, Segment | None]:
        """The first n segments of a tree, and the rest."""
        if node is None:
            return None, None
        before = node.left.segments if node.left else 0
        if n <= before:
            first, node.left = self._split(node.left, n)
            return first, self._sum(node)
        node.right, rest = self._split(node.right, n - before - 1)
        return self._sum(node), rest

    def _join(self, a: Segment | None, b: Segment | None) -> Segment | None:
        if a is None or b is None:
            return a or b
        if a.rank > b.rank:
            a.right = self._join(a.right, b)
            return self._sum(a)
        b.left = self._join(a, b.left)
        return self._sum(b)

    @property
    def n_chars(self) -> int:
        return self.root.chars

    @property
    def n_tokens(self) -> int:
        return self.root.tokens

    @property
    def n_pretokens(self) -> int:
        return self.root.pretokens

    def text(self) -> str:
        return "".join(t for _, _, t in self._following(0, 0))

    def _segment(self, n: int) -> list[Segment]:
        """The path from the root to segment n."""
        node, path = self.root, []
        while True:
            path.append(node)
            before = node.left.segments if node.left else 0
            if n == before:
                return path
            node, n = (node.left, n) if n < before else (node.right, n - before - 1)

    def _segment_at(self, pos: int) -> tuple[int, int]:
        """The segment that holds character pos (the last one with characters if none does), and where it starts."""
        pos, node, n, start = min(pos, self.n_chars - 1), self.root, 0, 0
        while True:
            if node.left:
                if pos - start < node.left.chars:
                    node = node.left
                    continue
                n, start = n + node.left.segments, start + node.left.chars
            if pos - start < node.own[0]:
                return n, start
            n, start, node = n + 1, start + node.own[0], node.right

    def _following(self, n: int, j: int) -> Iterator[tuple[int, int, str]]:
        while n < self.root.segments:
            texts = self._segment(n)[-1].texts
            for j in range(j, len(texts)):
                yield n, j, texts[j]
            n, j = n + 1, 0

    def edit(self, pos: int, delete: int, insert: str) -> None:
        """Replaces `delete` characters from pos by insert; both are cut to the text as it is by now."""
        pos = min(max(pos, 0), self.n_chars)
        delete = min(max(delete, 0), self.n_chars - pos)
        leaf, start = self._segment_at(max(pos - REACH, 0)) if self.n_chars else (0, 0)
        ends = list(accumulate(map(len, self._segment(leaf)[-1].texts), initial=start))
        j = max(min(bisect_right(ends, max(pos - REACH, 0)), len(ends) - 1) - 1, 0)
        at = ends[j]
        old, place = [], [(leaf, j)]  # place[k]: where old token k stands; the last: behind all read so far
        following, more, read, ended = self._following(leaf, j), 8, at, False
        while True:
            beyond = 0
            while beyond < more and not ended:
                step = next(following, None)
                if step is None:
                    ended = True
                    break
                old.append(step[2])
                place.append((step[0], step[1] + 1))
                read += len(step[2])
                beyond += read > pos + delete + REACH
            whole = "".join(old)
            region = whole[: pos - at] + insert + whole[pos + delete - at :]
            bounds = {b: k for k, b in enumerate(accumulate(map(len, old), initial=at)) if b >= pos + delete}
            new, b, met = [], at, None
            for m in _MATCH.finditer(region):
                if not ended and m.end() + REACH > len(region):
                    break
                new.append(m.group())
                b = at + m.end()
                if b >= pos + len(insert) and (met := bounds.get(b - len(insert) + delete)) is not None:
                    break
            if met is None and ended:
                met = len(old)  # the text ends here, in both
            if met is not None:
                break
            more *= 2
        self.reencoded += len(new)
        self._replace(place[0], place[met], new)

    def _replace(self, first: tuple[int, int], behind: tuple[int, int], new: list[str]) -> None:
        (i, j), (i2, j2) = first, behind
        path, last = self._segment(i), self._segment(i2)[-1]
        counts = path[-1].counts[:j] + self.count(new) + last.counts[j2:]
        texts = path[-1].texts[:j] + new + last.texts[j2:]
        if i == i2 and (0 < len(texts) <= 2 * SEGMENT or self.root.segments == 1 and not texts):
            path[-1].fill(texts, counts)
            for node in reversed(path):
                self._sum(node)
        else:
            before, rest = self._split(self.root, i)
            rest = self._split(rest, i2 + 1 - i)[1]
            self.root = self._join(self._join(before, self._tree(texts, counts)), rest) or self._node([], [])


_counters: dict[str, Counter] = {}
COUNTED = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_edits", "n_chars_before", "n_tokens_before", "n_chars_after", "n_tokens_after", "n_pretokens_after", "n_reencoded")]
)


def count_edits(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Token counts of each row's text before and after its edits, an array<struct<pos int, del int, ins string>>
    applied in order, each to the text that the one before it left.

    Nulls: a null text is empty, a null array has no edits, a null edit is skipped, null fields are 0 and
    empty; a null id is carried along. Positions outside the text are moved to its nearest end. Very long
    texts cost memory in proportion to the one text. Of edits at one place the earlier one comes first. Repeated rows each get their row; other columns are not
    read; an empty table gives an empty result.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _counters:
            _counters[tokenizer_path] = Counter(tokenizer_path)
        for part in slices(batches, 2 << 20):
            rows = []
            for doc_id, text, edits in zip(*(part.column(i).to_pylist() for i in range(3))):
                tree = TokenTree(text or "", _counters[tokenizer_path])
                before = (tree.n_chars, tree.n_tokens)
                edits = [e for e in edits or [] if e is not None]
                for e in edits:
                    tree.edit(e["pos"] or 0, e["del"] or 0, e["ins"] or "")
                rows.append((doc_id, len(edits), *before, tree.n_chars, tree.n_tokens, tree.n_pretokens, tree.reencoded))
            yield batch_of(COUNTED, *zip(*rows))

    kind = "array<struct<pos:int,del:int,ins:string>>"
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(edits_col).cast(kind).alias("edits"))
    return read.mapInArrow(counted, ", ".join(f"{c} long" for c in COUNTED.names))


def sample_edits(docs: DataFrame, n: int = 4) -> DataFrame:
    """documents with n made-up edits each, a function of the row alone: delete up to 63 characters at a place
    given by a hash and put in up to 47 characters from elsewhere in the same text."""
    length = F.coalesce(F.char_length("text"), F.lit(0))
    draw = lambda k, mod: F.pmod(F.xxhash64("doc_id", F.lit(k)), mod.cast("long")).cast("int")
    edits = [
        F.struct(
            draw(4 * k, length + 1).alias("pos"), draw(4 * k + 1, F.lit(64)).alias("del"), F.substring(F.coalesce("text", F.lit("")), draw(4 * k + 2, length + 1) + 1, draw(4 * k + 3, F.lit(48))).alias("ins")
        )
        for k in range(n)
    ]
    return docs.select("doc_id", "text", F.array(*edits).alias("edits"))


def op6_edit_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_edits(sample_edits(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"))

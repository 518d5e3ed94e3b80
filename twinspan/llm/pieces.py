"""Encoding and decoding with a merge-type SentencePiece vocabulary: a score-ordered agenda of adjacent
symbol pairs, checked against the sentencepiece library in every Arrow batch.

Merges that the vocabulary rules out cut the text first: if no piece holds the space mark after another
character, no merge crosses from a word into the next space, and if none holds a newline next to
something, none touches a newline. Each stretch is merged by itself, and frequent ones are remembered.

Why the ids are the library's: it merges the adjacent pair whose result has the best score, the leftmost of equals,
until no pair is a piece, and so does the agenda; a merge changes which pairs are adjacent only beside it, so stretches
that no piece reaches across don't bear on each other. Besides, the library encodes every stretch that a batch has merged
before the batch's ids are used, so that all of every text is compared, and tests compare whole tables.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, slices, table

SPACE = "▁"
REMEMBERED = 500_000  # stretches in each of two generations, about 250 MB in all
CHECK_TOGETHER = 1000  # stretches in one text for the library
SHORT = 40
MARKS = ".,;:!?\"'#*$%&|)]}"
NEVER = float("inf")


class MergeModel:
    """Reads pieces and scores through the library; encodes by itself."""

    def __init__(self, path: str):
        lib = self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        everything = range(lib.get_piece_size())
        self.id_of = {lib.id_to_piece(i): i for i in everything if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))}
        self.cost = {p: -lib.get_score(i) for p, i in self.id_of.items()}
        self.byte = {int(lib.id_to_piece(i)[3:5], 16): i for i in everything if lib.is_byte(i)}
        self.unknown, self.end = lib.unk_id(), lib.eos_id()
        if any(lib.is_unused(i) for i in everything) or lib.normalize("a  b ") not in (f"{SPACE}a{SPACE}{SPACE}b{SPACE}", "a  b "):
            raise ValueError("only merge-type models without normalization or unused pieces are read")
        pairs = {pair for p in self.id_of for pair in zip(p, p[1:])}
        self.touching = {x + y for x, y in pairs}  # characters that a merge may bring together
        crosses = any(y == SPACE != x for x, y in pairs)
        newline = any("\n" in pair for pair in pairs)
        own = "" if newline else "\n"
        self.stretches = None if crosses else re.compile(f"{SPACE}+[^{SPACE}{own}]*|[^{SPACE}{own}]+" + (f"|{own}" if own else ""))
        self.parted = not (crosses or newline)  # lines don't bear on each other
        self.lead = lib.encode("\n")
        self.newline = lib.encode("\n\n")[len(self.lead) :]
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}
        self.unchecked: list[tuple[str, list[int]]] = []  # stretches merged since check_merged()
        self.differs = False

    def merge(self, stretch: str) -> list[str]:
        """Takes the best-scored adjacent pair, the leftmost of equals, until no pair is a piece.

        The agenda of a short stretch is a flat list by place, that of a long one a heap."""
        symbols: list[str] = list(stretch)
        n = len(symbols)
        if n <= SHORT:
            get = self.cost.get
            costs = [get(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
            while costs and (best := min(costs)) != NEVER:
                i = costs.index(best)
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                del costs[i]
                if i < len(costs):
                    costs[i] = get(symbols[i] + symbols[i + 1], NEVER)
                if i:
                    costs[i - 1] = get(symbols[i - 1] + symbols[i], NEVER)
            return symbols
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, int]] = []
        cost = self.cost.get
        for i in range(n - 1):
            c = cost(symbols[i] + symbols[i + 1])
            if c is not None:
                agenda.append((c, i, i + 1, 2))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of them has been merged meanwhile
            symbols[i] += symbols[j]
            symbols[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n:
                    pair = symbols[a] + symbols[b]
                    c = cost(pair)
                    if c is not None:
                        heapq.heappush(agenda, (c, a, b, len(pair)))
        return [s for s in symbols if s]

    def ids_of(self, stretch: str) -> list[int]:
        core = len(stretch.rstrip(MARKS))
        if 0 < core < len(stretch) and stretch[core - 1 : core + 1] not in self.touching:
            return self.remembered(stretch[:core]) + self.remembered(stretch[core:])
        ids: list[int] = []
        for s in self.merge(stretch):
            i = self.id_of.get(s)
            if i is not None:
                ids.append(i)
            elif self.byte:
                ids += [self.byte[b] for b in s.encode()]
            else:
                ids.append(self.unknown)
        self.unchecked.append((stretch, ids))
        return ids

    def check_merged(self) -> bool:
        """Whether the library gives the ids of all stretches merged since the last call, each of them in a line of its own. After
        one difference it stays false, as what is remembered can't be trusted any more."""
        merged, self.unchecked = self.unchecked, []
        for at in range(0, len(merged), CHECK_TOGETHER):
            part = merged[at : at + CHECK_TOGETHER]
            text = "\n" + "\n".join([s for s, _ in part])
            want = self.lead + part[0][1]
            for _, ids in part[1:]:
                want += self.newline
                want += ids
            self.differs = self.differs or self.lib.encode(text) != want
        return not self.differs

    def remembered(self, stretch: str) -> list[int]:
        ids = self.young.get(stretch)
        if ids is None:
            ids = self.old.get(stretch)
            if ids is None:
                ids = self.ids_of(stretch)
            if len(stretch) < 64:
                if len(self.young) >= REMEMBERED:
                    self.old, self.young = self.young, {}
                self.young[stretch] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return [self.end]
        marked = SPACE + text.replace(" ", SPACE)
        stretches = self.stretches.findall(marked) if self.stretches else [marked]
        found = list(map(self.young.get, stretches))
        if None in found:
            found = [self.remembered(s) if ids is None else ids for s, ids in zip(stretches, found)]
        ids = list(chain.from_iterable(found))
        ids.append(self.end)
        return ids


_loaded: dict[str, MergeModel] = {}


def merge_model(path: str) -> MergeModel:
    if path not in _loaded:
        _loaded[path] = MergeModel(path)
    return _loaded[path]


def encode_batch(model: MergeModel, texts: list[str]) -> list[list[int]]:
    """Ids with the end id. Each stretch that was merged for them is encoded by the library too, or the texts themselves where
    lines bear on each other; with a difference the batch is the library's as a whole."""
    out = [] if model.differs else [model.encode(t) for t in texts]
    if model.parted and model.check_merged():
        return out
    return model.lib.encode(texts, add_eos=True, num_threads=1)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>, the end id last) and decoded (the library's decode(ids)) for every row; narrow.

    Nulls: a null text is an empty one, so its ids are the end id alone; a null id is carried along.
    Very long texts are encoded whole. Repeated rows each get their row. Other columns are not read. An empty table
    gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merge_model(model_path)
        for part in slices(batches, 2 << 20):
            ids = encode_batch(model, [t or "" for t in part.column(1).to_pylist()])
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])
            yield batch_of(schema, part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), model.lib.decode(ids))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        encode, "doc_id long, ids array<int>, decoded string"
    )


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_documents()."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))

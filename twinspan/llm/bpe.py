"""ids of byte-level BPE vocabularies by the tokenizers library, each different pre-token encoded once.

A text is cut by the vocabulary's own pattern, and within a pre-token merges depend on nothing around it, so the ids of a
text are those of its pre-tokens in order. The library encodes every pre-token when it is first met; ids are kept flat,
and a text's are gathered from there.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, repeat

import numpy as np
import regex
from tokenizers import Tokenizer

# Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 300_000  # different pre-tokens, about 60 MB in all; beyond it the memory starts anew
TOGETHER = 1_000  # pre-tokens in one call; what the library makes of each takes some KB for a moment


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of all (start, size), one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class BytePairIds:
    """Strings of the file's added tokens are ordinary text in flat(), plain() and encoded(), and have their ids in with_added().
    Files with a normalizer or another pre-tokenizer are encoded by the library as whole texts."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.ordinary = Tokenizer.from_file(path)
        self.ordinary.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.added = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or r"(?!)")
        self.parted = spec["model"].get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.cut = regex.compile(PATTERN).findall if self.parted else lambda text: [text]
        self.vocabulary = self.library.get_vocab()
        self.slot: dict[str, int] = {}
        self.ids = self.starts = self.sizes = np.zeros(0, np.int64)

    def slots(self, tokens: list[str]) -> np.ndarray:
        """Where starts and sizes say which of self.ids are those of each pre-token; until the next call."""
        if len(self.slot) > REMEMBERED:
            self.slot = {}
            self.ids = self.starts = self.sizes = np.zeros(0, np.int64)
        out = np.fromiter(map(self.slot.get, tokens, repeat(-1)), np.int64, len(tokens))
        unknown = np.flatnonzero(out < 0).tolist()
        if unknown:
            met = list(map(tokens.__getitem__, unknown))
            new = list(dict.fromkeys(met))
            found = self.encoded(new)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))))
            self.slot.update(zip(new, range(len(self.slot), len(self.starts))))
            out[unknown] = np.fromiter(map(self.slot.__getitem__, met), np.int64, len(met))
        return out

    def encoded(self, tokens: list[str]) -> list[list[int]]:
        """The ids of each of some pre-tokens, which aren't remembered."""
        return [e.ids for at in range(0, len(tokens), TOGETHER) for e in self.ordinary.encode_batch(tokens[at : at + TOGETHER], add_special_tokens=False)]

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each text has."""
        cuts = list(map(self.cut, texts))
        slots = self.slots(list(chain.from_iterable(cuts)))
        sizes = self.sizes[slots]
        before = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0, *map(len, cuts)])]
        return gathered(self.ids, self.starts[slots], sizes), np.diff(before)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        ids, counts = self.flat(texts)
        return np.split(ids, np.cumsum(counts)[:-1]) if texts else []

    def with_added(self, texts: list[str]) -> list[np.ndarray]:
        search = self.added.search
        held = [bool(search(t)) for t in texts]
        out = self.plain(["" if h else t for t, h in zip(texts, held)])
        return [np.array(self.library.encode(t, add_special_tokens=False).ids if h else ids, "<u4") for t, h, ids in zip(texts, held, out)]

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id; an id that the file leaves out has none."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        out = [b""] * (max(self.vocabulary.values()) + 1)
        for token, i in self.vocabulary.items():
            out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        return out


_loaded: dict[str, BytePairIds] = {}


def byte_pair_ids(path: str) -> BytePairIds:
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        _loaded[path] = BytePairIds(path)
    return _loaded[path]

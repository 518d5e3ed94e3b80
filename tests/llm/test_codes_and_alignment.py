"""Vector codes, cross-tokenizer alignment, one-permutation fingerprints: brute force, edge cases, planted likeness."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from twinspan.llm import bpe
from twinspan.llm import cross_tokens as ct
from twinspan.llm import one_permutation as op
from twinspan.llm import vector_codes as vc

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  b ", "a\tb\n\nc", "▁x", "ﬁ ｱ ①", "\x00a", "<s>x</s>", "𝄞a", "\r\n", "　x", "\n", "é" * 50, "=====", "x<|endoftext|>", "it's we'll 'd", "x" * 3000, "日本語のテキスト"]


# ------------------------------------------------------------------ vector codes
def coded_by_hand(rows, parts=8, entries=16, rounds=6):
    kept = sorted(((i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][1])
    ends = vc.part_ends(width, parts)
    cut = lambda v: [v[a:b] for a, b in zip([0, *ends], ends)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        held = [[[] for _ in b] for b in books]
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                held[p][near(x, books[p])[1]].append(x)
        books = [[[sum(c) // len(xs) for c in zip(*xs)] if xs else old for xs, old in zip(h, b)] for h, b in zip(held, books)]
    out, total = [], defaultdict(int)
    for i, v, label in kept:
        found = [near(x, b) for x, b in zip(cut(v), books)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        total[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, code, min(e, vc.MOST), min(total[label], vc.MOST), sha) for i, code, e, label in out), key=str)


def coded(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as code", "1 as error", "0 as v")
    return sorted((tuple(r) for r in vc.compress(df, **kw).collect()), key=str)


def test_codes_against_all_distances(spark):
    rng = random.Random(4)
    f = lambda x: float(np.float32(x))
    rows = [(i, [f(rng.gauss(0, 0.2)) for _ in range(16)], rng.choice([None, 1, 1, 1, 2])) for i in range(120)]
    rows += [(200, None, 1), (201, [None] * 16, 1), (202, [f(1)] * 15 + [math.nan], 2), (203, [math.inf] + [f(0)] * 15, 2), (204, [], 3), (205, [0.5, 0.25], 3)]
    rows += [(3, rows[3][1], 7), (3, rows[3][1], 7), (None, rows[9][1], None)]
    assert coded(spark, rows) == coded_by_hand([r for r in rows if r[0] != 205])
    ties = [(i, [f(rng.choice([-1, 0, 1])) / 1024 for _ in range(8)], i % 2) for i in range(60)]
    assert coded(spark, ties) == coded_by_hand(ties)
    few = [(i, [f(i), f(-i), f(0.3), f(1), f(2), f(3), f(4), f(5), f(6), f(7)], 1) for i in range(5)]
    assert coded(spark, few) == coded_by_hand(few)
    wide = [(i, [f(rng.choice([3e38, -3e38, 1, 1e12])) for _ in range(8)], 1) for i in range(20)]
    assert coded(spark, wide) == coded_by_hand(wide)
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.data())
def test_tree_search_keeps_the_lower_index(width, data):
    point = st.lists(st.integers(-3, 3), min_size=width, max_size=width)
    entries = np.array(data.draw(st.lists(point, min_size=1, max_size=16)), np.int64)
    points = np.array(data.draw(st.lists(point, min_size=1, max_size=20)), np.int64)
    index, distance = vc.nearest(vc.kd_tree(entries), entries, points)
    all_ = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert index.tolist() == all_.argmin(axis=1).tolist() and distance.tolist() == all_.min(axis=1).tolist()
    wide = vc.nearest(vc.kd_tree(entries.astype(object)), entries.astype(object), points.astype(object))
    assert wide[0].tolist() == index.tolist() and list(wide[1]) == distance.tolist()


@given(st.integers(-(2**200), 2**200))
def test_digits_give_the_number_back(x):
    assert sum(d << vc.DIGIT * k for k, d in enumerate(vc._digits(x))) == x and all(-(2**31) <= d < 2**32 for d in vc._digits(x))


# ------------------------------------------------------------------ ids and alignment
def test_ids_of_pretokens_are_the_librarys(spark):
    own, library = bpe.byte_pair_ids(BPE), Tokenizer.from_file(BPE)
    texts = [*ODD, *(r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())]
    assert [i.tolist() for i in own.with_added(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    library.encode_special_tokens = True
    assert [i.tolist() for i in own.plain(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_on_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert bpe.byte_pair_ids(BPE).with_added([" ", text])[1].tolist() == Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids


def aligned_by_hand(rows):
    a_lib, b_lib = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_lib.encode_special_tokens = True
    bytes_a, bytes_b = bpe.byte_pair_ids(BPE).token_bytes(), ct.piece_bytes(b_lib)
    docs, holders = [], Counter()
    for doc_id, text in rows:
        a, b = (a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)) if text else ([], [])
        if any(b"".join(of[i] for i in ids) != b" " + (text or "").encode() for of, ids in ((bytes_a, a), (bytes_b, b))):
            a, b = [], []
        spans = []
        for of, ids in ((bytes_a, a), (bytes_b, b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(of[i]), i))
                at += len(of[i])
            spans.append(own)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for high in common:
            groups.append("|".join(",".join(str(i) for s, e, i in own if low <= s and e <= high) for own in spans))
            low = high
        docs.append((doc_id, len(a), len(b), len(common), links, ";".join(groups)))
        holders.update(set(links))
    best = {}
    for (a, _), n in holders.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(
        ((i, na, nb, ng, len(ls), sum(holders[x] == best[x[0]] for x in ls), sum(holders[x] for x in ls), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, na, nb, ng, ls, g in docs), key=str
    )


@pytest.mark.parametrize("split", [ct.SPLIT, 20])
def test_alignment_by_hand(spark, split):
    rng = random.Random(1)
    words = "the cat sat onto unbelievable mats, 123.5 naïve ... don't 日本 internationalization".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 40])))) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD)]
    rows += [(7, "again"), (7, "again"), (None, "no id"), (None, None), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as a", "2 as key", "'' as groups_sha256").repartition(5)
    assert sorted((tuple(r) for r in ct.align_documents(df, BPE, PIECES, split=split).collect()), key=str) == aligned_by_hand(rows)


def test_alignment_of_no_documents(spark):
    assert ct.align_documents(spark.createDataFrame([], "doc_id long, text string"), BPE, PIECES).count() == 0


def test_alignment_counts_many_times_in_one_flush(spark, monkeypatch):
    rows = [(i, f"word{i % 3} and the {i % 7} others the the") for i in range(300)]
    want = aligned_by_hand(rows)
    monkeypatch.setattr(ct, "AT_ONCE", 50)
    made = [b for b in ct.aligned(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), BPE, PIECES).filter("a is not null").toArrow().to_batches()]
    import pyarrow as pa

    t = pa.Table.from_batches(made).sort_by("a")
    given_ = pa.table({"a": t["a"], "part": pa.array([-1] * len(t), pa.int32()), "is_posting": pa.array([1] * len(t), pa.int32()), "key": t["key"], "b": t["b"], "row": t["row"], "m": t["m"]})
    total = defaultdict(lambda: [0, 0])
    for batch in ct.shares(iter(given_.to_batches(max_chunksize=17))):
        for r in batch.to_pylist():
            for row, best, count in zip(r["row"], r["n_best"], r["count_sum"]):
                total[r["key"] + row][0] += best
                total[r["key"] + row][1] += count
    assert sorted(map(tuple, total.values())) == sorted((w[5], w[6]) for w in want)
    parts = pa.Table.from_batches(list(ct.shares(iter(given_.to_batches(max_chunksize=17))))).sort_by("key")
    sums = pa.Table.from_batches(list(ct.totals(iter(parts.to_batches(max_chunksize=3))))).to_pylist()
    assert {r["key"]: [r["n_best"], r["count_sum"]] for r in sums} == total and len(sums) == len(total)


# ------------------------------------------------------------------ one-permutation fingerprints
def test_likeness_is_that_of_the_sets():
    make, rng = op.OnePermutation(), random.Random(3)
    errors = []
    for n in (1, 4, 9, 40, 300, 4000):
        for share in (0.0, 0.3, 0.6, 0.9, 1.0):
            for _ in range(6):
                common = [rng.random() for _ in range(round(n * share))]
                a, b = ({*common, *(rng.random() for _ in range(n - len(common)))} for _ in range(2))
                true = len(a & b) / len(a | b)
                prints = [make_from(make, s) for s in (a, b)]
                errors.append(make.likeness(*prints) - true)
                assert abs(errors[-1]) < 0.5 / math.sqrt(min(n, 512)) + 0.12
                assert share < 1 or errors[-1] == 0
    assert abs(np.mean(errors)) < 0.02


def make_from(make, items):
    hashes = op.mixed(np.array([int(x * 2**60) for x in items], np.uint64))
    least = make.minima(hashes)
    least = least[make.sources(least != op._NONE)]
    low = (op.mixed(least ^ make.number) & np.uint64(15)).astype(np.uint8)
    return bytes((low[0::2] << 4 | low[1::2]).astype(np.uint8))


def test_short_texts_do_not_match_by_chance():
    make = op.OnePermutation()
    prints = [make.fingerprint(t) for t in ("", "one", "two", "one two", "a b c d e", "a b c d f")]
    assert all(make.likeness(p, q) < 0.15 for i, p in enumerate(prints) for q in prints[:i])
    assert make.fingerprint(" \n") == prints[0] and make.fingerprint("ONE") == prints[1] and make.likeness(prints[0], prints[0]) == 1


def test_densification_takes_the_first_filled_bin_of_a_fixed_sequence():
    make = op.OnePermutation(bins=16, bits=8)
    filled = np.zeros(16, bool)
    filled[[3, 11]] = True
    got = make.sources(filled)
    for i in range(16):
        k, at = 0, i
        while not filled[at]:
            k += 1
            at = int(op.mixed(make.number[i : i + 1] + np.uint64(k))[0] % np.uint64(16))
        assert got[i] == at


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_following_documents(spark, parts):
    rng = random.Random(9)
    rows = [(i * 3, " ".join(rng.choice("alpha beta gamma Delta ünï 日本 x".split()) for _ in range(rng.choice([0, 1, 4, 30, 400])))) for i in range(40)]
    rows += [(None, "no id at all"), (9, None), (9, "twice the id"), (12, "same"), (12, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "true as last", "'' as fingerprint").repartition(4)
    marked = df.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(text) as h").collect()
    order = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["doc_id"], r["text"]) for r in marked), key=lambda r: r[:3])
    make, want = op.OnePermutation(), []
    for (*_, i, text), (*_, following) in zip(order, order[1:] + order[:1]):
        new = op.edited(text, following)
        assert len(new) == len(text) - len(text) // 2 + min(len(text) // 2, len(following))
        prints = [make.fingerprint(t) for t in (text, new, following)]
        want.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), prints[0].hex(), prints[1].hex(), make.likeness(*prints[:2]), make.likeness(prints[0], prints[2])))
    got = [tuple(r) for r in op.with_following(df, parts=parts).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_following_of_one_and_of_none(spark):
    assert op.with_following(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = op.with_following(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest()


def test_planted_near_copies_are_alike(spark):
    """Texts with one word in 20 replaced stay over their true likeness of about 0.6; other texts near 0."""
    rng = random.Random(5)
    docs = [[f"w{rng.randrange(3000)}" for _ in range(600)] for _ in range(30)]
    make = op.OnePermutation()
    for d in docs:
        copy = [w if rng.random() > 0.02 else "changed" for w in d]
        a, b = " ".join(d), " ".join(copy)
        s, t = set(make.shingles(a).tolist()), set(make.shingles(b).tolist())
        assert abs(make.likeness(make.fingerprint(a), make.fingerprint(b)) - len(s & t) / len(s | t)) < 0.09
        assert make.likeness(make.fingerprint(a), make.fingerprint(" ".join(docs[0]))) in (1.0,) or d is not docs[0]

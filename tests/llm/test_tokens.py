"""Packing, SentencePiece agenda, edit-aware counts, WAV columns."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from twinspan.llm import edit_counts as ec
from twinspan.llm import media
from twinspan.llm import packing as pk
from twinspan.llm import pieces as pc

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  b ", "a\tb\n\nc", "▁x", "ﬁ ｱ ①", "\x00a", "<s>x</s>", "𝄞a", "\r\n", "　x", "\n", "é" * 50, "=====", "<|endoftext|>", "it's we'll 'd", "x" * 3000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


def whole_table(spark):
    return [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


def test_fast_ids_are_the_tokenizers(tokenizer):
    ids = pk.token_ids(BPE)
    assert ids.fast is not None
    for text in [*ODD, "end <|endoftext|> next", "<|endoftext|><|endoftext|>x"]:
        assert ids([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert 50256 in ids(["end <|endoftext|> next"])[0].tolist()


def test_ids_of_a_whole_table(spark, tokenizer):
    texts = [t or "" for t in whole_table(spark)]
    ids = pk.token_ids(BPE)
    for text, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids.fast.encode_ordinary(text) == e.ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_fast_ids_on_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert pk.token_ids(BPE)([" ", text])[1].tolist() == Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=25))
def test_plan_places_each_rank_once_without_gaps(histogram):
    runs = pk.plan(histogram.items(), 64)
    filled: dict[int, list] = {}
    for length, count in histogram.items():
        starts = [r[0] for r in runs[length]] + [count]
        for (rank, first, offset), behind in zip(runs[length], starts[1:]):
            for k in range(behind - rank):
                filled.setdefault(first + k, []).append((offset, length))
    assert sum(map(len, filled.values())) == sum(histogram.values())
    for slots in filled.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(k * v for k, v in histogram.items())
    assert len(filled) <= max(1, -(-total // 64)) * 11 / 9 + 1 or len(filled) <= sum(v for k, v in histogram.items() if k > 32) + 1 + total // 43


def test_packing_of_documents(spark, tokenizer):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.choice([0, 3, 50, 700, 5000])))) for i in range(60)] + [(60, None), (7, "again"), (7, "again"), (None, "no id")]
    got = pk.pack_documents(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as length", "2 as piece")).collect()
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r)
    for i, text in docs[:61]:
        if i == 7:
            continue
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(of[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()) and (k == 0 or r["length"] == 2048)
            at += r["length"]
        assert at == len(ids)
    assert len(of[7]) == 3 and len(of[None]) == 1
    slots = {}
    for r in got:
        slots.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in slots.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert pk.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ------------------------------------------------------------------ sentencepiece
def test_agenda_equals_the_library():
    model = pc.merge_model(PIECES)
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("aeth ▁\n\t.<>0xé漢🙂n  ") for _ in range(rng.randint(1, 90))) for _ in range(800)]
    for t in texts:
        assert model.encode(t) == model.lib.encode(t, add_eos=True), repr(t)


def test_agenda_round_trip_in_batches(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (None, "x"), (1, " ")]
    out = pc.encode_documents(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as ids"), PIECES).collect()
    lib = pc.merge_model(PIECES).lib
    assert sorted(map(tuple, (r["ids"] for r in out))) == sorted(tuple(lib.encode(t or "", add_eos=True)) for _, t in rows)
    assert sorted(r["decoded"] for r in out) == sorted(lib.decode(lib.encode(t or "", add_eos=True)) for _, t in rows)
    d = pc.digest(pc.encode_documents(spark.createDataFrame([(1, None)], "doc_id long, text string"), PIECES)).first()
    assert (d["n_tokens"], d["decoded_sha256"]) == (1, "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")
    assert pc.digest(pc.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PIECES)).count() == 0


def test_agenda_on_a_whole_table(spark):
    model = pc.merge_model(PIECES)
    texts = [t or "" for t in whole_table(spark)]
    assert [model.encode(t) for t in texts] == model.lib.encode(texts, add_eos=True)


def test_every_merged_stretch_is_compared():
    """A wrong merge in any text of a batch is found, also where it is remembered or stands behind a line's end."""

    class Wrong(pc.MergeModel):
        def merge(self, stretch):
            return list(stretch) if "zebra" in stretch else super().merge(stretch)

    for odd in ("a zebra", "a\nzebra.", "  zebra" * 30):
        model, texts = Wrong(PIECES), ["one two", "three", odd, "", "four \n\n five▁six\x00é漢"]
        want = model.lib.encode(texts, add_eos=True)
        assert [model.encode(t) for t in texts] != want
        for _ in range(2):
            assert pc.encode_batch(model, texts) == want and model.differs
    model = pc.MergeModel(PIECES)
    right = [t.replace("zebra", "horse") for t in texts]
    assert pc.encode_batch(model, right) == model.lib.encode(right, add_eos=True) and not model.differs


# ------------------------------------------------------------------ edits
def segments_in_order(node):
    return [] if node is None else [*segments_in_order(node.left), node, *segments_in_order(node.right)]


def test_trees_follow_any_edits():
    ordinary = Tokenizer.from_file(BPE)
    ordinary.encode_special_tokens = True
    rng, count = random.Random(5), ec.Counter(BPE)
    draw = lambda n: "".join(rng.choice("aab '\n\n  slre1,.!é漢<|tvmd") for _ in range(rng.randint(0, n)))
    for _ in range(300):
        text = draw(rng.choice([0, 5, 60, 1500]))
        tree = ec.TokenTree(text, count)
        for _ in range(5):
            pos, delete, insert = rng.randint(-2, len(text) + 3), rng.choice([0, 1, 2, 30, 900]), draw(rng.choice([0, 1, 3, 40, 900]))
            tree.edit(pos, delete, insert)
            pos = min(max(pos, 0), len(text))
            text = text[:pos] + insert + text[pos + delete :]
            assert tree.text() == text
            nodes = segments_in_order(tree.root)
            assert [t for n in nodes for t in n.texts] == ec._MATCH.findall(text)
            assert tree.n_tokens == len(ordinary.encode(text, add_special_tokens=False).ids) == sum(sum(n.counts) for n in nodes)
            assert (tree.n_chars, tree.n_pretokens, tree.root.segments) == (len(text), sum(len(n.texts) for n in nodes), len(nodes))
            assert all(n.rank >= x.rank for n in nodes for x in (n.left, n.right) if x)


def test_edits_touch_few_pretokens_and_few_sums():
    """In a text of 1,600 segments: also where an edit crosses segments or fills one."""
    text = "plain words in a row, " * 17_000
    tree = ec.TokenTree(text, ec.Counter(BPE))
    assert tree.root.segments > 1_500
    for pos, delete, insert in ((20_000, 3, "new words"), (90_000, 1_000, ""), (200_000, 0, "many more words " * 60), (0, 400, "x"), (10**9, 0, " end")):
        before = tree.reencoded, tree.touched
        tree.edit(pos, delete, insert)
        assert tree.reencoded - before[0] < 300 and tree.touched - before[1] < 200
    assert tree.n_tokens == ec.TokenTree(tree.text(), ec.Counter(BPE)).n_tokens


def test_edits_of_long_repeated_and_clashing_rows(spark):
    text = "word " * 100_000
    rows = [(1, text, [(5, 2, "x")], 7), (1, text, [(5, 2, "x")], 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<pos:int,del:int,ins:string>>, n_edits long").selectExpr("*", "1 as n_tokens_after")
    got = [r.asDict() for r in ec.count_edits(docs, BPE).collect()]
    assert len(got) == 2 and got[0] == got[1] and got[0]["n_chars_after"] == 499_999 and got[0]["n_edits"] == 1


def test_count_edits_with_nulls(spark):
    rows = [(1, "hello world", [(0, 5, "bye")]), (2, None, [(3, 1, "a")]), (3, "x", None), (4, "abc", [None, (None, None, None)]), (None, "q", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<pos:int,del:int,ins:string>>")
    got = {r["doc_id"]: r for r in ec.count_edits(docs, BPE).collect()}
    assert got[1]["n_chars_after"] == len("bye world") and got[2]["n_chars_after"] == 1 and got[3]["n_edits"] == 0 and got[4]["n_edits"] == 1 and got[None]["n_tokens_after"] == 1
    assert ec.count_edits(docs.limit(0), BPE).count() == 0


# ------------------------------------------------------------------ media
@pytest.mark.parametrize("data", [b"", b"a", b"x" * 575, b"x" * 576, b"x" * 577, bytes(range(256)) * 40])
def test_wav_keeps_the_payload(data):
    payload = media.padded(data)
    assert len(payload) % 576 == 0 and len(payload) >= 576 and payload.startswith(data) and set(payload[len(data) :]) <= {255}
    assert media.from_wav(media.to_wav(payload)) == payload


def test_peaks_find_a_tone():
    t = np.arange(4000)
    tone = (128 + 100 * np.sin(2 * np.pi * 40 / media.FRAME * t)).astype(np.uint8)
    _, f = media.spectral_peaks(tone)
    assert np.bincount(f).argmax() == 40
    codes = media.peak_pairs(tone)
    assert len(codes) and (np.diff(codes) >= 0).all() and ((codes >> 16 & 0xFFFF) < media.FRAME // 2 + 1).all()


def test_equal_texts_have_equal_values(spark):
    rows = [(1, "some text " * 200), (2, "some text " * 200), (3, None), (4, ""), (None, "z" * 200_000)]
    out = {r["doc_id"]: r.asDict() for r in media.digest(media.fingerprints(media.with_media(spark.createDataFrame(rows, "doc_id long, text string")))).collect()}
    drop = lambda r: {k: v for k, v in r.items() if k != "doc_id"}
    assert drop(out[1]) == drop(out[2]) and drop(out[3]) == drop(out[4]) and out[3]["payload_bytes"] == 576
    assert out[None]["n_bytes"] == 200_000 and out[None]["tail_crc32"] == zlib.crc32(media.padded(b"z" * 200_000)[-32:])


def test_transform_against_plain_sums():
    """Every bin of every frame by its definition, peaks and pairs from there by loops."""
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.integers(0, 256, 576), 128 + 60 * np.sin(np.arange(576) * 0.7) + 40 * np.sin(np.arange(576) * 2))).astype(np.uint8)
    signal = np.append(x.astype(float) - 128, np.zeros(media.FRAME))
    turn = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME)) / media.FRAME)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(1, media.FRAME + 1) / (media.FRAME + 1))
    peaks = []
    for t, at in enumerate(range(0, len(x) - media.FRAME + media.HOP, media.HOP)):
        power = np.abs(turn @ (signal[at : at + media.FRAME] * window))
        power[0] = 0
        mean = power.mean()
        own = [(power[k], k) for k in range(1, len(power) - 1) if power[k] > power[k - 1] and power[k] >= power[k + 1] and power[k] > 2 * mean]
        peaks += [(t, k) for _, k in sorted(own, reverse=True)[: media.PEAKS]]
    t, f = media.spectral_peaks(x)
    assert list(zip(t.tolist(), f.tolist())) == peaks
    codes = [
        (t1 << 32) | (f1 << 16) | (f2 << 4) | (t2 - t1)
        for i, (t1, f1) in enumerate(peaks) for t2, f2 in peaks[i + 1 : i + 1 + media.FAN * media.PEAKS] if 0 < t2 - t1 <= media.REACH
    ]
    assert media.peak_pairs(x).tolist() == sorted(codes) and codes


def test_every_sample_weighs_in_the_transform():
    for units in (1, 2, 7):
        n = 576 * units
        weight = np.zeros(n + media.FRAME)
        for at in range(0, n - media.FRAME + media.HOP, media.HOP):
            weight[at : at + media.FRAME] += media._WINDOW
        assert (weight[:n] > 0).all()


def test_media_of_empty_tables_and_clashing_columns(spark):
    rows = [(1, "x", b"m", 5), (2, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media binary, n_bytes long").selectExpr("*", "'f' as feature", "'d' as data")
    assert sorted(r["n_bytes"] for r in media.digest(media.fingerprints(media.with_media(docs))).collect()) == [0, 1]
    assert media.digest(media.fingerprints(media.with_media(docs.limit(0)))).count() == 0


def test_the_last_samples_are_in_a_frame():
    for units in (1, 2, 5):
        quiet = np.full(576 * units, 128, np.uint8)
        loud = quiet.copy()
        loud[-128:] = (128 + 100 * np.sin(2 * np.pi * 40 / media.FRAME * np.arange(128))).astype(np.uint8)
        assert not len(media.spectral_peaks(quiet)[0])
        t, f = media.spectral_peaks(loud)
        assert 40 in f.tolist() and t.max() == 3 * units - 1

"""SimHash with Golay keys, components, sentence spans: against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from twinspan.llm import simhash as sh
from twinspan.llm import similar, stages
from twinspan.llm import substrings as sub
from twinspan.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a B", "x y z", "É é È", "word " * 300, "a b c d e f g " * 40, "a b"])
def test_fingerprint_is_the_contracts(text):
    assert sh.fingerprint(sh.shingle_hashes(text)) & (2**64 - 1) == plain_fingerprint(text)


def test_every_code_within_three_bits_shares_a_key():
    rng = random.Random(1)
    base = np.array([rng.getrandbits(64) for _ in range(600)], np.uint64)
    other = np.array([int(b) ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3))) for b in base], np.uint64)
    keys = []
    for fps in (base, other):
        own = [set() for _ in fps]
        for rows, key in sh.golay_keys(fps.view(np.int64)):
            for r, k in zip(rows.tolist(), key.tolist()):
                own[r].add(k)
        keys.append(own)
    assert all(x & y for x, y in zip(*keys))
    assert 90 < np.mean([len(x) for x in keys[0]]) < 105


def test_keys_of_unlike_fingerprints_are_rarely_shared():
    """As the docstring has it: 76 n keys of kind 0 among 2^36, so of 20,000 by chance few meet."""
    fps = np.random.default_rng(2).integers(0, 1 << 64, 20_000, np.uint64).view(np.int64)
    counts = Counter()
    for kind, (_, key) in enumerate(sh.golay_keys(fps)):
        counts.update(key.tolist() if not kind else [])
    assert max(counts.values()) <= 4 and sum(n > 1 for n in counts.values()) < 0.001 * len(counts)


def brute_components(fps):
    ids = list(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_groups_match_brute_force_with_a_large_group(spark):
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [centre ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for _ in range(400)]
    fps += [f ^ 1 for f in fps[:30]] + fps[:20]
    rng.shuffle(fps)
    rows = [(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)]
    table = spark.createDataFrame(rows, "id long, fp long")
    got = {r["fp"]: r["component"] for r in sh.near_groups(table).collect()}
    want = brute_components(dict(enumerate(fps)))
    assert {i: got[f] for i, f in rows} == want


def test_groups_too_large_to_hold_are_compared_in_blocks(spark):
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    fps = list({centre ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for _ in range(900)})
    table = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "id long, fp long")
    want = brute_components(dict(enumerate(fps)))
    for most in (40, 1 << 16):
        got = {r["fp"]: r["component"] for r in sh.near_groups(table, most).collect()}
        assert {i: got[int(np.uint64(f).view(np.int64))] for i, f in enumerate(fps)} == want, most


def test_groups_come_whole_or_as_their_size():
    key = np.repeat(np.arange(6), [3, 50, 1, 9, 30, 2])
    for step in (1, 4, 7, 100):
        batches = [sh.pa.RecordBatch.from_arrays([sh.pa.array(key[i : i + step])], ["key"]) for i in range(0, len(key), step)]
        whole, large, parts = {}, {}, Counter()
        for sizes, columns in sh.key_groups(iter(batches), 10):
            if isinstance(columns, int):
                large[sizes] = columns
            else:
                assert sizes.sum() == len(columns[0])
                whole |= Counter(columns[0].tolist())
        assert whole == {0: 3, 2: 1, 3: 9, 5: 2} and large == {1: 50, 4: 30}, step
        if step < 100:
            for sizes, columns in sh.key_groups(iter(batches), 10, parts=True):
                if not isinstance(columns, int):
                    parts.update(columns[0].tolist())
            assert parts == Counter(key.tolist()), step


def test_documents_with_nulls_copies_ties_and_clashing_columns(spark):
    rows = [(1, "a b c d e", "x"), (2, "A B C D E", "y"), (2, "A B C D E", "y"), (3, None, "z"), (4, "", "z"), (None, "a b c d e", "z"), (9, "q " * 4000, None)]
    docs = make(spark, rows, "doc_id long, text string, fingerprint string").withColumnRenamed("fingerprint", "component_id")
    got = sorted(((r["doc_id"] or 0), r["component_id"]) for r in sh.near_duplicates(docs).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (9, 9)]
    assert sh.near_duplicates(make(spark, [])).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ sentence spans
def plain_words(text):
    """(word in lower case, hash, ends a sentence or line) of each word."""
    out = []
    for line in text.lower().split("\n"):
        words = line.split()
        for k, w in enumerate(words):
            bare = w.rstrip("\"')]”’»")
            mark = bare.endswith((".", "!", "?"))
            out.append((w, xxhash.xxh3_64_intdigest(w.encode()) & ~1 | mark, mark or k == len(words) - 1))
    return out


def plain_units(text):
    """Numbers of words before each unit's end, by the rule as the docstring has it."""
    words = plain_words(text)
    value = [h | 1 for _, h, _ in words]
    stops = sorted({i + 1 for i, (_, _, e) in enumerate(words) if e} | {len(words)})
    inside = {i for a, b in zip([0, *stops], stops) if b - a > sub.LONG_SENTENCE for i in range(a, b)}
    ends = [i + 1 for i, v in enumerate(value) if i in inside and all(v < x for x in value[max(0, i - sub.REACH) : i]) and all(v <= x for x in value[i + 1 : i + 1 + sub.REACH])]
    ends = sorted({*ends, *stops})
    out, at = [], 0
    for e in sorted({*ends, len(words)} - {0}):
        while e - at > sub.MAX_UNIT or (e - at > sub.CUT_UNIT and out and out[-1] == at and at not in ends and at):
            at += sub.CUT_UNIT
            out.append(at)
        out.append(e)
        at = e
    return out


def brute_spans(docs):
    """Words that stay, in lower case."""
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        words, ends = [w for w, *_ in plain_words(text)], plain_units(text)
        starts, gone, own = [0, *ends[:-1]], set(), set()
        for a in range(len(ends)):
            b = a
            while b < len(ends) and (b - a + 1 < sub.UNITS or ends[b] - starts[a] < sub.MIN_WORDS):
                b += 1
            if len(ends) == 1 and ends[0] >= sub.MIN_WORDS:
                b = 0
            if b < len(ends):
                key = tuple(words[starts[a] : ends[b]])
                if key in seen or key in own:
                    gone |= set(range(starts[a], ends[b]))
                own.add(key)
        seen |= own
        out[i] = [w for k, w in enumerate(words) if k not in gone]
    return out


def random_sentence(rng):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(rng.randint(1, 9))) + rng.choice([". ", "! ", ".\n", "\n"])


def test_spans_match_brute_force(spark):
    rng = random.Random(3)
    passage = "".join(f"Unique sentence number {k} of this long shared passage stands here. " for k in range(8))
    docs = {i: "".join(random_sentence(rng) for _ in range(rng.randint(0, 30))) for i in range(60)}
    for i in range(5, 60, 9):
        docs[i] = docs[i] + passage + docs[(i + 1) % 60]
    docs[59] = docs[10]
    docs[60] = docs[61] = "A text of one sentence only, but a long one of nineteen words that comes twice in this table, as said"
    docs[62] = docs[63] = "A short one."
    got = {r["doc_id"]: r["text"] for r in sub.remove_repeats(make(spark, list(docs.items()))).collect()}
    want = brute_spans(docs)
    assert {i: t.lower().split() for i, t in got.items()} == want
    assert sum(passage[80:-80] in t for t in got.values()) == 1 and got[61] == "" and got[63] == "A short one."
    for i, t in got.items():  # what stays is as it was
        rest = docs[i]
        for piece in re.findall(r"\S+\s*", t):
            assert piece in rest


def test_units_are_the_rules():
    rng = random.Random(5)
    texts = ["", " ", "a", "No end", "One. Two! Three?\n\nFour", "w " * 500, "a.b.c. d", "\n\n", "tab\tsep " * 60, "Ünï. Cödé.", 'He said "No." Then (he left.) So.']
    texts += ["".join(random_sentence(rng) for _ in range(rng.randint(0, 40))) for _ in range(100)] + [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400))]
    for text in texts:
        words = text.split()
        ends = sub.unit_ends(*sub.word_hashes(text)).tolist()
        assert ends == plain_units(text), text
        assert (ends[-1] if ends else 0) == len(words) and all(0 < b - a <= sub.MAX_UNIT for a, b in zip([0, *ends], ends))
        assert sub.without_spans(text, []) == (text, [])


def test_units_do_not_depend_on_what_stands_before():
    rng = random.Random(9)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(200)]
    found = []
    for k in range(20):
        before = [f"b{rng.randrange(10**6)}" for _ in range(rng.randint(0, 50))]
        ends = sub.unit_ends(*sub.word_hashes(" ".join(before + passage))) - len(before)
        found.append([e for e in ends.tolist() if sub.REACH < e < 200 - sub.REACH])
    assert all(f == found[0] for f in found) and len(found[0]) > 10


def test_spans_with_nulls_repeated_rows_and_other_columns(spark):
    text = "".join(f"Sentence {k} of a text that comes twice is right here. " for k in range(6))
    rows = [(1, text, "a"), (1, text, "b"), (2, text, "c"), (None, text, "d"), (3, None, "e"), (4, "", "f")]
    out = sub.remove_repeats(make(spark, rows, "doc_id long, text string, spans string")).collect()
    assert sorted((r["spans"], r["text"]) for r in out) == [("a", text), ("b", text), ("c", ""), ("d", text), ("e", None), ("f", "")]
    odd = make(spark, rows, "doc_id long, text string, spans string").selectExpr("*", "1 as _text", "2 as _id", "3 as h", "4 as `first`", "5 as `_0`")
    assert sub.remove_repeats(odd).columns == [*odd.columns, "removed_sentences"]
    assert sub.remove_repeats(make(spark, [])).count() == 0


def test_a_hash_that_many_texts_have_is_removed_like_any_other(spark):
    """Enough copies for the sample to send the passage's runs by broadcast."""
    passage = " ".join(f"Common sentence {k} stands in every second text of this table here." for k in range(6))
    rng = random.Random(4)
    docs = {i: (passage + " " if i % 2 else "") + " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for i in range(3000)}
    got = {r["doc_id"]: r["text"].lower().split() for r in sub.remove_repeats(make(spark, list(docs.items()))).collect()}
    assert got == brute_spans(docs)


def repeated_stretches(docs, size):
    """(id, first word, behind the last word) of the longest stretches made of stretches of `size` words of smaller ids or places."""
    seen, out = set(), []
    for i, text in sorted(docs.items()):
        words = text.lower().split()
        hit = [False] * len(words)
        for a in range(len(words) - size + 1):
            key = tuple(words[a : a + size])
            if key in seen:
                hit[a : a + size] = [True] * size
            seen.add(key)
        edges = np.flatnonzero(np.diff(np.array([False, *hit, False]).astype(int))).tolist()
        out += [(i, a, b) for a, b in zip(edges[::2], edges[1::2])]
    return out


def test_repeats_of_50_words_of_the_documents_are_found(spark):
    """Against all stretches of 50 words of 15 different ones or more: none stays untouched, most words go."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r["text"]}
    stretches = [s for s in repeated_stretches(docs, 50) if len(set(docs[s[0]].lower().split()[s[1] : s[2]])) >= 15]
    out = {r["doc_id"]: set(r["removed_sentences"]) for r in sub.remove_repeats(make(spark, list(docs.items()))).collect()}
    share, words = [], []
    for i, a, b in stretches:
        ends = np.array(plain_units(docs[i]))
        gone = np.repeat([k in out[i] for k in range(len(ends))], np.diff(ends, prepend=0))
        share.append(gone[a:b].mean())
        words.append(b - a)
    assert len(stretches) > 100 and min(share) > 0.2 and np.average(share, weights=words) > 0.93


def test_most_units_are_whole_sentences(spark):
    """Every sentence of LONG_SENTENCE words at most is one unit, and over half of the units are such."""
    whole = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        words, marks = sub.word_hashes(r["text"] or "")
        stops, units = np.append(0, np.flatnonzero(marks) + 1), sub.unit_ends(words, marks).tolist()
        spans = {(a, b) for a, b in zip([0, *units], units)}
        short = [(a, b) for a, b in zip(stops.tolist(), stops[1:].tolist()) if b - a <= sub.LONG_SENTENCE]
        assert all(x in spans for x in short)
        whole, total = whole + len(short), total + len(units)
    assert whole > total / 2


def test_near_copies_of_similarity_0_8_are_linked(spark):
    rng = random.Random(21)
    docs = {}
    for group in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for k in range(3):
            own = list(words)
            for at in rng.sample(range(200), rng.randint(0, 6)):
                own[at] = f"x{rng.randrange(10**6)}"
            docs[group * 3 + k] = " ".join(own)
    shingles = {i: {tuple(t.split()[a : a + 5]) for a in range(196)} for i, t in docs.items()}
    parent = {i: i for i in docs}
    for i in docs:
        for j in docs:
            if i < j and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
                parent = {k: new if v == old else v for k, v in parent.items()}
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(make(spark, list(docs.items()))).collect()}
    assert got == parent and len(set(parent.values())) < 80
    rows = [(i, t, "en", "s", 0) for i, t in docs.items()]
    kept = stages.simhash_near_dedup(spark, make(spark, rows, DOCS), "").collect()
    assert {r["doc_id"] for r in kept} == set(parent.values())


def jaccard_components(docs, width=5, least=0.8):
    """By all pairs that share a shingle; the smallest id of each."""
    sets, holders = {}, {}
    for i, text in docs.items():
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
        k = max(1, min(width, len(words)))
        sets[i] = frozenset(tuple(words[a : a + k]) for a in range(len(words) - k + 1)) or frozenset([()])
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    parent = {i: i for i in docs}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in docs:
        for j in {j for s in sets[i] for j in holders[s] if j < i}:
            a, b = find(i), find(j)
            if a != b and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in docs}


def test_a_large_group_of_near_copies_without_a_centre(spark, monkeypatch):
    """Copies of copies in chains, with outliers, in keys of more members than are compared at once."""
    rng = random.Random(31)
    base = [f"w{rng.randrange(9000)}" for _ in range(160)]
    docs = {}
    for i in range(260):
        own = list(base)
        for at in rng.sample(range(160), rng.choice([1, 2, 3, 5, 8])):
            own[at] = f"x{rng.randrange(10**6)}"
        docs[i] = " ".join(own)
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(make(spark, list(docs.items()))).collect()}
    want = jaccard_components(docs)
    assert sum(got[i] == want[i] for i in docs) >= 0.985 * len(docs)
    assert all(want[got[i]] == want[i] for i in docs)  # nothing is linked that isn't similar

def test_large_groups_leave_out_no_pair_that_small_ones_have():
    """In a group of any size every two members that differ in MOST_BITS at most are a candidate, or in one cluster."""
    rng = random.Random(12)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(40), n))
    for n in (2, 4, 5, 40):
        base = rng.getrandbits(60)
        fps = [base, *(flip(base, k % 2) for k in range(n - 2)), flip(base, 9)]
        rows = similar.batch_of(similar.KEYS, [7] * n, list(range(n)), fps)
        edges = [(r["a"], r["b"]) for b in similar._candidates(iter([rows])) for r in b.to_pylist()]
        parent = list(range(n))
        root = lambda x: x if parent[x] == x else root(parent[x])
        for a, b in edges:
            parent[root(a)] = root(b)
        near = [(a, b) for a in range(n) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= similar.MOST_BITS]
        assert (n - 1, 0) in near and all(root(a) == root(b) for a, b in near), n


def test_near_copies_of_the_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("n_chars < 4000").collect() if r["text"]}
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(make(spark, list(docs.items()))).collect()}
    want = jaccard_components(docs)
    linked = [i for i in docs if want[i] != i]
    assert len(linked) > 300 and np.mean([got[i] != i for i in linked]) > 0.99
    assert all(want[got[i]] == want[i] for i in docs)


def test_an_id_with_different_texts_loses_none_of_them(spark):
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "one text of its own that nothing else is like at all", "en", "s", 0), (1, words, "en", "s", 0), (1, words, "de", "s", 0), (2, words, "en", "s", 0), (2, "two", "en", "s", 0), (None, words, "en", "s", 0)]
    kept = stages.simhash_near_dedup(spark, make(spark, rows, DOCS), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(0, words), (1, rows[0][1]), (1, words), (2, "two")])

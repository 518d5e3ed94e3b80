"""Variants of several copies pooled on copy 1 by way of haplotypes.

A record's place in another copy says little about its place on copy 1 once an indel comes before it, in the copy or in the
sample. So each sample's haplotypes of each copy are written out, laid on copy 1 through the alignment of the copies, aligned
anew between stretches that agree, and compared with copy 1; records are made of these differences. Beside them go the regions
in which the result holds: where every copy that lies there was kept.

A haplotype is looked at once however many samples have it. Groups are (copy, sample) lists of records and buckets of
a copy's haplotypes, so nothing grows with the number of samples in one of them. A copy's sequences are read in one step only, once
for each bucket, of which a copy has one unless it has very many haplotypes; before it and behind it go places and numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.scratch import written
from .alignment import align, parse
from .grouped import columns_as_lists, map_groups
from .intervals import kept_stretches, merge_overlapping, overlap_join, with_islands

PAD = 1  # bases beside a discarded record that go with it
ANCHOR = 8  # letters that agree in a row, between which haplotypes are aligned anew
BUCKET = 64  # about so many of a copy's haplotypes are looked at together
SHORT = 64  # letters; alignments of stretches up to here are remembered
PLOIDY = 2  # of a sample without records in a copy
_COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")

Edit = tuple[int, int, str]  # start, end, what stands there instead


def reverse_complement(seq: str) -> str:
    return seq.translate(_COMPLEMENT)[::-1]


# ------------------------------------------------------------------ one haplotype
@lru_cache(maxsize=1 << 14)
def _short(a: str, b: str) -> tuple[tuple[int, str], ...]:
    return tuple(parse(align(a, b)[0]))


def _aligned(a: str, b: str) -> tuple[tuple[int, str], ...] | list[tuple[int, str]]:
    """Most stretches are of few letters and come again and again."""
    return _short(a, b) if len(a) + len(b) <= SHORT else parse(align(a, b)[0])


def _letters(t: str) -> np.ndarray:
    return np.frombuffer(t.encode(), np.uint8) if t.isascii() else np.frombuffer(t.encode("utf-32-le"), np.uint32)


_letters_again = lru_cache(maxsize=2)(_letters)  # copy 1's, for one haplotype after the other


def _joined(ops: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Without empty operations; neighbours of one kind are one."""
    out: list[tuple[int, str]] = []
    for n, op in ops:
        if n and out and out[-1][1] == op:
            out[-1] = (out[-1][0] + n, op)
        elif n:
            out.append((n, op))
    return out


def haplotype(seq: str, edits: list[Edit]) -> tuple[str, list[tuple[int, str]]]:
    """The sequence with its edits (in order, none over another), and its alignment on the sequence without."""
    out, ops, at = [], [], 0
    for s, e, alt in edits:
        out += [seq[at:s], alt]
        ops += [(s - at, "="), *_aligned(seq[s:e], alt)]
        at = e
    return "".join([*out, seq[at:]]), [*ops, (len(seq) - at, "=")]


def compose(outer: list[tuple[int, str]], inner: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """outer: B on A, inner: C on B. C on A, its aligned bases as M."""
    out: list[tuple[int, str]] = []
    a, b = [list(x) for x in outer if x[0]], [list(x) for x in inner if x[0]]
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and a[i][1] in "DN":
            out.append((a[i][0], "D"))
            i += 1
        elif j < len(b) and b[j][1] == "I":
            out.append((b[j][0], "I"))
            j += 1
        else:
            n = min(a[i][0], b[j][0])
            if a[i][1] == "I":
                out += [(n, "I")] if b[j][1] != "D" else []
            else:
                out.append((n, "D" if b[j][1] == "D" else "M"))
            a[i][0] -= n
            b[j][0] -= n
            i, j = i + (not a[i][0]), j + (not b[j][0])
    return out


def realigned(reference: str, read: str, ops: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Keeps stretches of at least ANCHOR equal letters and aligns what lies between them anew."""
    anchors, i, j = [], 0, 0
    x, y = _letters_again(reference), _letters(read)
    for n, op in ops:
        if op in "M=X":
            first = 0
            for last in [*(x[i : i + n] != y[j : j + n]).nonzero()[0].tolist(), n]:
                if last - first >= ANCHOR:
                    anchors.append((i + first, j + first, last - first))
                first = last + 1
            i, j = i + n, j + n
        else:
            i, j = i + n * (op in "DN"), j + n * (op in "IS")
    out, i, j = [], 0, 0
    for a, b, n in [*anchors, (len(reference), len(read), 0)]:
        if reference[i:a] or read[j:b]:
            out += _aligned(reference[i:a], read[j:b])
        out.append((n, "="))
        i, j = a + n, b + n
    return _joined(out)


def edits_of(reference: str, read: str, ops: list[tuple[int, str]]) -> list[Edit]:
    """What differs, stretch by stretch. A pure insertion or deletion goes as far left as the letters repeat (not into the
    stretch before) and takes the base before it along; at the very start the base behind."""
    found, i, j, open_ = [], 0, 0, None
    for n, op in [*ops, (0, "=")]:
        if op == "=":
            if open_:
                found.append((open_[0], i, read[open_[1] : j]))
                open_ = None
        elif not open_:
            open_ = (i, j)
        i, j = i + n * (op in "M=XDN"), j + n * (op in "M=XIS")
    out: list[Edit] = []
    for s, e, alt in found:
        low = out[-1][1] if out else 0
        if s == e or not alt:
            moved = alt or reference[s:e]
            while s > low + 1 and reference[s - 1] == moved[-1]:
                moved, s, e = reference[s - 1] + moved[:-1], s - 1, e - 1
            alt = moved if alt else ""
            if s > low:
                s, alt = s - 1, reference[s - 1] + alt
            elif e < len(reference):
                alt, e = alt + reference[e], e + 1
        out.append((s, e, alt))
    return out


def on_copy_1(seq1: str, seq2: str, cigar: str, forward: bool, edits: list[Edit]) -> list[Edit]:
    """Differences from copy 1 of copy 2 with its edits. cigar: copy 2, read along copy 1, on copy 1."""
    read, ops = haplotype(seq2, edits)
    if not forward:
        read, ops = reverse_complement(read), ops[::-1]
    return edits_of(seq1, read, realigned(seq1, read, compose(parse(cigar), ops)))


def span_on_copy_1(cigar: str, forward: bool, length2: int, s: int, e: int) -> tuple[int, int] | None:
    """From the first to the last base of copy 1 that is aligned with [s, e) of copy 2."""
    s, e = (s, e) if forward else (length2 - e, length2 - s)
    i = j = 0
    low = high = None
    for n, op in parse(cigar):
        if op in "M=X":
            a, b = max(s, j), min(e, j + n)
            if a < b:
                low, high = i + a - j if low is None else low, i + b - j
            i, j = i + n, j + n
        else:
            i, j = i + n * (op in "DN"), j + n * (op in "IS")
    return None if low is None else (low, high)


# ------------------------------------------------------------------ records in copies
def records_in_copies(records: DataFrame, copies: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """copy_id, variant_id, s, e, ref, alts, ok, touched: each record beside each copy that it touches. ok: it lies in the copy
    and in the limits, and isn't an indel at an end of the copy. touched: it reaches into the limits."""
    rows = records.withColumn("e", F.col("s") + F.length("ref"))
    if limits is None:
        rows = rows.withColumn("_in", F.length("ref").cast("bigint"))
    else:
        size = F.sum(F.least("e", "b_e") - F.greatest("s", "b_s"))
        inside = overlap_join(rows.select("variant_id", "chrom_id", "s", "e"), merge_overlapping(limits).drop("n")).groupBy("variant_id").agg(size.alias("_in"))
        rows = rows.join(inside, "variant_id", "left").withColumn("_in", F.coalesce("_in", F.lit(0)))
    pairs = overlap_join(rows, copies.select("copy_id", "chrom_id", "s", "e"))
    indel = F.exists("alts", lambda a: F.length(a) != F.length("ref"))
    ok = (F.col("s") >= F.col("b_s")) & (F.col("e") <= F.col("b_e")) & (F.col("_in") == F.length("ref")) & ~(indel & ((F.col("s") == F.col("b_s")) | (F.col("e") == F.col("b_e"))))
    return pairs.select(F.col("b_copy_id").alias("copy_id"), "variant_id", "s", "e", "ref", "alts", ok.alias("ok"), (F.col("_in") > 0).alias("touched"))


def accepted_records(placed: DataFrame) -> DataFrame:
    """Adds accepted and, for the others, a stretch to discard (mark_s, mark_e; null where the record is outside of the limits
    altogether). Of records that overlap the first one stays; with one that doesn't, all goes from the record before it on."""

    def run(rows: list[tuple]) -> list[tuple]:
        out, end, before = [], -1, None
        for copy_id, variant_id, s, e, ok, touched in rows:
            if not ok:
                out.append((copy_id, variant_id, False, *((s - PAD, e + PAD) if touched else (None, None))))
            elif s < end:
                out.append((copy_id, variant_id, False, before - PAD, e + PAD))
            else:
                out.append((copy_id, variant_id, True, None, None))
                end = e
            before = s
        return out

    columns = ("copy_id", "variant_id", "s", "e", "ok", "touched")
    found = map_groups(placed.select(*columns), ["copy_id"], ["s", "e", "variant_id"], run, "copy_id bigint, variant_id bigint, accepted boolean, mark_s bigint, mark_e bigint")
    return placed.join(found, ["copy_id", "variant_id"])


def sample_haplotypes(called: DataFrame, distance: int) -> DataFrame:
    """called: copy_id, sample_id, variant_id, s, e, ref, alts, accepted, gt, phased. Two kinds of rows: haplotypes (hap, and their
    edits as a text s:e:alt;...), and stretches to discard (hap null, mark_s, mark_e): from an unphased heterozygous record to the
    last heterozygous one within distance behind it."""

    def run(rows: list[tuple]) -> list[tuple]:
        key, ploidy = rows[0][:2], len(rows[0][8])
        if any(len(r[8]) != ploidy or None in r[8] for r in rows):
            raise ValueError(f"sample {key[1]}: genotypes in copy {key[0]} are missing or of different copy numbers")
        out, mixed = [], [len(set(r[8])) > 1 for r in rows]
        for i, r in enumerate(rows):
            if mixed[i] and not r[9]:
                last = None
                for k in range(i + 1, len(rows)):
                    if rows[k][3] - r[4] > distance:
                        break
                    last = k if mixed[k] else last
                if last is not None:
                    out.append((*key, None, None, r[3] - PAD, max(x[4] for x in rows[i + 1 : last + 1]) + PAD))
        for hap in range(ploidy):
            edits = ((r[3], r[4], [r[5], *r[6]][r[8][hap]]) for r in rows if r[7] and r[8][hap])
            out.append((*key, hap, ";".join(f"{s}:{e}:{alt}" for s, e, alt in edits), None, None))
        return out

    columns = ("copy_id", "sample_id", "variant_id", "s", "e", "ref", "alts", "accepted", "gt", "phased")
    schema = "copy_id bigint, sample_id bigint, hap int, edits string, mark_s bigint, mark_e bigint"
    return map_groups(called.select(*columns), ["copy_id", "sample_id"], ["s", "e", "variant_id"], run, schema)


def haplotype_buckets(haps: DataFrame) -> DataFrame:
    """haps: copy_id, edits (any number of times). Each copy's different haplotypes in buckets of about BUCKET: copy_id, bucket,
    n_buckets, edits (an array). In a copy a haplotype's number is its place in the bucket * n_buckets + bucket."""
    n = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("copy_id")) / BUCKET)
    rows = haps.select("copy_id", "edits").distinct().withColumn("n_buckets", n).withColumn("bucket", F.pmod(F.xxhash64("edits"), F.col("n_buckets")))
    return rows.groupBy("copy_id", "bucket", "n_buckets").agg(F.array_sort(F.collect_list("edits")).alias("edits"))


def numbered_haplotypes(buckets: DataFrame) -> DataFrame:
    """copy_id, edits, hap_id."""
    rows = buckets.select("copy_id", "bucket", "n_buckets", F.posexplode("edits").alias("k", "edits"))
    return rows.select("copy_id", "edits", (F.col("k") * F.col("n_buckets") + F.col("bucket")).alias("hap_id"))


def lifted_edits(buckets: DataFrame, copies: DataFrame) -> DataFrame:
    """buckets: haplotype_buckets(). Rows copy_id, hap_id, locus, s, e, ref, alt: each haplotype's differences from copy 1. A copy's
    sequences are shuffled once, and once more for each bucket only where a copy has several."""
    rows = buckets.join(copies.select("copy_id", "locus", "s", "s1", "seq1", "seq2", "cigar", "forward"), "copy_id")
    if not buckets.filter("n_buckets > 1").isEmpty():
        rows = rows.repartition("copy_id", "bucket")
    typed = StructType.fromDDL("copy_id bigint, hap_id bigint, locus bigint, s bigint, e bigint, ref string, alt string")
    arrow = to_arrow_schema(typed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                for copy_id, bucket, n, haps, locus, s2, s1, seq1, seq2, cigar, forward in zip(*columns_as_lists(batch.slice(at, 256))):
                    for k, edits in enumerate(haps):
                        own = [(int(s) - s2, int(e) - s2, alt) for s, e, alt in (x.split(":") for x in edits.split(";") if x)]
                        out += [(copy_id, k * n + bucket, locus, s1 + s, s1 + e, seq1[s:e], alt) for s, e, alt in on_copy_1(seq1, seq2, cigar, forward, own)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    columns = ("copy_id", "bucket", "n_buckets", "edits", "locus", "s", "s1", "seq1", "seq2", "cigar", "forward")
    return rows.select(*columns).mapInArrow(run, typed)


# ------------------------------------------------------------------ records on copy 1
def _gathered(rows: DataFrame, keys: list[str], order: list[str], **lists: Column) -> DataFrame:
    """One row of each group, with lists of its rows' values (without nulls) in order. Groups are many and small: a window only sorts
    them, an aggregate would write each list out and read it again."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select(*keys, *(F.collect_list(c).over(whole).alias(name) for name, c in lists.items()), F.row_number().over(w).alias("_k")).filter("_k = 1").drop("_k")


def pooled_records(haps: DataFrame, lifted: DataFrame, bounds: DataFrame) -> DataFrame:
    """haps: copy_id, sample_id, hap, hap_id (every haplotype). lifted: lifted_edits(). bounds: copy_id, locus, s1, e1 of the copies.
    Records of differences that overlap: locus, s, e, alleles (copy 1's first), and of each sample gt (allele numbers by copy and
    haplotype) and cn (haplotypes of each copy, by copy_id), over the copies that lie there."""
    places = written(with_islands(lifted.select("locus", "s", "e", "ref").distinct(), ["locus"], "record", 0), "record-places")
    # copy 1's letters all along a record are put together from those of its places, which overlap
    cut = lambda text, at, s: F.substring(text, (at - s + 1).cast("int"), F.length(text))
    longer = lambda acc, x: F.when(x["e"] > acc["at"], F.struct(F.concat(acc["t"], cut(x["ref"], acc["at"], x["s"])).alias("t"), x["e"].alias("at"))).otherwise(acc)
    spans = places.groupBy("locus", "record").agg(F.min("s").alias("rs"), F.max("e").alias("re"), F.array_sort(F.collect_list(F.struct("s", "e", "ref"))).alias("d"))
    spans = spans.select("locus", "record", "rs", "re", F.aggregate("d", F.struct(F.lit("").alias("t"), F.col("rs").alias("at")), longer, lambda acc: acc["t"]).alias("ref"))
    # an allele is the reference with a haplotype's differences put in; done once for each haplotype that is different
    step = lambda acc, x: F.struct(F.concat(acc["t"], F.substring(F.col("ref"), (acc["at"] - F.col("rs") + 1).cast("int"), (x["s"] - acc["at"]).cast("int")), x["alt"]).alias("t"), x["e"].alias("at"))
    allele = F.aggregate("d", F.struct(F.lit("").alias("t"), F.col("rs").alias("at")), step, lambda acc: F.concat(acc["t"], cut(F.col("ref"), acc["at"], F.col("rs"))))
    # shuffled by record, which is all that the groups and joins below need
    own = lifted.drop("ref").join(places.drop("ref"), ["locus", "s", "e"]).repartition("locus", "record")
    own = _gathered(own, ["locus", "record", "copy_id", "hap_id"], ["s", "e", "alt"], d=F.struct("s", "e", "alt")).join(spans, ["locus", "record"])
    own = written(own.select("locus", "record", "copy_id", "hap_id", "rs", "re", "ref", allele.alias("allele")), "haplotype-alleles")
    records = own.groupBy("locus", "record").agg(*(F.first(c).alias(c) for c in ("rs", "re", "ref")), F.array_sort(F.collect_set("allele")).alias("a"))
    records = written(records.select("locus", "record", "rs", "re", F.concat(F.array("ref"), F.array_remove("a", F.col("ref"))).alias("alleles")), "records")
    # of each sample a row for each copy that lies there, with its haplotypes' number, and one for each that isn't like copy 1
    active = records.select("locus", "record", "rs", "re").join(bounds.select("locus", "copy_id", "s1", "e1"), "locus").filter("s1 <= rs and re <= e1")
    sizes = haps.groupBy("copy_id", "sample_id").agg(F.count(F.lit(1)).cast("int").alias("ix")).withColumn("hap", F.lit(-1))
    there = active.select("locus", "record", "copy_id").join(sizes, "copy_id")
    other = own.filter("allele != ref").join(records.select("locus", "record", "alleles"), ["locus", "record"])
    other = other.select("locus", "record", "copy_id", "hap_id", (F.array_position("alleles", F.col("allele")) - 1).cast("int").alias("ix")).join(haps, ["copy_id", "hap_id"])
    columns = ("locus", "record", "sample_id", "copy_id", "hap", "ix")
    both = there.select(*columns).unionByName(other.select(*columns)).repartition("locus", "record")
    one, several = F.when(F.col("hap") >= 0, F.struct("copy_id", "hap", "ix")), F.when(F.col("hap") < 0, F.struct("copy_id", "ix"))
    out = _gathered(both, ["locus", "record", "sample_id"], ["copy_id", "hap"], n=several, o=one)
    number = lambda c, hap: F.aggregate("o", F.lit(0), lambda acc, x: F.when((x["copy_id"] == c["copy_id"]) & (x["hap"] == hap), x["ix"]).otherwise(acc))
    gt = F.flatten(F.transform("n", lambda c: F.transform(F.sequence(F.lit(0), c["ix"] - 1), lambda hap: number(c, hap))))
    out = out.filter("size(n) > 0").join(records, ["locus", "record"])
    return out.select("locus", F.col("rs").alias("s"), F.col("re").alias("e"), "alleles", "sample_id", gt.alias("gt"), F.transform("n", lambda c: c["ix"]).alias("cn"))


def result_regions(marks: DataFrame, copies: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """(locus, s, e) on copy 1 where every copy that lies there was kept. marks: copy_id, s, e to discard."""
    bounds = copies.select("copy_id", "chrom_id", "s", "e")
    if limits is None:
        keep = bounds.select("copy_id", "s", "e")
    else:
        keep = overlap_join(merge_overlapping(limits).drop("n"), bounds).select(F.col("b_copy_id").alias("copy_id"), "s", "e")
    both = keep.withColumn("kind", F.lit("keep")).unionByName(marks.select("copy_id", "s", "e", F.lit("discard").alias("kind")))
    own = kept_stretches(both.join(bounds.select("copy_id", F.col("s").alias("lo"), F.col("e").alias("hi")), "copy_id"), ["copy_id"])
    rows = own.join(copies.select("copy_id", "locus", F.col("s").alias("s2"), F.length("seq2").alias("n2"), "s1", "cigar", "forward"), "copy_id")

    def lift(part: list[tuple]) -> list[tuple]:
        out = []
        for _, s, e, locus, s2, n2, s1, cigar, forward in part:
            if found := span_on_copy_1(cigar, forward, n2, s - s2, e - s2):
                out.append((locus, s1 + found[0], s1 + found[1]))
        return out

    lifted = map_groups(rows.select("copy_id", "s", "e", "locus", "s2", "n2", "s1", "cigar", "forward"), ["copy_id"], ["s"], lift, "locus bigint, s bigint, e bigint")
    expected = copies.select("locus", F.col("s1").alias("s"), F.col("e1").alias("e"), F.lit("ref").alias("kind"))
    whole = copies.groupBy("locus").agg(F.min("s1").alias("lo"), F.max("e1").alias("hi"))
    marked = lifted.withColumn("kind", F.lit("keep")).unionByName(expected).join(whole, "locus")
    return merge_overlapping(kept_stretches(marked, ["locus"], by_reference=True), 1, ("locus",)).drop("n")


def pool_variants(records: DataFrame, calls: DataFrame, copies: DataFrame, samples: DataFrame, limits: DataFrame | None = None, distance: int = 500) -> dict[str, DataFrame]:
    """records: variant_id, chrom_id, s, ref, alts. calls: variant_id, sample_id, gt (allele numbers), phased. copies: copy_id,
    locus, chrom_id, s, e and seq2 (as the genome has it), s1, e1 and seq1 (its place on copy 1), cigar (of the copy, read along copy 1, on
    copy 1) and forward; copy 1 itself is one of them, with an alignment of equal bases. samples: sample_id. limits: chrom_id, s, e.

    variants: pooled_records(). regions: result_regions(). A sample without records in a copy has PLOIDY haplotypes like the
    copy itself; one whose genotypes in a copy are missing or of different sizes is an error."""
    bounds = written(copies.select("copy_id", "locus", "chrom_id", "s", "e", "s1", "e1"), "copy-bounds")
    placed = written(accepted_records(written(records_in_copies(records, bounds, limits), "records-in-copies")), "placed-records")
    called = placed.join(calls, "variant_id")
    made = written(sample_haplotypes(called, distance), "sample-haplotypes")
    with_records = made.filter("hap is not null").select("copy_id", "sample_id", "hap", "edits")
    others = bounds.select("copy_id").crossJoin(samples.select("sample_id").distinct()).join(with_records.select("copy_id", "sample_id").distinct(), ["copy_id", "sample_id"], "left_anti")
    plain = others.select("copy_id", "sample_id", F.explode(F.sequence(F.lit(0), F.lit(PLOIDY - 1))).alias("hap"), F.lit("").alias("edits"))
    haps = with_records.unionByName(plain)
    buckets = written(haplotype_buckets(haps), "haplotypes")
    lifted = written(lifted_edits(buckets, copies), "lifted-edits")
    haps = written(haps.join(numbered_haplotypes(buckets), ["copy_id", "edits"]).drop("edits"), "numbered-haplotypes")
    marks = placed.filter("mark_s is not null").select("copy_id", F.col("mark_s").alias("s"), F.col("mark_e").alias("e"))
    marks = marks.unionByName(made.filter("mark_s is not null").select("copy_id", F.col("mark_s").alias("s"), F.col("mark_e").alias("e")))
    return {"variants": pooled_records(haps, lifted, bounds), "regions": result_regions(marks, copies, limits)}



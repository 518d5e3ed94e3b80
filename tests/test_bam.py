"""BAM files written block by block: the same rows from one range and from many, records over blocks, filters, empty files."""

import random

import pytest
from pyspark.sql import functions as F
from twinspan.sources import bam

CONTIGS = [("chr1", 100_000), ("chr2", 50_000)]


def rows(n):
    rng = random.Random(n)
    out = []
    for i in range(n):
        k = rng.choice([0, 1, 75, 150, 151, 3000])
        placed = rng.random() < 0.9
        chrom = rng.choice(["chr1", "chr2"]) if placed else None
        out.append((f"read:{i}", rng.choice([0, 16, 99, 147, 4, 1024]), chrom, rng.randrange(40_000) if placed else None, rng.randrange(61), f"{k}M" if k and placed else None,
                    chrom, rng.randrange(40_000) if placed else None, rng.randrange(-500, 500), "".join(rng.choice("ACGTN") for _ in range(k)) or None, "".join(chr(rng.randrange(33, 75)) for _ in range(k)) if k and rng.random() < 0.9 else None))
    return out


def write(path, data, block=700):
    names = bam.SCHEMA.replace(" string", "").replace(" int", "").replace(" bigint", "").replace("bigint", "").split(", ")
    names = [n.split(" ")[0] for n in bam.SCHEMA.split(", ")]
    content = bam.header_of(CONTIGS) + b"".join(bam.encoded(dict(zip(names, r)), {"chr1": 0, "chr2": 1}) for r in data)
    with open(path, "wb") as f:
        for at in range(0, len(content), block):
            f.write(bam.to_block(content[at : at + block]))
        f.write(bam.END_BLOCK)


@pytest.fixture(scope="module")
def session(spark):
    return bam.register(spark)


@pytest.mark.parametrize("block", [64, 700, 20_000])
def test_ranges_give_the_same_rows(session, tmp_path, block):
    data = rows(400)
    path = str(tmp_path / "a.bam")
    write(path, data, block)
    size = (tmp_path / "a.bam").stat().st_size
    key = lambda r: r[0]
    for parts in (1, 7, 40):
        df = session.read.format("bam").option("rangeBytes", -(-size // parts)).load(path)
        assert df.rdd.getNumPartitions() >= parts - 1
        assert sorted(map(tuple, df.collect()), key=key) == sorted(data, key=key)


def test_filters_are_tried_before_records_are_decoded(session, tmp_path):
    data = rows(300)
    path = str(tmp_path / "a.bam")
    write(path, data)
    df = session.read.format("bam").load(path).filter((F.col("chrom") == "chr2") & (F.col("pos") >= 1000) & (F.col("pos") < 30_000) & (F.col("mapq") > 9) & F.col("seq").isNotNull())
    want = {r[0] for r in data if r[2] == "chr2" and 1000 <= r[3] < 30_000 and r[4] > 9 and r[9]}
    assert {r["name"] for r in df.collect()} == want and want
    reader = bam.BamReader({"path": path})
    left = list(reader.pushFilters([bam.EqualTo(("chrom",), "chr1"), bam.LessThan(("pos",), 5000), bam.EqualTo(("name",), "x")]))
    assert len(left) == 1 and {r[0] for p in reader.partitions() for r in reader.read(p)} == {r[0] for r in data if r[2] == "chr1" and r[3] < 5000}
    assert session.read.format("bam").load(path).filter("chrom = 'chrX'").count() == 0


def test_written_folder(session, tmp_path):
    data = rows(250)
    df = session.createDataFrame(data, bam.SCHEMA).repartition(3)
    path = str(tmp_path / "out")
    df.write.format("bam").option("contigs", ",".join(f"{n}:{k}" for n, k in CONTIGS)).mode("append").save(path)
    assert len(list((tmp_path / "out").glob("*.bam"))) == 3
    got = session.read.format("bam").option("rangeBytes", 9000).load(path).collect()
    assert sorted(map(tuple, got)) == sorted(data, key=lambda r: r[0])


def test_empty_and_foreign_files(session, tmp_path):
    path = str(tmp_path / "none.bam")
    write(path, [])
    assert session.read.format("bam").load(path).count() == 0
    (tmp_path / "no.bam").write_bytes(bam.to_block(b"something else") + bam.END_BLOCK)
    with pytest.raises(Exception, match="not a BAM file"):
        session.read.format("bam").load(str(tmp_path / "no.bam")).count()

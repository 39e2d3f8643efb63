"""Block-gzipped text read in ranges, against the plain text."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from locusframe.sources import bgzf, readers

TEXTS = {
    "usual": b"".join(b"line %d %s\n" % (i, b"x" * (i % 37)) for i in range(900)), "no last end": b"a\nbb\nccc", "empty lines": b"\n\na\n\n", "one long line": b"z" * 5000 + b"\nshort\n",
    "windows": b"a\r\nb\r\n" * 300, "nothing": b"", "no line end": b"q" * 3000, "letters": "é中文\n".encode() * 400, "ends at blocks": b"0123456\n" * 200,
}


def lines_of(path, size, range_bytes):
    out = []
    for part in bgzf.ranges([str(path)], range_bytes):
        for text, places in bgzf.range_text(part):
            batch = bgzf._batch(text, places, part.path)
            out += zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), strict=True)
    return out


@pytest.mark.parametrize("name", TEXTS)
@pytest.mark.parametrize("batch", [50, 4 << 20])
def test_any_range_size_gives_all_lines_once(tmp_path, monkeypatch, name, batch):
    monkeypatch.setattr(bgzf, "BATCH_BYTES", batch)
    text = TEXTS[name]
    path = tmp_path / "a.bgz"
    for block in (8, 64, 999):
        path.write_bytes(bgzf.blocks(text, block) + bgzf.EOF_BLOCK)
        size = path.stat().st_size
        want = [x.removesuffix("\r") for x in text.decode().removesuffix("\n").split("\n")] if text else []
        for range_bytes in (1 if size < 2000 else 31, 97, 1000, size):
            got = lines_of(path, size, range_bytes)
            assert [v for _, v in got] == want and [p for p, _ in got] == sorted({p for p, _ in got})


def test_a_task_a_range_and_the_rows_of_the_plain_file(spark, tmp_path):
    text = TEXTS["usual"] * 20
    (tmp_path / "a.vcf.bgz").write_bytes(bgzf.blocks(text, 3000) + bgzf.EOF_BLOCK)
    size = (tmp_path / "a.vcf.bgz").stat().st_size
    df = bgzf.read_lines(spark, str(tmp_path / "a.vcf.bgz"), -(-size // 16))
    assert df.rdd.getNumPartitions() == 16
    assert [r.value for r in df.orderBy("line").collect()] == text.decode().splitlines()
    assert gzip.decompress((tmp_path / "a.vcf.bgz").read_bytes()) == text  # any gzip reader can read what is written


def test_damage_raises(spark, tmp_path):
    text, rng = TEXTS["usual"], random.Random(8)
    whole = bgzf.blocks(text, 500) + bgzf.EOF_BLOCK
    for _ in range(40):
        hurt = bytearray(whole)
        hurt[rng.randrange(len(whole) - len(bgzf.EOF_BLOCK))] ^= 1 << rng.randrange(8)
        (tmp_path / "a.bgz").write_bytes(hurt)
        for range_bytes in (300, 2000, len(whole)):
            try:
                got = [v for _, v in lines_of(tmp_path / "a.bgz", len(whole), range_bytes)]
            except bgzf.DamagedFile as e:
                assert "a.bgz" in str(e)
            else:  # a bit of a header that carries nothing
                assert got == text.decode().splitlines()
    (tmp_path / "a.bgz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(bgzf.DamagedFile):
        lines_of(tmp_path / "a.bgz", len(whole) // 2, 700)
    (tmp_path / "b.gz").write_bytes(gzip.compress(text))
    with pytest.raises(Exception, match="no whole block"):
        bgzf.read_lines(spark, str(tmp_path / "b.gz")).collect()


def test_vcf_and_registry_readers_take_all_forms(spark, tmp_path):
    vcf = "##reference=GRCh38\n#CHROM\n" + "".join(f"chr1\t{i}\t.\tA\tG\t.\tPASS\t.\tGT\t0/1\n" for i in range(1, 400))
    (tmp_path / "p.vcf").write_text(vcf)
    (tmp_path / "g.vcf.gz").write_bytes(gzip.compress(vcf.encode()))
    (tmp_path / "b.vcf.gz").write_bytes(bgzf.blocks(vcf.encode(), 700) + bgzf.EOF_BLOCK)
    paths = [str(tmp_path / n) for n in ("p.vcf", "g.vcf.gz", "b.vcf.gz")]
    rows = readers.read_vcf(spark, paths).groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("pos").alias("s"), F.countDistinct("line").alias("lines")).collect()
    assert len(rows) == 3 and {(r.n, r.s, r.lines) for r in rows} == {(399, 399 * 200, 399)}
    readers.require_assembly(spark, paths)
    head = "#" + "\t".join(readers.REGISTRY_COLUMNS) + "\n"
    (tmp_path / "r.gz").write_bytes(bgzf.blocks((head + "\t".join(map(str, range(11))) + "\n").encode(), 20) + bgzf.EOF_BLOCK)
    assert [tuple(r) for r in readers.read_registry(spark, str(tmp_path / "r.gz")).collect()] == [tuple(map(str, range(11)))]


def test_written_files_come_back(spark, tmp_path):
    df = spark.range(5000).select("id", F.concat(F.lit("v"), "id", F.lit("é")).alias("value"))
    bgzf.write_lines(df, "value", str(tmp_path / "out"), ["id"])
    rows = bgzf.read_lines(spark, str(tmp_path / "out"), 2000).orderBy("path", "line").collect()
    assert [r.value for r in rows] == [f"v{i}é" for i in range(5000)]
    assert bgzf.read_lines(spark, str(tmp_path / "out"), 2000).rdd.getNumPartitions() > 4

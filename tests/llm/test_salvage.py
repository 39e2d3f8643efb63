"""Damaged archives: every damaged record is lost, and told with its gap, wherever it stands."""

import collections
import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from locusframe.llm import queries, warc
from locusframe.llm.common import shared_path
from locusframe.llm.shared_files import whole_file

SCHEMA = "page_id bigint, url string, html string"
#: Neighbours of one rest and of others, null and repeated keys, equal, empty and null payloads; in this order in one file.
KEYS = [3, 10, 17, 1, 24, 2, 31, 31, 38, None, 45, None, 5, -4, -11, 52, 59, 66, 7, 73]
PAGES = [(k, "u" * (i * 40 % 300), [f"<p>{i}</p>" * 30, "<p>same</p>", "", None][i % 4]) for i, k in enumerate(KEYS)]


def test_salvage_is_its_sql(spark, tmp_path):
    for name, rows in (("some", PAGES), ("lost", [(7 * i + 3, "u", f"<p>{i % 5}</p>") for i in range(40)]), ("empty", [])):
        path = str(tmp_path / name / "pages.parquet")
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
        got = [tuple(r) for r in queries.warc_salvage(spark, str(tmp_path / name)).select("page_id", "recovered", "logged").collect()]
        con = duckdb.connect()
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
        assert collections.Counter(got) == collections.Counter(con.execute(queries.ORACLE_SQL["warc_salvage"]).fetchall())
        assert len(got) == len(rows)


@pytest.mark.parametrize("packed", [True, False])
def test_neighbours_share_a_gap(spark, packed):
    pages = spark.createDataFrame([(i, "u" * 400, f"<p>{i}</p>") for i in range(9)], SCHEMA).coalesce(1)
    rows = {r.page_id: r for r in warc.salvage(spark, pages, F.col("page_id").isin(0, 3, 4, 5, 8), packed).collect()}
    assert [i for i in range(9) if rows[i].recovered] == [1, 2, 6, 7] and all(rows[i].gap_bytes is None and rows[i].gap_reason is None for i in (1, 2, 6, 7))
    assert all(rows[i].gap_reason for i in (0, 3, 4, 5, 8)) and rows[3].gap_bytes == rows[4].gap_bytes == rows[5].gap_bytes > 2 * rows[0].gap_bytes > 0


def named_member(data: bytes, name: bytes) -> bytes:
    """A gzip member that names its file; a change in the name leaves its data as they are."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return b"\x1f\x8b\x08\x08\0\0\0\0\0\xff" + name + b"\0" + body + struct.pack("<II", zlib.crc32(data), len(data))


@pytest.mark.parametrize("packed", [True, False])
def test_no_damage_is_harmless(spark, packed):
    """The middle of each record is a byte that no check covers."""
    block = warc._HTTP % 3 + b"abc"
    raw = [warc.record_bytes("response", f"urn:page:{i}", "u" * 2000, block, "1970-01-01T00:00:00Z", warc.base32_sha1(b"abc")) for i in range(4)]
    folder = shared_path(spark, "warc")
    with whole_file(f"{folder}/a.warc") as out:
        out.write(b"".join(named_member(r, b"n" * 2000) if packed else r for r in raw))
    found = warc.read_archives(spark.createDataFrame([(f"{folder}/a.warc",)], "path string"))
    copies = warc.damaged_copies(found, F.col("record_id").isin("urn:page:1", "urn:page:3"), shared_path(spark, "warc"))
    after = warc.read_archives(copies).collect()
    assert sorted(r.record_id for r in after if r.reason is None) == ["urn:page:0", "urn:page:2"] and sum(r.reason is not None for r in after) == 2

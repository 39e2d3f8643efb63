"""Operator 2: WARC archives, written from a table and read back by a salvage reader.

Archives are gzip files of one member a record (or plain files of records). The reader checks each record (framing,
length, block digest). Where a check fails it looks for the next gzip member or version line, whichever comes first, that
starts a whole valid record, goes on from there, and reports the bytes between as a quarantined gap. Both kinds are looked
for at every step, so archives may hold both. A valid record that stands whole inside a damaged plain record's block is
found by its version line and returned.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm.common import broadcast_if_small, shared_path, text_batches, written
from locusframe.llm.shared_files import opened, whole_file

# Fixed values of the formats.
_MEMBER = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_MARK = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n"

_CHUNK = 1 << 20
#: An archive is closed at this size and the next one begun.
ARCHIVE_BYTES = 1 << 30


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(kind: str, name: str, uri: str | None, block: bytes, date: str, digest: str, refers_to: str | None = None) -> bytes:
    """One record: header lines, the block, and the two line ends after it."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if uri:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_SAME_PAYLOAD}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    """A valid record and where it stands in its file."""

    offset: int
    length: int
    fields: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The block without its HTTP head, if it has one."""
        if "application/http" in self.fields.get("content-type", "") and (at := self.block.find(b"\r\n\r\n")) >= 0:
            return self.block[at + 4 :]
        return self.block


@dataclass
class Gap:
    """Quarantined bytes and the check that failed at their start."""

    offset: int
    length: int
    reason: str


class _Bad(Exception):
    """A failed check."""


def _parse(data: bytes, offset: int, length: int | None = None) -> tuple[Record, int]:
    """The record at the start of ``data`` and the bytes it takes."""
    line = _VERSION_LINE.match(data)
    if not line:
        raise _Bad("no version line")
    end = data.find(b"\r\n\r\n", line.end() - 2)
    if end < 0:
        raise _Bad("unended header")
    fields = {}
    for one in data[line.end() : end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = one.partition(":")
        if one and not colon:
            raise _Bad("malformed header line")
        fields[name.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    if not size.isdigit():
        raise _Bad("no content length")
    begin, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise _Bad("truncated or mislaid record")
    block = data[begin:stop]
    told = fields.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != base32_sha1(block):
        raise _Bad("block digest differs")
    return Record(offset, length or stop + 4, fields, block), stop + 4


class SalvageReader:
    """Iterates over the records and gaps of one archive; memory is one record and a chunk."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def _find(self, start: int) -> int:
        """The next place of either mark at or after ``start``, or the file's size."""
        longest = max(len(_MEMBER), len(_VERSION))
        while start < self.size:
            chunk = self.file.read_at(min(_CHUNK, self.size - start), start)
            if at := _MARK.search(chunk):
                return start + at.start()
            if start + len(chunk) >= self.size:
                break
            start += max(1, len(chunk) - longest + 1)
        return self.size

    def _member(self, offset: int) -> Record:
        unpack, out, at = zlib.decompressobj(31), [], offset
        try:
            while not unpack.eof:
                chunk = self.file.read_at(min(65536, self.size - at), at)
                if not chunk:
                    raise _Bad("truncated member")
                out.append(unpack.decompress(chunk))
                if len(out) == 1 and not out[0].startswith(_VERSION[: len(out[0])]):
                    raise _Bad("no version line")
                at += len(chunk)
        except zlib.error as e:
            raise _Bad("damaged member") from e
        data = b"".join(out)
        record, taken = _parse(data, offset, at - len(unpack.unused_data) - offset)
        if taken != len(data):
            raise _Bad("bytes after the record")
        return record

    def _head(self, offset: int) -> tuple[bytes, int]:
        """(what was read from ``offset``, where its header ends), read on as long as all lines are header lines."""
        head, checked = b"", 0
        while True:
            more = self.file.read_at(min(65536, self.size - offset - len(head)), offset + len(head))
            head += more
            if not checked:
                if not _VERSION_LINE.match(head):
                    raise _Bad("no version line")
                checked = head.index(b"\r\n") + 2
            while (line := head.find(b"\r\n", checked)) >= 0:
                if line == checked:
                    return head, line - 2
                if b":" not in head[checked:line]:
                    raise _Bad("malformed header line")
                checked = line + 2
            if not more:
                raise _Bad("unended header")

    def _plain(self, offset: int) -> Record:
        head, end = self._head(offset)
        told = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head[:end])
        need = end + 8 + int(told[1]) if told else len(head)
        if need > self.size - offset:
            raise _Bad("truncated or mislaid record")
        return _parse(head[:need] if need <= len(head) else head + self.file.read_at(need - len(head), offset + len(head)), offset)[0]

    def _record(self, offset: int) -> Record:
        return self._member(offset) if self.file.read_at(min(2, self.size - offset), offset) == _MEMBER[:2] else self._plain(offset)

    def __iter__(self) -> Iterator[Record | Gap]:
        offset, gap, reason = 0, None, ""
        while offset < self.size:
            try:
                record = self._record(offset)
            except _Bad as e:
                if gap is None:
                    gap, reason = offset, str(e)
                offset = self._find(offset + 1)
                continue
            if gap is not None:
                yield Gap(gap, offset - gap, reason)
                gap = None
            yield record
            offset += record.length
        if gap is not None:
            yield Gap(gap, self.size - gap, reason)


def _name(page: int | None, again: int) -> str:
    return f"urn:page:{'null' if page is None else page}" + (f":{again}" if again > 1 else "")


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z", packed: bool = True, dedup_bytes: int = 0, level: int = 6, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record a row into archives under ``folder`` and returns (path, records, bytes) of each.

    Of rows with equal payloads of at least ``dedup_bytes`` bytes, that with the least key is a response and the others
    are revisits that refer to it; of repeated rows with one key the first is the response. Null html is an empty
    payload, null urls leave out the target, null keys come last. An archive is written by one task, whole or not at all, and
    closed at ``archive_bytes``. Pages are written where they are read; only narrow rows are shuffled. An empty table
    gives no archives; other columns are ignored.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("bigint").alias("page"), F.col(url).cast("string").alias("url"), body.alias("html"))
    # payloads are compared by digest and size; only these narrow rows meet in groups
    narrow = rows.select("page", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").alias("size"))
    firsts = narrow.where(F.col("size") >= dedup_bytes).groupBy("sha").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    later = written(narrow.where(F.col("size") >= dedup_bytes).join(firsts, "sha").where(~F.col("page").eqNullSafe(F.col("first"))).select(F.col("page").alias("at"), F.col("sha").alias("at_sha"), "first").distinct(), "revisits")
    hashed = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    few = broadcast_if_small(later)
    found = hashed.join(few, hashed["page"].eqNullSafe(few["at"]) & (hashed["sha"] == few["at_sha"]), "left")
    # rows that repeat a key are numbered, and only they are shuffled for it
    again = written(narrow.groupBy("page").agg(F.count("*").alias("n")).where("n > 1").select(F.col("page").alias("of")), "repeated")
    if again.isEmpty():
        ready = found.withColumns({"nth": F.lit(1), "same": F.lit(1)})
    else:
        own = broadcast_if_small(again)
        at = F.col("page").eqNullSafe(F.col("of"))
        # the rows of one key, however many, are numbered in order of their payloads
        nth, rank = (f().over(Window.partitionBy("page").orderBy("sha")) for f in (F.row_number, F.rank))
        many = found.join(own, at, "left_semi").withColumns({"nth": nth, "same": nth - rank + 1})
        ready = found.join(own, at, "left_anti").withColumns({"nth": F.lit(1), "same": F.lit(1)}).unionByName(many)
    ready = ready.select("page", "url", "html", "first", "at", "nth", "same")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[bytes, int]]:
            for batch, bodies in text_batches(batches, 2):
                columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6)]
                for page, target, first, at, again, same, payload in zip(*columns, bodies, strict=True):
                    revisit = first is not None or at is not None or same > 1 and len(payload) >= dedup_bytes
                    # the response is the first of the rows that repeat the least key with this payload
                    to = _name(page if first is None and at is None else first, again - same + 1 if first is None and at is None else 1) if revisit else None
                    head = _HTTP % len(payload)
                    data = record_bytes("revisit" if revisit else "response", _name(page, again), target, head if revisit else head + payload, date, base32_sha1(payload), to)
                    yield gzip_member(data, level) if packed else data

        source, data, part = rows(), None, 0
        while data is not None or (data := next(source, None)) is not None:
            path = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{part:04d}.warc" + ".gz" * packed
            records = size = 0
            with whole_file(path) as out:
                while data is not None and (not size or size + len(data) <= archive_bytes):
                    out.write(data)
                    records, size = records + 1, size + len(data)
                    data = next(source, None)
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})
            part += 1

    return written(ready.mapInArrow(write, "path string, records bigint, bytes bigint"), "archives")


def read_archives(paths: DataFrame, payload: bool = False) -> DataFrame:
    """One row a record or gap of the archives named in the column ``path``.

    Columns: path, offset, length, reason (null for records, the failed check for gaps), record_type, record_id,
    refers_to, target, payload_bytes, payload_digest (computed from the payload that was read, of a revisit as its
    header tells it), told_digest and (``payload``) the payload. Archives are dealt out one a task.
    """
    schema = "path string, offset bigint, length bigint, reason string, record_type string, record_id string, refers_to string, target string, payload_bytes bigint, payload_digest string, told_digest string"
    names = [x.split()[0] for x in schema.split(", ")] + ["payload"] * payload

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64() if n in ("offset", "length", "payload_bytes") else pa.binary() if n == "payload" else pa.string() for n in names]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = opened(path)
                rows, held = [], 0
                with system.open_input_file(place) as file:
                    for x in SalvageReader(file, file.size()):
                        if isinstance(x, Gap):
                            row = (path, x.offset, x.length, x.reason, *[None] * 7, *[None] * payload)
                        else:
                            f, body = x.fields, x.payload
                            told = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                            revisit = f.get("warc-type") == "revisit"
                            row = (path, x.offset, x.length, None, f.get("warc-type"), f.get("warc-record-id", "").strip("<>"), f.get("warc-refers-to", "").strip("<>") or None, f.get("warc-target-uri"), None if revisit else len(body), told if revisit else base32_sha1(body), told, *[body] * payload)
                            held += len(body) * payload
                        rows.append(row)
                        if len(rows) >= 4000 or held > 4_000_000:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    source = paths.select("path")
    return source.repartition(max(1, source.count()), "path").mapInArrow(read, schema + ", payload binary" * payload)


def gap_log(found: DataFrame) -> DataFrame:
    """(path, offset, length, reason) of the quarantined bytes among the rows of ``read_archives``."""
    return found.where("reason is not null").select("path", "offset", "length", "reason")


def damaged_copies(found: DataFrame, damaged: Column, folder: str) -> DataFrame:
    """Copies of archives in which the middle and the last byte of the ``damaged`` records (rows of ``read_archives``) are changed: a fault injected on purpose.

    A change in the middle alone can leave a record as it was: in packed text it may name another place of the same bytes,
    and a plain record's header has no digest. The last byte, of a member's length or of the line ends, is always checked.
    """
    ends = F.when(damaged, F.array(F.col("offset") + F.floor(F.col("length") / 2), F.col("offset") + F.col("length") - 1))
    spots = found.groupBy("path").agg(F.sort_array(F.flatten(F.collect_list(ends))).alias("spots"))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, place = opened(path)
                new = f"{folder}/{path.rpartition('/')[2]}"
                with system.open_input_file(place) as file, whole_file(new) as out:
                    done = 0
                    for start in range(0, file.size(), _CHUNK):
                        data = bytearray(file.read_at(min(_CHUNK, file.size() - start), start))
                        while done < len(places) and places[done] < start + len(data):
                            data[places[done] - start] ^= 0xFF
                            done += 1
                        out.write(bytes(data))
                yield pa.RecordBatch.from_pydict({"path": [new]})

    return written(spots.mapInArrow(copy, "path string"), "damaged")


def page_number(record_id: Column) -> Column:
    """The page_id in a record's id; null for null keys."""
    return F.try_element_at(F.split(record_id, ":"), F.lit(3)).try_cast("bigint")


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes every page as a record, reads the archives back, and tells of each page what they hold.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to, one row a page, repeated and null keys too;
    an empty table gives none; other columns are ignored. Archives just written have to be whole: a gap raises.
    """
    archives = write_archives(pages, shared_path(spark, "warc"))
    found = written(read_archives(archives), "records")
    if gap := gap_log(found).first():
        raise OSError(f"{gap['path']}: {gap['reason']} at {gap['offset']}")
    records = found.where("reason is null")
    whole = records.where("record_type = 'response'").select(F.col("record_id").alias("of"), F.col("payload_bytes").alias("size"), F.col("payload_digest").alias("digest"))
    joined = records.join(whole, F.coalesce("refers_to", "record_id") == F.col("of"), "left")
    return joined.select(page_number(F.col("record_id")).alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", page_number(F.col("refers_to")).alias("refers_to"))


def salvage(spark: SparkSession, pages: DataFrame, damaged: Column, packed: bool = True) -> DataFrame:
    """Archives of all pages, some records damaged on purpose, read back: (page_id, recovered) of every record written, and its gap.

    ``damaged`` reads ``page_id``; where it is null, nothing is damaged. Columns: page_id, recovered, gap_bytes, gap_reason
    (null for recovered records). Damaged records that stand side by side share one gap, and each tells it. An archive's
    narrow rows are sorted in one task.
    """
    archives = write_archives(pages, shared_path(spark, "warc"), packed=packed)
    before = written(read_archives(archives).withColumn("page_id", page_number(F.col("record_id"))), "records")
    copies = damaged_copies(before, F.coalesce(damaged, F.lit(False)), shared_path(spark, "warc"))
    after = written(read_archives(copies), "salvaged")
    name = F.substring_index("path", "/", -1)
    told = after.select(name.alias("file"), "offset", F.struct("offset", "length", "reason").alias("read"), F.lit(None).cast("bigint").alias("page_id"), F.lit(False).alias("own"))
    own = before.select(name.alias("file"), "offset", F.lit(None).cast(told.schema["read"].dataType).alias("read"), "page_id", F.lit(True).alias("own"))
    # what was read back covers every byte of its file: the last that begins at or before a record has it or is its gap
    at = F.last("read", ignorenulls=True).over(Window.partitionBy("file").orderBy("offset"))
    found = own.unionByName(told).withColumn("at", at).where("own")
    gap = F.col("at.reason").isNotNull()
    return found.select("page_id", ((F.col("at.offset") == F.col("offset")) & ~gap).alias("recovered"), F.when(gap, F.col("at.length")).alias("gap_bytes"), F.col("at.reason").alias("gap_reason"))

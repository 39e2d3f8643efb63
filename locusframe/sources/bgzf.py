"""Block-gzipped text (BGZF) as a table of lines, read in byte ranges.

A BGZF file is a row of gzip members of at most 64 KiB, each of which tells its size in its header, so a task can start at
any byte: it looks for the next member from there. Lines that cross from one range into the next belong to the range in
which they start. Every member's checksum is tested; a file that is damaged or isn't of this kind raises.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format: a member's first bytes, its greatest size, and the empty member at a file's end.
_MAGIC = b"\x1f\x8b\x08\x04"
_LARGEST = 1 << 16
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Compressed bytes of a range, and text bytes of a batch.
RANGE_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
SCHEMA = "value string, path string, line bigint"


class DamagedFile(ValueError):
    """A member that can't be read; the message has the file and the place."""


def block(text: bytes, level: int = 6) -> bytes:
    """One member holding ``text`` (65,280 bytes at most, so that it fits whatever it is)."""
    if len(text) > _LARGEST - 256:
        raise ValueError("a block holds 65,280 bytes at most")
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    data = packer.compress(text) + packer.flush()
    if len(data) + 26 > _LARGEST:
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        data = packer.compress(text) + packer.flush()
    head = _MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 0x42, 0x43, 2, len(data) + 25)
    return head + data + struct.pack("<II", zlib.crc32(text), len(text))


def blocks(text: bytes, size: int = _LARGEST - 256) -> bytes:
    """``text`` as members of ``size`` bytes, without the empty one that ends a file."""
    return b"".join(block(text[i : i + size]) for i in range(0, len(text), size))


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a URI or of a plain path."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def _head(data: bytes, at: int) -> tuple[int, int] | None:
    """(size of the member at ``at``, where its data starts) if a header is there, as far as the bytes tell."""
    if data[at : at + 4] != _MAGIC or len(data) < at + 12:
        return None
    (extra,) = struct.unpack_from("<H", data, at + 10)
    place, end = at + 12, at + 12 + extra
    while place + 4 <= min(end, len(data)):
        first, second, length = struct.unpack_from("<BBH", data, place)
        if (first, second, length) == (0x42, 0x43, 2) and place + 6 <= len(data):
            return struct.unpack_from("<H", data, place + 4)[0] + 1, end
        place += 4 + length
    return None


def is_bgzf(uri: str) -> bool:
    system, path = opened(uri)
    with system.open_input_file(path) as file:
        return _head(file.read(64), 0) is not None


class _Members:
    """The members of a file from the first one at or after a place on."""

    def __init__(self, file, size: int, name: str):
        self.file, self.size, self.name = file, size, name
        self.buffer, self.begin = b"", 0

    def _bytes(self, at: int, count: int) -> bytes:
        """``count`` bytes from ``at``, fewer at the file's end; reads ahead."""
        if not self.begin <= at <= at + count <= self.begin + len(self.buffer):
            self.file.seek(at)
            self.begin, self.buffer = at, self.file.read(min(max(count, 8 * _LARGEST), self.size - at))
        return self.buffer[at - self.begin : at - self.begin + count]

    def text(self, at: int) -> tuple[bytes, int]:
        """(text of the member at ``at``, its size)."""
        data = self._bytes(at, _LARGEST)
        head = _head(data, 0)
        if head is None or head[0] > len(data) or head[0] < head[1] + 8:
            raise DamagedFile(f"{self.name}: no whole block at byte {at}")
        size, start = head
        check, length = struct.unpack_from("<II", data, size - 8)
        try:
            text = zlib.decompress(data[start : size - 8], -15, bufsize=max(length, 1))
        except zlib.error as e:
            raise DamagedFile(f"{self.name}: block at byte {at}: {e}") from None
        if len(text) != length or zlib.crc32(text) != check:
            raise DamagedFile(f"{self.name}: checksum of the block at byte {at}")
        return text, size

    def first(self, at: int) -> int:
        """The first member at or after ``at``: the magic bytes of one whose checksum holds; the file's size if the file ends before."""
        data, place = self._bytes(at, 2 * _LARGEST), -1
        while (place := data.find(_MAGIC, place + 1)) >= 0 and place <= _LARGEST:
            if (head := _head(data, place)) and at + place + head[0] <= self.size:
                try:
                    self.text(at + place)
                except DamagedFile:  # bytes that look like a header, or a damaged member: only one that holds is a start
                    continue
                return at + place
        if at + len(data) >= self.size and len(data) <= _LARGEST:
            return self.size
        raise DamagedFile(f"{self.name}: no block within {_LARGEST} bytes from {at}")


@dataclass
class Range(InputPartition):
    """Members that start in bytes [begin, end) of a file."""

    path: str
    begin: int
    end: int
    size: int


def ranges(paths: list[str], range_bytes: int) -> list[Range]:
    """Byte ranges of files and of the files in folders, in order."""
    out = []
    for given in paths:
        system, path = opened(given)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(given)
        found = [info] if info.type == fs.FileType.File else sorted((f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
        root = given[: len(given) - len(path)] if given.endswith(path) else ""
        for f in found:
            out += [Range(root + f.path, begin, min(begin + range_bytes, f.size), f.size) for begin in range(0, f.size, range_bytes)]
    return out


def range_text(part: Range) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """(whole lines, [(place in them, place in the file)]) of a range, in batches.

    A range that doesn't begin the file leaves out all up to its first line end, and every range goes on past its end up to
    the next line end, so each line is read once. Places in the file are virtual offsets: a member's start x 65536 and the
    byte in its text; they grow with the lines.
    """
    system, path = opened(part.path)
    with system.open_input_file(path) as file:
        members = _Members(file, part.size, part.path)
        at = 0 if part.begin == 0 else members.first(part.begin)
        kept, places, size, skipping = [], [], 0, part.begin > 0
        while at < part.size:
            text, length = members.text(at)  # the first member past the end too: so every border is tested from both sides
            past, begin, stop = at >= part.end, 0, len(text)
            if past and skipping:
                break  # no line starts in this range
            if skipping:
                begin = text.find(b"\n") + 1
                skipping = begin == 0
            if past:
                stop = text.find(b"\n") + 1 or len(text)
            if begin < stop and not skipping:
                kept.append(text[begin:stop])
                places.append((size, at << 16 | begin))
                size += stop - begin
            at += length
            if past and text[stop - 1 : stop] == b"\n":
                break
            if size >= BATCH_BYTES:
                whole = b"".join(kept)
                if cut := whole.rfind(b"\n") + 1:
                    yield whole[:cut], places
                    place, value = [x for x in places if x[0] <= cut][-1]
                    places = [(0, value + cut - place), *[(p - cut, v) for p, v in places if p > cut]] if cut < size else []
                    kept, size = [whole[cut:]] * (cut < size), size - cut
        if size:
            yield b"".join(kept), places


def _batch(text: bytes, places: list[tuple[int, int]], path: str) -> pa.RecordBatch:
    data = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(data == 0x0A)
    if not len(ends) or ends[-1] != len(data) - 1:
        ends = np.append(ends, len(data))
    starts = np.concatenate([[0], ends[:-1] + 1])
    at, value = (np.array(x, dtype=np.int64) for x in zip(*places, strict=True))
    member = np.searchsorted(at, starts, "right") - 1
    lines = [x[:-1] if x.endswith("\r") else x for x in text.decode("utf-8", "replace").removesuffix("\n").split("\n")]
    return pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([path] * len(lines), pa.string()), pa.array(value[member] + starts - at[member])], ["value", "path", "line"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split("\n")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        return ranges(self.paths, self.range_bytes) or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for text, places in range_text(partition) if partition.size else ():
            yield _batch(text, places, partition.path)


class BgzfSource(DataSource):
    """``spark.read.format("bgzf")``: (value, path, line); ``path`` has files or folders, one a line, ``range_bytes`` a range's size."""

    @classmethod
    def name(cls) -> str:
        return "bgzf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_lines(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(value, path, line) of BGZF files, a task a range; ``line`` grows with the lines of a file.

    Line ends are taken off, as is a carriage return before one; a file without lines gives none. Files that are damaged
    or only gzipped raise ``DamagedFile`` in the task that finds out.
    """
    spark.dataSource.register(BgzfSource)
    told = "\n".join([paths] if isinstance(paths, str) else paths)
    return spark.read.format("bgzf").option("path", told).option("range_bytes", str(range_bytes)).load()


def write_lines(lines: DataFrame, column: str, path: str, order: list[str]) -> None:
    """One BGZF file a partition of ``lines`` sorted by ``order``, in the folder ``path``; a file appears when it is whole."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, folder = opened(path)
        system.create_dir(folder, recursive=True)
        task = TaskContext.get()
        own, final = f"{folder}/.part-{task.partitionId():05d}.{task.taskAttemptId()}", f"{folder}/part-{task.partitionId():05d}.bgz"
        with system.open_output_stream(own, compression=None) as out:
            rest = b""
            for batch in batches:
                rest += "".join([f"{v}\n" for v in batch.column(0).to_pylist()]).encode()
                whole = len(rest) - len(rest) % (_LARGEST - 256)
                out.write(blocks(rest[:whole]))
                rest = rest[whole:]
            out.write(blocks(rest) + EOF_BLOCK)
        system.move(own, final)
        yield pa.RecordBatch.from_arrays([pa.array([1])], ["files"])

    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(column).mapInArrow(save, "files bigint").agg({"files": "sum"}).collect()  # one row

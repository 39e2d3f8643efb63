"""Operator 4: token ids in files of independent zstandard frames with a trailing seek table.

A file is: data frames (each the little-endian unsigned 32-bit ids of whole consecutive documents), a skippable frame
with the document index (an Arrow stream: key, number of ids), and the seek table of the public zstandard seekable
format: a skippable frame with compressed size, raw size and checksum (low 32 bits of the XXH64 of the raw bytes) of each
frame, the number of frames, a flag byte and the format's magic number. A reader seeks from the end and decompresses
only the frames that hold the wanted documents; any zstandard tool can decompress the whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm.common import shared_path, text_slices, written
from locusframe.llm.shared_files import opened, whole_file
from locusframe.llm.token_cache import text_encoder

# Fixed values of the zstandard seekable format.
_SKIPPABLE_INDEX, _SKIPPABLE_SEEK, _SEEKABLE, _HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY = np.dtype([("packed", "<u4"), ("raw", "<u4"), ("check", "<u4")])
_FOOTER = struct.Struct("<IBI")
_HEAD = struct.Struct("<II")

#: Raw bytes after which a frame ends; a longer document has a frame of its own.
FRAME_BYTES = 1 << 20
#: Text for one file, if the number of files isn't given.
FILE_BYTES = 256 << 20


class FrameWriter:
    """Writes documents' ids to ``out``; keeps one frame and the index in memory."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.frame_bytes, self.packer = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.raw, self.size, self.frames, self.keys, self.counts, self.total = [], 0, [], [], [], 0

    def add(self, key, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.frame_bytes:
            self._flush()
        self.raw.append(ids)
        self.size += len(ids)
        self.keys.append(key)
        self.counts.append(len(ids) // 4)

    def _flush(self) -> None:
        raw = b"".join(self.raw)
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.raw, self.size, self.total = [], 0, self.total + len(packed)

    def close(self, key_type: pa.DataType) -> int:
        """Writes what is left, the index and the seek table; returns the file's size."""
        if self.size:
            self._flush()
        sink = pa.BufferOutputStream()
        index = pa.record_batch([pa.array(self.keys, key_type), pa.array(self.counts, pa.int64())], ["key", "n_tokens"])
        with pa.ipc.new_stream(sink, index.schema) as stream:
            stream.write_batch(index)
        body = self.packer.compress(sink.getvalue().to_pybytes())
        # the index is a frame of the seek table too, with no raw bytes, so that the table's sizes sum to its start
        self.frames.append((_HEAD.size + len(body), 0, xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        table = np.array(self.frames, dtype=_ENTRY).tobytes() + _FOOTER.pack(len(self.frames), _HAS_CHECKSUMS, _SEEKABLE)
        self.out.write(_HEAD.pack(_SKIPPABLE_INDEX, len(body)) + body + _HEAD.pack(_SKIPPABLE_SEEK, len(table)) + table)
        return self.total + 2 * _HEAD.size + len(body) + len(table)


class FrameReader:
    """Random access to a file of FrameWriter: ``keys``, ``counts`` and the ids of single documents."""

    def __init__(self, file):
        self.file, size = file, file.size()
        count, flags, magic = _FOOTER.unpack(file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != _SEEKABLE or not flags & _HAS_CHECKSUMS:
            raise ValueError("not a seekable zstandard file with checksums")
        length = count * _ENTRY.itemsize
        self.frames = np.frombuffer(file.read_at(length, size - _FOOTER.size - length), dtype=_ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.frames["packed"].astype(np.int64))])
        raw = np.cumsum(self.frames["raw"].astype(np.int64))
        self.raw_starts = np.concatenate([[0], raw])
        packed = file.read_at(int(self.frames["packed"][-1]) - _HEAD.size, int(self.starts[-2]) + _HEAD.size)
        self._check(packed, count - 1)
        index = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed)).read_all()
        self.keys = index.column("key").to_pylist()
        self.counts = index.column("n_tokens").to_numpy()
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])
        self._last: tuple[int, bytes] = (-1, b"")

    def _check(self, data: bytes, frame: int) -> None:
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != int(self.frames["check"][frame]):
            raise ValueError(f"frame {frame} fails its checksum")

    def frame(self, number: int) -> bytes:
        if self._last[0] != number:
            raw = int(self.frames["raw"][number])
            packed = self.file.read_at(int(self.frames["packed"][number]), int(self.starts[number]))
            data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(raw, 1))
            self._check(data, number)
            self._last = (number, data)
        return self._last[1]

    def ids(self, at: int) -> bytes:
        """The ids of the document at a place of the index; decompresses its frame only."""
        if not self.counts[at]:
            return b""
        start = int(self.offsets[at]) * 4
        number = int(np.searchsorted(self.raw_starts, start, side="right")) - 1
        begin = start - int(self.raw_starts[number])
        return self.frame(number)[begin : begin + int(self.counts[at]) * 4]


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end: int | None, files: int | None = None, key: str = "doc_id", text: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encodes every text and writes ``files`` files in ascending key order; returns their manifest.

    Without a number there are as many as shuffle partitions, and more for a larger table, so that a file holds about
    FILE_BYTES of text at most; its index and a writer's memory are bounded by that.

    Manifest: file_no, path, n_docs, n_tokens, bytes, start (ids in all files before it). Rows are range-partitioned
    and sorted by key (null keys first), so a file is one sorted range and the files follow each other. Null and empty
    texts have only the ``end`` id (none if it is None); repeated rows are all written. Each file is written to the
    shared folder by one task and moved into place whole.
    """
    kind = docs.schema[key].dataType.simpleString()
    if files is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()[0]
        files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).repartitionByRange(files, "key").sortWithinPartitions("key", F.xxhash64("text"))  # every attempt in the same order
    last = b"" if end is None else int(end).to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        path, writer, key_type = f"{folder}/tokens-{number:06d}.zst", None, None
        with whole_file(path) as out:
            for batch in text_slices(batches, 1):
                writer, key_type = writer or FrameWriter(out, frame_bytes), batch.column(0).type
                ids, at = text_encoder(vocabulary).encode_all(batch.column(1))
                for row, name in enumerate(batch.column(0).to_pylist()):
                    writer.add(name, ids[at[row] : at[row + 1]].tobytes() + last)
            writer = writer or FrameWriter(out, frame_bytes)
            size = writer.close(key_type or pa.int64())
        yield pa.RecordBatch.from_pydict({"file_no": [number], "path": [path], "n_docs": [len(writer.keys)], "n_tokens": [sum(writer.counts)], "bytes": [size]})

    done = written(rows.mapInArrow(write, "file_no bigint, path string, n_docs bigint, n_tokens bigint, bytes bigint"), "manifest")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return done.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("key_type", F.lit(kind))


def read_token_files(manifest: DataFrame, key_type: str = "bigint", wanted: DataFrame | None = None, ids: bool = True) -> DataFrame:
    """One row a document of the files: key, start, n_tokens, ids_crc32 and (``ids``) ids as an array of long.

    With ``wanted`` (one column of keys, small enough to broadcast) only the frames that hold those keys are read.
    """
    source = manifest.select("path", "start")
    keys = None
    if wanted is not None:
        keys = source.sparkSession.sparkContext.broadcast({r[0] for r in wanted.toLocalIterator()})
    schema = f"key {key_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if ids else "")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, place = opened(path)
                with system.open_input_file(place) as file:
                    reader = FrameReader(file)
                    chosen = [i for i, k in enumerate(reader.keys) if keys is None or k in keys.value]
                    for some in (chosen[i : i + 1000] for i in range(0, len(chosen), 1000)):
                        data = [reader.ids(i) for i in some]
                        row = {"key": [reader.keys[i] for i in some], "start": [start + int(reader.offsets[i]) for i in some], "n_tokens": [len(d) // 4 for d in data], "ids_crc32": [zlib.crc32(d) for d in data]}
                        if ids:
                            row["ids"] = [np.frombuffer(d, "<u4").astype(np.int64) for d in data]
                        yield pa.RecordBatch.from_pydict(row)

    # one file a task: the manifest has a row a file
    return source.repartition(max(1, manifest.count()), "path").mapInArrow(read, schema)


def token_files_digest(spark: SparkSession, docs: DataFrame, vocabulary: str, end: int, files: int | None = None) -> DataFrame:
    """Writes the documents' ids to the shared folder, reads the files back, and returns what they hold.

    doc_id, start, n_tokens and ids_crc32, one row a document; null and empty texts have the end id only, null keys come
    first, repeated rows are all there, an empty table gives none, other columns are ignored.
    """
    manifest = write_token_files(docs, shared_path(spark, "tokens"), vocabulary, end, files)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return read_token_files(manifest, kind, ids=False).withColumnRenamed("key", "doc_id")

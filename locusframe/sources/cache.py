"""A table that fills itself, in versions: readers see one whole version, writers commit optimistically.

``path``/data has one Parquet folder a commit, ``path``/versions one small file a version that lists the folders of that
version. A version comes into being when its file does, by a rename that fails if the file is there (atomic on HDFS and on
stores that have such a rename). So a writer that dies leaves folders that no version lists, and of two writers one sees
that it was second, takes what the first one built, and commits the rest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class CacheConflict(RuntimeError):
    """Other writers were first every time."""


class VersionedCache:
    """A cache table at ``path`` with one row a value of ``keys``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.jvm = spark._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = root.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.makeQualified(root).toUri(), conf)

    def _path(self, *parts: str):
        return self.files.makeQualified(self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts])))

    def version(self) -> int:
        """The newest version, 0 before the first commit."""
        folder = self._path("versions")
        if not self.files.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self.files.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def folders(self, version: int) -> list[str]:
        if not version:
            return []
        stream = self.files.open(self._path("versions", f"{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["folders"]
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version (the newest), None before the first commit."""
        listed = self.folders(self.version() if version is None else version)
        return self.spark.read.parquet(*[f"{self.path}/data/{f}" for f in listed]) if listed else None

    def _commit(self, version: int, folders: list[str]) -> bool:
        """Whether ``version`` is now this list; false if another writer made it first."""
        own, final = self._path("versions", f".{uuid.uuid4().hex}"), self._path("versions", f"{version:012d}.json")
        stream = self.files.create(own, True)
        stream.write(json.dumps({"folders": folders}).encode())
        stream.close()
        try:
            if final.toUri().getScheme() == "file":  # a hard link is made at once or not at all; a local rename isn't
                nio = self.jvm.java.nio.file
                nio.Files.createLink(nio.Path.of(final.toUri()), nio.Path.of(own.toUri()))
                self.files.delete(own, False)
            else:
                rename = self.jvm.org.apache.hadoop.fs.Options.Rename
                options = self.spark.sparkContext._gateway.new_array(rename, 1)
                options[0] = rename.NONE
                self.context.rename(own, final, options)
            return True
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            self.files.delete(own, False)
            return False

    def fill(self, wanted: DataFrame, build: Callable[[DataFrame], DataFrame], attempts: int = 20) -> DataFrame | None:
        """The newest version after all ``wanted`` keys have rows, those that lacked them by ``build(missing keys)``.

        Each key is built once by this call, whatever other writers do meanwhile: if they commit first, rows of keys that
        they have by then are left out of what is committed here. ``build`` may give no row for a key; it is then asked
        again by the next call. Raises ``CacheConflict`` after ``attempts`` lost races.
        """
        version = self.version()
        have = self.read(version)
        missing = wanted.select(self.keys).distinct()
        missing = missing if have is None else missing.join(have, self.keys, "left_anti")
        folder = uuid.uuid4().hex
        build(missing).write.parquet(f"{self.path}/data/{folder}")
        made = self.spark.read.parquet(f"{self.path}/data/{folder}")
        if made.isEmpty():
            return self.read(version)
        for _ in range(attempts):
            if self._commit(version + 1, [*self.folders(version), folder]):
                return self.read(version + 1)
            before, version = self.folders(version), self.version()
            new = [f for f in self.folders(version) if f not in before]
            others = self.spark.read.parquet(*[f"{self.path}/data/{f}" for f in new]).select(self.keys)
            if not made.join(others, self.keys, "left_semi").isEmpty():
                folder = uuid.uuid4().hex
                made.join(others, self.keys, "left_anti").write.parquet(f"{self.path}/data/{folder}")
                made = self.spark.read.parquet(f"{self.path}/data/{folder}")
                if made.isEmpty():
                    return self.read(version)
        raise CacheConflict(f"{self.path}: {attempts} commits by others came first")

    def unlisted(self) -> list[str]:
        """Data folders that the newest version doesn't list: of dead writers, or of some that are at work."""
        folder = self._path("data")
        listed = set(self.folders(self.version()))
        return sorted(f.getPath().getName() for f in self.files.listStatus(folder) if f.getPath().getName() not in listed) if self.files.exists(folder) else []

"""Binary files in the shared folder, written and read by executors through pyarrow's file systems."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a URI such as file:///..., hdfs://..., s3://... or a plain absolute path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@contextlib.contextmanager
def whole_file(uri: str) -> Iterator:
    """An output stream whose file appears under ``uri`` only when it is complete.

    Each attempt of a task writes a file of its own and moves it into place, so retried and speculative attempts, which
    write the same bytes, can't leave half a file.
    """
    system, path = opened(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(own) as out:
            yield out
    except BaseException:
        with contextlib.suppress(OSError):
            system.delete_file(own)
        raise
    try:
        if system.get_file_info(path).type == fs.FileType.NotFound:
            system.move(own, path)
            return
    except OSError:  # some file systems refuse to move onto a file that came into being meanwhile
        if system.get_file_info(path).type != fs.FileType.File:
            raise
    with contextlib.suppress(OSError):
        system.delete_file(own)  # an earlier attempt's file stays

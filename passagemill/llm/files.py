"""Binary files of the operators, in any store that pyarrow can reach."""

from __future__ import annotations

import uuid

from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, file:, hdfs:, s3:, gs:) and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def fresh_file(folder: str, suffix: str) -> tuple[str, object]:
    """A new file that no other attempt of any task writes, and its stream."""
    store, inside = store_of(folder)
    store.create_dir(inside, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder.rstrip('/')}/{name}", store.open_output_stream(f"{inside.rstrip('/')}/{name}", compression=None)


def open_file(path: str):
    """A stream that can seek."""
    store, inside = store_of(path)
    return store.open_input_file(inside)

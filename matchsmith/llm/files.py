"""Files that tasks write and read themselves, by URI, in the shared folder."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def store(uri: str):
    """(pyarrow file system, path) of a URI or a plain path."""
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, chunks) -> str:
    """Write byte chunks to a new file; its name is unique by attempt, so a repeated task never
    touches the file of another attempt, and readers go by the names that tasks returned."""
    fs, path = store(folder)
    fs.create_dir(path, recursive=True)
    full = f"{name}-{uuid.uuid4().hex[:12]}"
    with fs.open_output_stream(f"{path}/{full}") as out:
        for c in chunks:
            out.write(c)
    return full


def read_range(folder: str, name: str, start: int, size: int) -> bytes:
    fs, path = store(folder)
    with fs.open_input_file(f"{path}/{name}") as f:
        f.seek(start)
        return f.read(size)

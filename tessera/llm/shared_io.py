"""Plain files in the folder that driver and executors share, whatever store it is in."""

from __future__ import annotations

import io
import os
from urllib.parse import unquote, urlparse


def _local(path: str) -> str | None:
    u = urlparse(path)
    return unquote(u.path) if u.scheme in ("", "file") else None


def write_file(path: str, data: bytes, attempt: str) -> None:
    """Write whole or not at all: a task that is run again replaces its file."""
    if (p := _local(path)) is not None:
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(f"{p}.{attempt}.tmp", "wb") as f:
            f.write(data)
        os.replace(f"{p}.{attempt}.tmp", p)
        return
    from pyarrow import fs

    store, p = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(p))
    with store.open_output_stream(f"{p}.{attempt}.tmp") as f:
        f.write(data)
    store.move(f"{p}.{attempt}.tmp", p)


def open_stream(path: str):
    """The file, to be read in pieces from its beginning."""
    if (p := _local(path)) is not None:
        return open(p, "rb")
    from pyarrow import fs

    store, p = fs.FileSystem.from_uri(path)
    return store.open_input_stream(p)


def open_file(path: str):
    with open_stream(path) as f:
        return io.BytesIO(f.read())


def local_path(path: str) -> str | None:
    """The path to map into memory, if the store is mounted here."""
    return _local(path)

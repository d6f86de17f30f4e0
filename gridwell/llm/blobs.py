"""Whole files in the shared folder, written by tasks so that a retried task leaves the same file."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_blob(uri: str, data: bytes) -> None:
    """Write under another name first, then rename: readers see the whole file or none."""
    store, path = _at(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def read_blob(uri: str) -> bytes:
    store, path = _at(uri)
    with store.open_input_file(path) as f:
        return f.read()

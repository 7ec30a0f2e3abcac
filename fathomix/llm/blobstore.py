"""Binary files in the shared folder, written and read by tasks.

A writer picks a new name for each attempt; only names that reach the committed
manifest are ever read, so a retried or speculative task leaves an orphan at
worst and never a torn file.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri[5:]}"
    return pafs.FileSystem.from_uri(uri)


def attempt_name(folder: str, stem: str, suffix: str) -> str:
    return f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex}{suffix}"


def open_write(uri: str):
    fs, path = resolve(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def open_read(uri: str):
    """A file object with read_at(nbytes, offset) and size()."""
    fs, path = resolve(uri)
    return fs.open_input_file(path)
